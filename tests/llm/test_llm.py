"""Each corpus operator against brute force on small inputs, edge cases included."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specmatch.llm import fingerprint, induced_sort, license_scan, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, suffix_dedup
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
EDGES = [None, "", " \t\n ", "one", "a b c", "same text twice here now ok", "same text twice here now ok", "éü日本 😀 " * 30, "x" * 3000, "ab" * 2000, "The the of and " * 400]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"src{i}", None) for i, t in enumerate(EDGES)]
    return spark.createDataFrame([*rows, (None, "no id at all in this row", "en", "src1", 1), rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


# --- 1 ---------------------------------------------------------------------------------------------------------------


def brute_walk(text: str) -> str:
    """One text's walk, a character and a step at a time."""
    full = (1 << 64) - 1
    records, prints, spot, step = fingerprint._records(), [0] * fingerprint.SLOTS, 0, 0
    while spot < len(text):
        c = ord(text[spot])
        for slot in records.get(step + 1, ()):
            x = (c * 0x9E3779B97F4A7C15 + (step + 1) * 1_000_003 + slot * 7_919) & full
            for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ x >> shift) * odd & full
            prints[slot] = (x ^ x >> 31) >> 60
        kind = (c * 0x9E3779B1 & 0xFFFFFFFF) >> 26
        spot += int(fingerprint._bits(step // fingerprint._BLOCK)[step % fingerprint._BLOCK, kind])
        step += 1
    return "".join(f"{x:x}" for x in prints)


def brute_likeness(a: str, b: str) -> float:
    return min(max((sum(x == y for x, y in zip(a, b)) / len(a) - 1 / 16) / (15 / 16), 0), 1)


def test_edited_fingerprints_against_brute_force(spark, texts):
    got = {r.doc_id: r for r in fingerprint.query(spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        own, other = texts[d], texts[ids[(i + 1) % len(ids)]]
        edited = own[: len(own) - len(own) // 4] + other[: len(own) // 4]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        if len(own) > 6000:
            continue  # a walk in plain Python takes a second a thousand characters
        assert (r.fingerprint, r.edited_fingerprint) == (brute_walk(own), brute_walk(edited))
        assert r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute_likeness(r.fingerprint, got[ids[(i + 1) % len(ids)]].fingerprint))


def test_near_pairs_recall(spark, docs):
    """All pairs at likeness 0.8 lie in one class of the links."""
    prints = [(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(docs).where("n_chars > 0").collect()]
    top = {d: d for d, _ in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in fingerprint.near_pairs(docs).collect():
        assert r.near_id < r.doc_id
        x, y = find(r.doc_id), find(r.near_id)
        top[max(x, y)] = min(x, y)
    pairs = [(a, b) for k, (a, p) in enumerate(prints) for b, q in prints[k + 1 :] if brute_likeness(p, q) >= 0.8]
    assert len(pairs) > 10 and np.mean([find(a) == find(b) for a, b in pairs]) >= 0.98


def test_fingerprints_tell_edits_from_other_texts():
    rng = np.random.default_rng(1)
    a, b = ("".join(rng.choice(list("etaoin shrdlu"), 3000)) for _ in range(2))
    near = a[:1500] + "zz" + a[1500:]
    p = fingerprint.embed([fingerprint.points(t) for t in (a, near, b, a)])
    assert fingerprint.likeness(p[:1], p[1:2])[0] > 0.7 > 0.3 > fingerprint.likeness(p[:1], p[2:3])[0]
    assert (p[0] == p[3]).all()


def test_fingerprint_edges(edges, empty):
    rows = fingerprint.with_next(edges).collect()
    assert len(rows) == len(EDGES) + 2
    assert {r.fingerprint for r in rows if not r.n_chars} == {"0" * 256}
    assert fingerprint.with_next(empty).count() == 0


def test_near_pairs_finds_copies(spark, docs, texts):
    found = {r.doc_id for r in fingerprint.near_pairs(docs).collect()}
    first: dict = {}
    for d in sorted(texts):
        if texts[d] in first:
            assert d in found
        first.setdefault(texts[d], d)


def test_near_pairs_links_beyond_the_hub(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 16, fingerprint.SLOTS, np.uint8)

    def off(of, n):
        out = of.copy()
        out[rng.choice(len(out), n, replace=False)] ^= 5
        return out

    far = [off(base, 64) for _ in range(120)]  # likeness about 0.73 to the two copies
    prints = [*far, base, off(base, 12)]
    rows = [(i, 9, h) for i, h in enumerate(fingerprint.to_hex(np.array(prints)))]
    monkeypatch.setattr(fingerprint, "fingerprints", lambda docs: spark.createDataFrame(rows, "doc_id long, n_chars long, fingerprint string"))
    links = {(r.doc_id, r.near_id) for r in fingerprint.near_pairs(spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert (121, 120) in links
    assert all(fingerprint.likeness(prints[a][None], prints[b])[0] >= 0.8 for a, b in links)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [(1, "Intro.\nReleased under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0."), (4, "He lost his driving license yesterday."), (5, None), (6, ""), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "This work is licensed under the GNU General Public License, version 2.")]
    got = {r.doc_id: (r.licenses, r.n_candidates) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("CC-BY-NC-4.0", 1), 3: ("CC-BY-4.0", 1), 4: ("", 1), 5: ("", 0), 6: ("", 0), 7: ("GPL-3.0", 1), 8: ("GPL-2.0", 1)}


def test_every_license_line_is_found(spark, texts):
    got = {r.doc_id: set(r.licenses.split()) for r in license_scan.query(spark, SF).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for d, t in texts.items():
        assert got[d] == {v for k, v in lines.items() if k in t}


def test_wrapped_and_joined_licenses(spark):
    by = {name: text for name, _, text in license_scan.TEMPLATES}
    rows = [
        (1, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, you can obtain one."),
        (2, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
        (3, "# This is free and unencumbered software released into the public\n# domain."),
        (4, "Some words. Released under the MIT License. More words follow here and go on. Licensed under the Apache License, Version 2.0. The end of the text."),
        (5, " and then ".join([by["CC0-1.0"], by["MPL-2.0"], by["ISC"], by["GPL-3.0"], "Released under the MIT License."])),
    ]
    got = {r.doc_id: (r.licenses, r.n_confirmed) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MPL-2.0", 1), 2: ("ISC", 1), 3: ("Unlicense", 1), 4: ("Apache-2.0 MIT", 2), 5: ("CC0-1.0 GPL-3.0 ISC MIT MPL-2.0", 5)}


def test_license_edges(spark, edges, empty):
    long = "plain words go on and on " * 40_000 + "\nReleased under the MIT License.\n" + "and on " * 1000
    df = edges.unionByName(spark.createDataFrame([(99, long, "en", "s", 1), (98, "Licensed under CC BY 4.0. " * 3, "en", "s", 1)], SCHEMA)).withColumn("licenses", F.lit("own")).withColumn("a.b", F.lit(1))
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (rows[99].licenses, rows[99].n_confirmed) == ("MIT", 1) and (rows[98].licenses, rows[98].n_confirmed) == ("CC-BY-4.0", 3)
    assert all((rows[i].n_candidates, rows[i].licenses, rows[i].findings) == (0, "", "[]") for i in (0, 1, 2, 8))
    assert license_scan.scan(empty).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_ids_equal_sentencepiece(spark, docs, texts):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    for r in rows:
        assert list(r.ids) == judge.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)
    assert all(r.round_trip for r in sentencepiece_codec.query(spark, SF).collect())


def test_codec_edges(edges, empty):
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(edges)).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert sentencepiece_codec.encode(empty).count() == 0


def test_unigram_model_is_rebuilt():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    import struct

    def piece(p, score, kind):
        return field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    raw = piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in (("▁", -2.0), ("▁ab", -1.0), ("a", -3.0), ("b", -3.5), ("ab", -2.5), ("c", -4.0))) + field(2, bytes([3 << 3, 1]))
    m = sentencepiece_codec.parse(raw)
    assert m.kind == 1 and len(m.pieces) == 7
    assert sentencepiece_codec.rebuild(m).encode("abc ab", add_special_tokens=False).tokens == ["▁ab", "c", "▁ab"]


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_sharding_keeps_every_row_and_conflicts_fail(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(9):
        store.append(docs.where(F.col("doc_id") % 9 == k).coalesce(1))
    assert len(store.latest().shards) == 9 and store.version(3).number == 3
    with pytest.raises(sharding.CommitConflict):
        store.commit(sharding.Version(3, "", ()))
    before = store.latest().number
    now = store.compact(target=1 << 20)
    assert now.number > before and len(now.shards) < 9 and sum(s.rows for s in now.shards) == docs.count()
    assert sorted(r.doc_id for r in store.read().collect()) == sorted(r.doc_id for r in docs.collect())
    assert store.read(9).count() == docs.count()
    assert store.vacuum() == 9 and store.read().count() == docs.count()


def test_sharding_edges(spark, edges, empty, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        store.read()
    store.append(empty)
    assert store.compact().shards == () and store.read().count() == 0
    store.append(edges)
    assert store.read().count() == edges.count()
    own = sharding.ShardStore(spark, f"file://{tmp_path}/o")
    own.append(edges.withColumn("_shard", F.lit("mine")).withColumn("file", F.lit("x")))
    assert {r._shard for r in own.read().collect()} == {"mine"}
    assert sharding.query(spark, SF).count() == 200


def test_sharding_bounds_arrivals(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/b")
    target = 128 << 10
    got = store.append(docs.coalesce(1), target)  # one row group of some 290 KB
    assert len(got.shards) >= 4 and all(s.bytes < 0.75 * target for s in got.shards)
    now = store.compact(target)
    assert now.number > got.number and len(now.shards) < len(got.shards) and all(s.bytes < 1.5 * target for s in now.shards)
    assert sorted(r.doc_id for r in store.read().collect()) == sorted(r.doc_id for r in docs.collect())


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_mixing_equals_sql(spark):
    assert not differences(mixing.query(spark, SF), connect(SF), mixing.ORACLE)


def _fill(budget, children):
    """Shares by weight, none above its capacity, what is left over to the others."""
    got, live = dict.fromkeys(children, 0.0), dict(children)
    while live and budget > 1e-9:
        w = sum(x[0] for x in live.values())
        full = {k: c for k, (wt, c) in live.items() if c <= budget * wt / w + 1e-9}
        if not full:
            for k, (wt, _) in live.items():
                got[k] = budget * wt / w
            return got
        for k, c in full.items():
            got[k] = c
            budget -= c
            del live[k]
    return got


def test_mixing_budgets_by_hand(spark, docs):
    t = mixing.Targets(share=1.5)
    rows = mixing.mix(docs, t).collect()
    leaf = Counter()
    for r in rows:
        leaf[r.domain, r.lang, r.source] += r.tokens
    total = math.floor(sum(leaf.values()) * 1.5)
    cap = lambda *key: 3 * sum(v for k, v in leaf.items() if k[: len(key)] == key)
    want = {}
    for d, bd in _fill(total, {d: (t.domains.get(d, 0.1), cap(d)) for d in {k[0] for k in leaf}}).items():
        for g, bg in _fill(bd, {g: (t.languages.get(g, 0.1), cap(d, g)) for g in {k[1] for k in leaf if k[0] == d}}).items():
            for s, bs in _fill(bg, {s: (0.1, cap(d, g, s)) for s in {k[2] for k in leaf if k[:2] == (d, g)}}).items():
                want[d, g, s] = bs
    used = Counter()
    for r in rows:
        assert abs(r.leaf_budget - want[r.domain, r.lang, r.source]) <= 1
        used[r.domain, r.lang, r.source] += r.tokens * r.copies
    assert all(used[k] <= want[k] + 1 for k in want)
    assert all(used[k] >= math.floor(want[k] / leaf[k]) * leaf[k] for k in want if leaf[k])


def brute_copies(rows: list[tuple], targets: mixing.Targets) -> list[int]:
    """Copies of each row (doc_id, domain, lang, source, tokens) of a mixture."""
    leaf = Counter()
    for _, d, g, s, n in rows:
        leaf[d, g, s] += n
    cap = lambda *key: targets.epochs * sum(v for k, v in leaf.items() if k[: len(key)] == key)
    budget, out = {}, [0] * len(rows)
    top = math.floor(sum(leaf.values()) * targets.share)
    for d, bd in _fill(top, {d: (targets.domains.get(d, 0.1), cap(d)) for d in {k[0] for k in leaf}}).items():
        for g, bg in _fill(bd, {g: (targets.languages.get(g, 0.1), cap(d, g)) for g in {k[1] for k in leaf if k[0] == d}}).items():
            for s, bs in _fill(bg, {s: (targets.sources.get(s, 0.1), cap(d, g, s)) for s in {k[2] for k in leaf if k[:2] == (d, g)}}).items():
                budget[d, g, s] = math.floor(bs + 1e-6)
    for key, n in leaf.items():
        whole, rest = divmod(budget[key], n) if n else (1, 0)
        order = sorted((hashlib.md5(f"{targets.seed}:{whole}:{r[0]}".encode()).hexdigest(), r[0], r[4], i) for i, r in enumerate(rows) if r[1:4] == key)
        run = 0
        for _, _, tokens_, i in order:
            run += tokens_
            out[i] = whole + (rest > 0 and tokens_ > 0 and run <= rest)
    return out


def domain(source: str) -> str:
    return ("web", "books", "news", "reference")[int("0" + re.search(r"(\d*)$", source)[1]) % 4]


@pytest.mark.parametrize("share", [0.6, 1.0, 2.2])
def test_mixing_against_brute_force(docs, share):
    t = mixing.Targets(share=share)
    got = {r.doc_id: r.copies for r in mixing.mix(docs, t).collect()}
    rows = [(r.doc_id, domain(r.source or ""), r.lang or "", r.source or "", len(tokens(r.text or ""))) for r in docs.collect()]
    assert got == {r[0]: c for r, c in zip(rows, brute_copies(rows, t))}


def test_mixing_edges(edges, empty):
    rows = mixing.mix(edges).collect()
    assert len(rows) == edges.count() and all(r.copies >= 0 for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_stage_keeps_null_and_shared_ids(spark, edges):
    rows = [(None, f"null id {'word ' * k}", "en", "src1", None) for k in range(1, 40)] + [(7, f"shared id {'word ' * (k % 9)}{k}", "de", "src2", None) for k in range(40)] + [(100 + k, "plain text " * 20, "fr", "src3", None) for k in range(5)]
    for frame in (spark.createDataFrame(rows, SCHEMA), edges):
        want, got = Counter(), Counter()
        for r in mixing.mix(frame).collect():
            want[r.doc_id, r.lang, r.source, r.tokens] += r.copies
        out = mixing.stage(spark, frame, SF).collect()
        for r in out:
            got[r.doc_id, r.lang or "", r.source or "", len(tokens(r.text or ""))] += 1
        assert any(r.doc_id is None for r in out) and +want == +got


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_suffix_dedup_of_a_frequent_anchor(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPANS", 2)
    raw = [texts[d].encode() for d in sorted(texts)]
    assert both_windows(suffix_dedup.digests(docs)) == (brute_dedup(raw), [x[1:3] for x in brute_dedup(raw, suffix_dedup.PASSAGE)])


@pytest.mark.parametrize(("recur", "memory", "block"), [(100, 1 << 26, 1 << 15), (1, 1 << 26, 3), (1, 0, 16)])
def test_induced_sort_against_sorting(monkeypatch, recur, memory, block):
    monkeypatch.setattr(induced_sort, "RECUR", recur)
    monkeypatch.setattr(induced_sort, "MEMORY", memory)
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = np.random.default_rng(3)
    for it in range(60):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 150)))
        if it % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 8)], 8)
        t = np.append(t, 0)
        raw = t.tolist()
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while raw[a + k : a + k + 1] == raw[b + k : b + k + 1] and a + k < len(raw) and b + k < len(raw):
                k += 1
            common.append(min(k, 1000))
        got, lcp = induced_sort.suffix_order(t, 1000)
        assert got.tolist() == order and lcp.tolist() == common


def brute_dedup(texts: list[bytes], n: int = suffix_dedup.WINDOW) -> list[tuple]:
    seen = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def shown(df):
    return [(r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in df.orderBy("doc_id").collect()]


def test_suffix_dedup_against_brute_force(docs, texts):
    assert shown(suffix_dedup.removed(docs)) == brute_dedup([texts[d].encode() for d in sorted(texts)])


def both_windows(df):
    rows = df.orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], [(r.n_passage_bytes, r.n_passages) for r in rows]


def test_suffix_dedup_query_against_brute_force(spark, texts):
    raw = [texts[d].encode() for d in sorted(texts)]
    assert both_windows(suffix_dedup.query(spark, SF)) == (brute_dedup(raw), [x[1:3] for x in brute_dedup(raw, suffix_dedup.PASSAGE)])


def test_suffix_dedup_equals_sql(spark):
    assert not differences(suffix_dedup.query(spark, SF), connect(SF), suffix_dedup.ORACLE)


def test_suffix_dedup_two_windows(spark, edges, empty, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    short, long, mixed = word(230), word(500), [word(150) for _ in range(4)]
    rows = [word(90) + short + word(700), short + word(300), word(20) + long, long[:300] + word(500) + long[200:], "".join(mixed), mixed[0] + mixed[1] + word(9) + mixed[1] + mixed[2], "".join(mixed[2:]) + "q" * 900, "ab" * 700, None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    raw = [(r or "").encode() for r in rows]
    want = brute_dedup(raw), [x[1:3] for x in brute_dedup(raw, suffix_dedup.PASSAGE)]
    assert both_windows(suffix_dedup.digests(df)) == want
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 500)  # segments of the texts that the first window picks
    assert both_windows(suffix_dedup.digests(df)) == want
    assert suffix_dedup.digests(edges).count() == edges.count()
    assert suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_reads_every_row_of_a_key():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 110, 600, np.uint8))
    import pyarrow as pa

    rows = [(7, k, 1, 0, 101, 150, text[:499] + bytes([k])) for k in range(250)]  # the last window is each row's own
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "uid", "c", "lo", "n", "off", "ctx"), r)) for r in rows[low : low + 10]]) for low in range(0, 250, 10)]
    got = [x for b in suffix_dedup._sort(400, 64, 1000)(iter(batches)) for x in b.to_pylist()]
    assert {x["uid"] for x in got} == set(range(250)) and all((x["lo"], x["hi"]) == (0, 499) for x in got)


def test_suffix_dedup_edges(spark, edges, empty, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    p, q = word(420), word(800)
    rows = [word(300) + p + word(200), p + word(30), word(900), q, q[:399], q + q[:401], "z" * 401, "z" * 400 + "y", None, "", p[:200] + p + p[200:]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute_dedup([(r or "").encode() for r in rows])
    assert shown(suffix_dedup.removed(df)) == want
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 500)
    batch = df.toArrow().combine_chunks().to_batches()[0]
    whole = {(i, int(p + k)) for i, f, n in _spans(batch, 1 << 20) for p in [f] for k in range(n)}
    cut = {(i, int(p + k)) for i, f, n in _spans(batch, 500) for p in [f] for k in range(n)}
    assert whole == cut
    assert suffix_dedup.removed(edges).count() == edges.count()
    assert suffix_dedup.removed(empty).count() == 0


def test_suffix_dedup_periodic_texts(spark):
    phrase = "the same short phrase again and again "
    rows = ["a" * 20_000, "b" * 399 + "a" * 500, phrase * 60, "x" + phrase * 25 + "y", phrase[7:] * 11, ("é" * 90 + phrase) * 12, "unlike the others " + "".join(map(str, range(400)))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert shown(suffix_dedup.removed(df)) == brute_dedup([r.encode() for r in rows])


def test_runs_of_equal_spans():
    name = np.array([5, 5, 5, 5, 6, 5, 5, 5], np.uint64)
    first, n = np.arange(0, 16, 2), np.full(8, 2)
    first[7] += 1  # not where the span before it ends
    text = np.array([0, 0, 0, 0, 0, 0, 0, 0])
    head, times = suffix_dedup._runs(text, first, n, name, name)
    assert head.tolist() == [0, 4, 5, 7] and times.tolist() == [4, 1, 2, 1]
    many = np.zeros(40_000, np.int64)
    head, times = suffix_dedup._runs(many, np.arange(40_000), many + 1, many, many)
    assert times.max() == suffix_dedup._MOST_TIMES and times.sum() == 40_000 and len(head) == 3


def _spans(batch, segment):
    suffix_dedup._SEGMENT = segment
    for b, data, at, base in suffix_dedup._segments(iter([batch]), "text"):
        text, first, n, _, _ = suffix_dedup.spans(data, at)
        for t, f, k in zip(text, first, n):
            yield b.column(0)[int(t)].as_py(), int(f - at[t] + base), int(k)


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_lm(texts: dict, train: set) -> dict:
    grams = Counter()
    for d in train:
        s = [*tokens(texts[d]), "</s>"]
        grams.update(zip(["<s>", *s], s))
    count, cont, total = Counter(), Counter(), Counter()
    kinds = {1: Counter(), 2: Counter(), 3: Counter()}
    for (u, v), c in grams.items():
        count[v] += c
        cont[v] += 1
        total[u] += c
        kinds[min(c, 3)][u] += 1

    def discounts(values):
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))]

    d2, d1 = discounts(grams.values()), discounts(cont.values())
    rest = sum(d1[min(c, 3)] for c in cont.values()) / len(grams)
    one = lambda v: max(cont[v] - d1[min(cont[v], 3)], 0) / len(grams) + rest / (len(count) + 1)

    def two(u, v):
        if not total[u]:
            return one(v)
        c = grams[u, v]
        return max(c - d2[min(c, 3)], 0) / total[u] + sum(d2[k] * kinds[k][u] for k in kinds) / total[u] * one(v)

    n, v = sum(count.values()), len(count)
    out = {}
    for d, t in texts.items():
        s = [*tokens(t), "</s>"]
        out[d] = (len(s), sum(count[w] > 0 for w in s), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s), sum(math.log10(two(a, b)) for a, b in zip(["<s>", *s], s)))
    vocabulary = [*count, "never seen"]
    assert sum(two("the", w) for w in vocabulary) == pytest.approx(1)
    return out


def test_lm_scores_against_brute_force(spark, texts):
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    want = brute_lm(texts, set(texts) - held)
    rows = lm_scoring.query(spark, SF).collect()
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (r.doc_id in held)
        assert (r.base_score, r.score) == (pytest.approx(want[r.doc_id][3]), pytest.approx(want[r.doc_id][4]))
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_lm_edges(edges, empty):
    model = lm_scoring.train(edges.select("doc_id", "text"))
    rows = lm_scoring.score(edges, model).collect()
    assert len(rows) == edges.count() and all(math.isfinite(r.score) for r in rows)
    nothing = lm_scoring.train(empty.select("doc_id", "text"))
    assert {r.score for r in lm_scoring.score(edges, nothing).collect()} == {0.0}


def test_lm_missing_file_is_an_error(spark, docs, tmp_path):
    model = lm_scoring.train(docs)
    assert {f.split("-")[0] for f in model.files} == {"bigram", "word"}
    import os

    os.remove(model.folder.removeprefix("file://") + "/" + min(model.files))
    with pytest.raises(Exception, match="No such file"):
        lm_scoring.score(docs, model).collect()


def test_lm_rare_pairs(spark):
    rng = np.random.default_rng(2)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate([*prose, *prose[:5]])), "doc_id long, text string")
    got = {r.doc_id: r.n_rare_pairs for r in lm_scoring.score(df, lm_scoring.train(df)).collect()}
    assert all((got[k] == 0) == (k < 5 or k >= 40) for k in got)


# --- 8 ---------------------------------------------------------------------------------------------------------------


def brute_near(texts: dict, num=85, den=100) -> dict:
    sets = {}
    for d, t in texts.items():
        w = tokens(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {d: d for d in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where: dict = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    both = Counter((a, b) for l in where.values() for i, a in enumerate(l) for b in l[i + 1 :])
    for (a, b), c in both.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize(("block", "entries"), [(256, 2048), (5, 3)])
def test_near_duplicates_against_brute_force(spark, texts, monkeypatch, block, entries):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LIST", entries)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rng = np.random.default_rng(8)
    more = dict(texts)
    words = [f"w{k}" for k in range(4000)]
    for g in range(6):  # chains and stars of edited copies about the threshold
        base = rng.choice(words, 300).tolist()
        for k in range(25):
            t = list(base)
            for _ in range(int(rng.integers(0, 9))):
                t[int(rng.integers(300))] = "edited" + str(rng.integers(1e9))
            more[10_000 + 100 * g + k] = " ".join(t)
            if k % 5 == 4:
                base = t
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_near(more)


def test_near_duplicates_equal_sql(spark):
    assert not differences(near_dedup.query(spark, SF), connect(SF), near_dedup.ORACLE)


def test_near_duplicate_edges(edges, empty):
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].kept and by[i].n_shingles == 0 for i in (0, 1, 2))
    assert by[6].component_id == 5 and not by[6].kept and by[3].n_shingles == 1
    assert near_dedup.near_duplicates(empty).count() == 0


# --- 9, 10 -----------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_classifier.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert sum(r.predicted != r.quality for r in out) <= 0.03 * len(out)


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 10))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    m = quality_classifier.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in quality_classifier.STATISTICS))
    got = np.array([r[0] for r in df.select(m.score()).collect()])
    column = dict(zip(quality_classifier.STATISTICS, x.T))
    total = m.intercept + sum(np.clip(column[n], low, high) * w for n, low, high, w in m.linear)
    for conditions, w in m.rules:
        total = total + w * np.all([column[n] <= at if side == "<=" else column[n] > at for n, side, at in conditions], 0)
    assert len(m.rules) > 1
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-total)), rtol=1e-12)
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.95


def test_classifier_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality_classifier.learn(edges, none)
    assert {r.score for r in quality_classifier.classify(edges, m).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (3, None), (999, 1), (4, 1)], "doc_id long, quality int")
    m = quality_classifier.learn(edges, labels)
    assert quality_classifier.classify(edges, m).count() == edges.count()
    assert quality_classifier.classify(empty, m).count() == 0


def test_rules_equal_sql(spark):
    assert not differences(quality_rules.query(spark, SF), connect(SF), quality_rules.ORACLE)


def test_rules_edges(spark, edges, empty):
    clash = edges.withColumn("n_words", F.lit(-1)).withColumn("_q_words", F.lit("x"))
    rows = {r.doc_id: r for r in quality_rules.apply_rules(clash).collect()}
    assert all(rows[i].n_words == 0 and not rows[i].kept for i in (0, 1, 2))
    assert (rows[10].n_words, rows[10].n_repeat_words, rows[10].kept) == (1600, 1600, False)
    assert quality_rules.apply_rules(empty).count() == 0


@pytest.mark.parametrize("num", [60, 80, 85, 95])
def test_match_threshold_follows_similarity(num):
    m = near_dedup.least_matches(num / 100, 64)
    below = lambda k: sum(math.comb(64, i) * (num / 100) ** i * (1 - num / 100) ** (64 - i) for i in range(k))
    assert below(m) <= 1e-7 < below(m + 1)


def test_near_stage_links_at_eight_tenths(spark):
    base = [f"w{k}" for k in range(300)]
    other = list(base)
    for k in range(6):
        other[25 + 50 * k] = f"new{k}"  # 296 shingles, 30 of them new: 266 / 326 = 0.816
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "another text of its own kind here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.stage(spark, df, SF).collect()) == [1, 3]


def test_near_duplicates_at_a_low_threshold(spark):
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(300)]
        other = list(base)
        for k in range(14):
            other[10 + 20 * k] = f"g{g}new{k}"  # 226 / 366 = 0.617
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=60).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import sentencepiece

    import corpus_pipeline

    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in quality_classifier.query(spark, SF).where("predicted = 1").collect()}
    near = brute_near({d: before[d].text for d in good}, num=80)
    left = sorted(d for d in good if near[d][1] == d)
    raw = [before[d].text.encode() for d in left]
    seen = Counter(b[i : i + suffix_dedup.PASSAGE] for b in raw for i in range(len(b) - suffix_dedup.PASSAGE + 1))
    kept = {}
    for d, b in zip(left, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - suffix_dedup.PASSAGE + 1):
            if seen[b[i : i + suffix_dedup.PASSAGE]] > 1:
                gone[i : i + suffix_dedup.PASSAGE] = True
        kept[d] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    rows = [(d, domain(before[d].source or ""), before[d].lang or "", before[d].source or "", len(tokens(kept[d]))) for d in left]
    copies = brute_copies(rows, mixing.Targets())
    judge = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    want = Counter({(d, before[d].lang, before[d].source, len(kept[d]), kept[d], tuple(judge.encode(kept[d]))): c for d, c in zip(left, copies) if c})
    out = corpus_pipeline.run(spark, SF)
    assert {*before[left[0]].__fields__, "ids", "n_tokens"} == set(out.columns)
    got = Counter((r.doc_id, r.lang, r.source, r.n_chars, r.text, tuple(r.ids)) for r in out.collect())
    assert len(left) > 50 and sum(len(kept[d]) < before[d].n_chars for d in left) > 3
    assert got == want


CLASHES = ["_row", "_q_x", "_uid", "_runs", "_copies", "_copy", "_same", "score", "predicted", "n_words", "a.b", "component", "set_key", "uid", "runs", "row", "same", "c0", "key", "copies", "tokens", "_n_bytes", "ids"]


def test_pipeline_stages_on_edges(spark, edges, empty):
    import corpus_pipeline

    odd = edges.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        plain, out = stage(spark, edges, SF), stage(spark, odd, SF)
        kept = [c for c in odd.columns if name != "sentencepiece" or c != "ids"]
        assert out.columns == [*kept, *(["ids", "n_tokens"] if name == "sentencepiece" else [])]
        assert plain.columns == [*edges.columns, *out.columns[len(kept) :]]
        rows = out.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())
        for r in rows:
            own = "none" if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c} of {own}" for c in CLASHES if c in kept)
        texts = Counter((r.doc_id, r.text) for r in rows)
        every = Counter((r.doc_id, r.text) for r in edges.collect())
        if name == "minhash_near_dedup":
            assert all(n == 1 for n in texts.values()) and set(texts) < set(every) and (6, EDGES[6]) not in texts and (None, "no id at all in this row") in texts
        elif name == "sentencepiece":
            assert texts == every
        elif name == "suffix_array_dedup":
            assert sum(texts.values()) == sum(every.values()) and {(r.doc_id, r.n_chars) for r in rows if r.doc_id == 8} == {(8, 0)}
        elif name == "quality_classifier":
            assert texts == +(texts & every)


def test_mixing_weights_of_any_name(spark, docs):
    odd = docs.withColumn("source", F.when(F.col("source") == "src0", "it's").when(F.col("source") == "src1", "a\\b").when(F.col("source") == "src2", "site12345678901").otherwise(F.col("source")))
    rows = mixing.mix(odd, mixing.Targets(sources={"it's": 0.0, "a\\b": 5.0}, languages={"de": 0.0})).collect()
    assert len(rows) == docs.count() and {r.domain for r in rows if r.source == "site12345678901"} == {"books"}
    assert all(r.copies == 0 for r in rows if r.lang == "de" or r.source == "it's")
    assert any(r.copies for r in rows if r.source == "a\\b")
    with pytest.raises(ValueError):
        mixing.Targets(domains={"web": -1.0})
