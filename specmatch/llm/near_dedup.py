"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of hashed word shingles; equal sets are one class (a key over the whole set), so copies never meet.
2. A class posts itself under each of its first ``coords - matches + 1`` (coordinate, value) pairs: two classes that
   agree in ``matches`` of ``coords`` coordinates share at least one of those lists (the prefix bound).
3. In a list, entries lie in order of set size; only entries whose sizes allow the similarity are compared (the
   rest is skipped), collisions of all coordinates are counted from compact signatures, and pairs at or above the match
   threshold are retained. A list returns a spanning forest of its retained pairs, never all of them. A list of more than ``LIST`` entries (the
   value of a very frequent shingle) is dealt again: a pair that meets there agrees in ``matches - 1`` of the other coordinates, so by
   the same bound it shares one of as many lists under a second coordinate and value.
4. Retained pairs make loose groups; within each, links are confirmed on the full sets until no unvisited
   member is left, and confirmed links give the components. A group of more than ``BLOCK`` members is dealt to blocks, each with the
   group's few pivots beside it; what has not joined the first pivot's component then meets every block, a block at a time. So any two
   members are compared, or already in one component, and no task holds a group.

A pair at the threshold is missed with a chance of 1e-7 at most, whatever the threshold, and nothing unconfirmed is linked.

Edge cases: null, empty or blank texts have an empty set and link with nothing; with fewer words than a shingle the
whole sequence is the only shingle; repeated rows and equal texts share a component; a null doc_id never names a component;
an empty table gives an empty result. ``near_duplicates`` reads two columns and returns its own; ``stage`` carries columns of any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmatch.llm.frames import plain, stored
from specmatch.llm.textvec import LOWER, U64, mix, pieces, prefix_hash, small_batches, span_hash, utf8, words
from specmatch.operators.components import connected_components
from specmatch.session import cut

#: Members of a loose group that are confirmed in one task, and pivots that join every block of a larger group.
BLOCK, PIVOTS = 256, 8
#: Entries of a posting list that is merged as it is: at most some 200 million comparisons of 64 bytes.
LIST = 20_000
_RNG = np.random.Generator(np.random.PCG64(88))
_ODD = [U64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 64)]


def shingle_sets(batch: pa.RecordBatch, at_col: int, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    data, at = utf8(batch.column(at_col))
    start, end, first = words(data, at)
    token = span_hash(prefix_hash(LOWER[data]), start, end)
    n = len(token)
    if n >= size:
        rolled = np.zeros(n - size + 1, U64)
        for k in range(size):
            rolled += token[k : n - size + 1 + k] * _ODD[k]
        rolled = mix(rolled)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= size:
            yield np.unique(rolled[low : high - size + 1])
        elif high > low:
            short = (token[low:high] * np.array(_ODD[: high - low], U64)).sum(keepdims=True)
            yield mix(short + U64(high - low))
        else:
            yield np.zeros(0, U64)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    with np.errstate(over="ignore"):
        return int(np.int64((mix(hashes + U64(0xA5A5A5A5)).sum() * U64(0xD6E8FEB86659FD93) + U64(len(hashes))).astype(np.int64)))


def signature(hashes: np.ndarray, coords: int) -> np.ndarray:
    odd = _multipliers(coords)
    low = np.full(coords, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(hashes), 512):
        part = hashes[k : k + 512, None] * odd[None, :]
        np.minimum(low, part.min(0), out=low)
    return low


def _multipliers(coords: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(4242)).integers(1, 1 << 63, coords, dtype=np.uint64) * U64(2) + U64(1)


def _lists(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, tuple | None]]:
    """Key and (nodes, sizes, signatures) of each posting list with two entries or more, from rows in order of key; of a list with more than
    ``most`` the key alone, and no more than ``most`` entries and a batch are held."""
    rest: list = []
    over = None
    for batch in batches:
        key = np.asarray(batch.column(0))
        if not len(key):
            continue
        cols = (key, np.asarray(batch.column(1)), np.asarray(batch.column(2)), _matrix(batch.column(3)))
        if over is not None:
            cols = tuple(c[key != over] for c in cols)
            if not len(cols[0]):
                continue
            over = None
        if rest:
            cols = tuple(np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True))
        key = cols[0]
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for low, high in zip(edges[:-2].tolist(), edges[1:-1].tolist(), strict=True):
            if high - low > 1:
                yield int(key[low]), None if most is not None and high - low > most else tuple(c[low:high] for c in cols[1:])
        rest = [c[edges[-2] :] for c in cols]
        if most is not None and len(rest[0]) > most:
            over = rest[0][0]
            rest = []
            yield int(over), None
    if rest and len(rest[0]) > 1:
        yield int(rest[0][0]), tuple(rest[1:])


def _matrix(column: pa.Array) -> np.ndarray:
    data, at = utf8(column)
    return data.reshape(len(column), -1)


def forest(nodes: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, matches: int, ratio: float) -> list[tuple[int, int]]:
    """A spanning forest of the list's pairs that collide in ``matches`` coordinates and whose sizes allow ``ratio``."""
    order = np.argsort(sizes, kind="stable")
    nodes, sizes, sigs = nodes[order], sizes[order], sigs[order]
    out, open_ = [], np.arange(len(nodes))
    while len(open_) > 1:
        queue = [open_[0]]
        open_ = open_[1:]
        while queue and len(open_):
            u = queue.pop()
            low = np.searchsorted(sizes[open_], sizes[u] * ratio - 1e-9, "left")
            high = np.searchsorted(sizes[open_], sizes[u] / ratio + 1e-9, "right")
            near = open_[low:high]
            hit = (sigs[near] == sigs[u]).sum(1) >= matches
            if hit.any():
                found = near[hit]
                out += [(int(nodes[u]), int(nodes[v])) for v in found]
                queue += found.tolist()
                open_ = np.concatenate([open_[:low], near[~hit], open_[high:]])
    return out


def confirm(keys: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links of one loose group: 100 * |A & B| >= 85 * |A | B| in whole numbers.

    Breadth first: each visited member is compared, through an inverted index of the group's shared shingles, with the
    members not yet visited; those it links to are never compared among themselves. Members whose shingles are the most
    common are visited first, since the text that copies derive from reaches most of them at once.
    """
    n = len(keys)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner_s = code[shared], owner[shared]
    weight = np.bincount(owner_s, count[code], n) / np.maximum(sizes, 1)
    by_doc = np.argsort(owner_s, kind="stable")
    doc_at = np.searchsorted(owner_s[by_doc], np.arange(n + 1))
    by_code = np.argsort(code, kind="stable")
    sorted_code = code[by_code]
    posting, post_at = owner_s[by_code], np.searchsorted(sorted_code, np.arange(len(count) + 1))
    visited, out = np.zeros(n, bool), []
    live = n

    def squeeze() -> None:
        """Drop visited members from the postings."""
        nonlocal posting, post_at, sorted_code, live
        keep = ~visited[posting]
        posting, sorted_code = posting[keep], sorted_code[keep]
        post_at = np.searchsorted(sorted_code, np.arange(len(count) + 1))
        live = int((~visited).sum())

    for root in np.argsort(-weight, kind="stable").tolist():
        if visited[root]:
            continue
        visited[root] = True
        queue = [root]
        while queue:
            u = queue.pop()
            own = code[by_doc[doc_at[u] : doc_at[u + 1]]]
            spans = [posting[post_at[c] : post_at[c + 1]] for c in own.tolist()]
            if not spans:
                continue
            both = np.bincount(np.concatenate(spans), minlength=n)
            both[visited] = 0
            hit = np.flatnonzero((both > 0) & (den * both >= num * (sizes + sizes[u] - both)))
            if len(hit):
                out += [(keys[u], keys[v]) for v in hit.tolist()]
                visited[hit] = True
                queue += hit.tolist()
                if (~visited).sum() < 0.7 * live:
                    squeeze()
    return out


def least_matches(ratio: float, coords: int, miss: float = 1e-7) -> int:
    """The most coordinates that a pair at similarity ``ratio`` fails to agree in with a chance of at most ``miss``."""
    below, m = 0.0, 0
    while m < coords and (below := below + math.comb(coords, m) * ratio**m * (1 - ratio) ** (coords - m)) <= miss:
        m += 1
    return max(m, 1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 85, den: int = 100, coords: int = 64, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``; ``set_key`` names the class of equal sets. Without
    ``matches`` the match threshold follows from ``num / den`` and ``coords``."""
    small_batches(docs.sparkSession)
    ratio = num / den
    matches = least_matches(ratio, coords) if matches is None else matches
    prefix = coords - matches + 1

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            keys, ns, sigs = [], [], []
            for s in shingle_sets(batch, 1, size):
                ns.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sigs.append((signature(s, coords) >> U64(32)).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(sign, "doc_id long, n_shingles long, set_key long, sig binary"))
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, coords + 1, dtype=np.uint64))
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                sig = _matrix(batch.column(2)).view("<u4")
                key = mix(sig[:, :prefix].astype(U64) * U64(0x9E3779B97F4A7C15) + salt[None, :prefix]).astype(np.int64)
                small = np.repeat((sig & 255).astype(np.uint8), prefix, 0)
                yield _posts(key.ravel(), *(np.repeat(np.asarray(batch.column(c)), prefix) for c in (0, 1)), small)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, node, coordinate) of what ``post`` posts."""
        salt = mix(np.arange(1, coords + 1, dtype=np.uint64))
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                sig = _matrix(batch.column(1)).view("<u4")
                key = mix(sig[:, :prefix].astype(U64) * U64(0x9E3779B97F4A7C15) + salt[None, :prefix]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), prefix)), pa.array(np.tile(np.arange(prefix, dtype=np.int32), len(key)))], names=["key", "node", "at"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries (key, coordinate, node, n, sig) of long lists under the other coordinates' values."""
        salt = mix(np.arange(1, coords + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                sig = _matrix(batch.column(4)).view("<u4")
                small = (sig & 255).astype(np.uint8)
                at = np.asarray(batch.column(1))
                others = np.arange(prefix)[None, :] + (np.arange(prefix)[None, :] >= at[:, None])  # the first ``prefix`` of the others
                others = np.minimum(others, coords - 1)
                value = np.take_along_axis(sig, others, 1).astype(U64)
                key = mix(mix(value * U64(0x9E3779B97F4A7C15) + salt[others]) + np.asarray(batch.column(0)).astype(U64)[:, None]).astype(np.int64)
                yield _posts(key.ravel(), *(np.repeat(np.asarray(batch.column(c)), prefix) for c in (2, 3)), np.repeat(small, prefix, 0))

    def merge(most: int | None):
        """Links (a, b) of the lists; for a list of more than ``most`` entries a row with its key and no b."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: set = set()
            for key, entries in _lists(batches, most):
                if entries is None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([None], pa.int64())], names=["a", "b"])
                    continue
                out.update(forest(*entries, matches, ratio))
                if len(out) > 100_000:
                    yield _pairs(out)
                    out = set()
            if out:
                yield _pairs(out)

        return run

    kind = "key long, node long, n long, sig binary"
    posts = classes.select(F.col("set_key").alias("node"), "n", "sig").mapInArrow(post, kind)
    merged = lambda rows, most: cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(merge(most), "a long, b long"))
    met = merged(posts, LIST)
    long = met.where("b IS NULL").select(F.col("a").alias("key"))
    if long.limit(1).count():
        places = classes.select(F.col("set_key").alias("node"), "sig").mapInArrow(place, "key long, node long, at int")
        dealt = places.join(long, "key").join(classes.select(F.col("set_key").alias("node"), "n", "sig"), "node").select("key", "at", "node", "n", "sig")
        met = met.where("b IS NOT NULL").unionByName(merged(dealt.mapInArrow(again, kind), None))
    loose = connected_components(met)
    wanted = cut(classes.select("set_key", "rep").join(loose, F.col("set_key") == F.col("node")).select(F.col("rep").alias("doc_id"), "set_key", "component"))
    pivots = [F.min_by("set_key", "doc_id"), *(F.min_by("set_key", F.xxhash64(F.lit(i), "set_key")) for i in range(PIVOTS - 1))]
    groups = wanted.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.array_distinct(F.array(*pivots)).alias("pivots"))
    groups = cut(groups.select("component", "blocks", "pivots", F.element_at("pivots", 1).alias("pivot")))
    wanted = wanted.join(groups, "component")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    wanted = wanted.select("doc_id", "set_key", "component", F.when(F.array_contains("pivots", F.col("set_key")), every(F.col("blocks"))).otherwise(F.array(own)).alias("to"), own.alias("own"), "blocks", "pivot")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            want, rows, sets = batch.column(2).to_pylist(), [], []
            for i, s in enumerate(shingle_sets(batch, 1, size)):
                if len(s) and set_key(s) == want[i]:
                    rows.append(i)
                    sets.append(s.astype("<u8").tobytes())
            if rows:
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*some.columns[2:], pa.array(sets, pa.binary())], names=["set_key", "component", "to", "own", "hashes"])

    sets = texts.join(wanted, "doc_id").select("doc_id", "text", "set_key", "component", "to", "own").mapInArrow(fetch, "set_key long, component long, to array<int>, own int, hashes binary")
    large = groups.where("blocks > 1")
    spread = bool(large.limit(1).count())
    if spread:
        sets = stored(sets)

    def settle(table: pa.Table) -> pa.Table:
        keys, members = [], []
        seen = set()
        for k, h in zip(table.column("set_key").to_pylist(), table.column("hashes").to_pylist(), strict=True):
            if k not in seen:  # rows repeated under one doc_id
                seen.add(k)
                keys.append(k)
                members.append(np.frombuffer(h, "<u8"))
        return pa.Table.from_batches([_pairs(confirm(keys, members, num, den))])

    links = sets.select("set_key", "component", "hashes", F.explode("to").alias("block")).groupBy("component", "block").applyInArrow(settle, "a long, b long")
    final = connected_components(links)
    if spread:
        label = final.select(F.col("node").alias("set_key"), F.col("component").alias("label"))
        members = wanted.where("blocks > 1").select("set_key", "component", "blocks", "pivot").join(label, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
        main = members.where("set_key = pivot").select("component", F.col("label").alias("main"))
        apart = members.join(main, "component").where("label != main").select("set_key", "component", "blocks").distinct()
        parts = apart.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
        apart = cut(apart.join(parts, "component").select("set_key", "component", F.pmod(F.xxhash64(F.lit("apart"), "set_key"), F.col("parts")).cast("int").alias("part"), "blocks"))
        few = apart.select("component", F.col("part"), F.explode(every(F.col("blocks"))).alias("block"), "set_key").join(sets.select("set_key", "hashes"), "set_key").select("set_key", "component", "hashes", "part", "block")
        some = apart.select("component", "part").distinct()
        rest = sets.select("set_key", "component", "hashes", F.col("own").alias("block")).join(some, "component").select("set_key", "component", "hashes", "part", "block")
        more = few.unionByName(rest).groupBy("component", "part", "block").applyInArrow(settle, "a long, b long")
        final = connected_components(more.unionByName(final.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = classes.select("set_key", "rep").join(final, F.col("set_key") == F.col("node"), "left").select("set_key", "rep", F.coalesce("component", "set_key").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = named.join(least, "root").select("set_key", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(member, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_key").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _posts(key: np.ndarray, node: np.ndarray, n: np.ndarray, small: np.ndarray) -> pa.RecordBatch:
    sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(small.shape[1]), len(small), [None, pa.py_buffer(small.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n), sig], names=["key", "node", "n", "sig"])


def _pairs(pairs) -> pa.RecordBatch:
    flat = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


#: Sets of shingles as text, all pairs that share one, and labels that spread along the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, lab) AS (SELECT a, a FROM e UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.node WHERE r.lab < e.b),
c AS (SELECT node, min(lab) AS lab FROM r GROUP BY node),
o AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.lab, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8: the one that names it. Rows repeated under one doc_id with one text stay once; rows
    with a null doc_id stay, since no other document can stand for them."""
    base, name = plain(docs)
    i, t = name["doc_id"], name["text"]
    keep = near_duplicates(base, i, t, num=80).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    found = base.join(keep, F.col(i).cast("long") == F.col("doc_id"), "left_semi").withColumn("same", F.xxhash64(t))
    once = found.withColumn("row", F.row_number().over(Window.partitionBy(i, "same").orderBy("same"))).where("row = 1")
    return once.select(*base.columns).unionByName(base.where(F.col(i).isNull())).toDF(*docs.columns)
