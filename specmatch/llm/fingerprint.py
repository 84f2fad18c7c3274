"""Document fingerprints by a randomised edit embedding.

A walk reads a text character by character; at step t it emits the character under it and moves on if a random bit
shared by all texts, chosen by (t, character), says so. Two texts' walks fall into step again after an edit, so edit
distance becomes Hamming distance between what the walks emit. A fingerprint samples bits of that emission: slot k keeps four
hashed bits of the character emitted at one step, and the step depends on the walk's length only, by the
record process of a random sequence: a slot of two walks with lengths L <= M samples the same step with probability
L / M. Fingerprints have a fixed size for texts of any length, and every step of a whole text may be sampled.

Edge cases: null and empty texts have the all-zero fingerprint; equal texts have equal fingerprints; a very long text
walks alone at constant memory besides its characters; repeated doc_ids follow each other in order of their
texts, null doc_ids come first; an only document is its own neighbour; an empty table gives an empty result; columns but doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.llm.textvec import U64, mix, pieces
from specmatch.session import cut, partitions

SLOTS = 256
SEED = 20_240_601
_BLOCK = 1 << 14
_STRIDE = 16
_END = 64
#: Code points walked together; bounds a worker's memory to a few hundred MB.
GROUP_CHARS = 4_000_000


def _records() -> dict[int, list[int]]:
    """Step -> slots that sample it. In a random sequence the step after N at which a new minimum comes exceeds m with
    probability N / m, so the latest minimum up to L is uniform on 1..L."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    at, out = np.ones(SLOTS, np.int64), {1: list(range(SLOTS))}
    while (alive := at < 1 << 40).any():
        u = rng.random(SLOTS)
        at = np.where(alive, (at / np.maximum(u, 1e-12)).astype(np.int64) + 1, at)
        for slot in np.flatnonzero(alive):
            out.setdefault(int(at[slot]), []).append(int(slot))
    return out


_state: dict = {}


def _bits(block: int) -> np.ndarray:
    """The shared random moves of one block of steps: a row per step, a column per character class (the last: the end, which never moves)."""
    cache = _state.setdefault("bits", {})
    if block not in cache:
        if len(cache) > 32:
            cache.clear()
        out = np.random.Generator(np.random.PCG64([SEED, block])).integers(0, 2, (_BLOCK, 65), dtype=np.uint8)
        out[:, _END] = 0
        cache[block] = out
    return cache[block]


def embed(texts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (a row of SLOTS four-bit values each) of texts given as code points."""
    sizes = np.array([len(t) for t in texts], np.int64)
    prints = np.zeros((len(texts), SLOTS), np.uint8)
    if not len(texts) or not sizes.max():
        return prints
    if "records" not in _state:
        _state["records"] = _records()
    records = _state["records"]
    code = np.zeros(int(sizes.sum()) + len(texts), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    for start, text in zip(starts, texts, strict=True):
        code[start : start + len(text)] = text
    kind = ((code * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)
    kind[starts + sizes] = _END
    rows = np.argsort(-sizes, kind="stable")
    rows = rows[sizes[rows] > 0]
    spot = starts[rows].copy()
    step = 0
    seen = np.empty((_STRIDE, len(rows)), np.uint8)
    while len(rows):
        bits = _bits(step // _BLOCK)
        base = step % _BLOCK
        window = seen[:, : len(rows)]
        for k in range(_STRIDE):
            under = window[k]
            kind.take(spot, out=under, mode="clip")
            slots = records.get(step + k + 1)
            if slots is not None:
                live = np.flatnonzero(under != _END)
                value = code[spot[live]].astype(U64) * U64(0x9E3779B97F4A7C15)
                for slot in slots:
                    prints[rows[live], slot] = (mix(value + U64(((step + k + 1) * 1_000_003 + slot * 7_919) & (2**64 - 1))) >> U64(60)).astype(np.uint8)
            spot += bits[base + k].take(under)
        step += _STRIDE
        on = window[-1] != _END
        if not on.all():
            rows, spot = rows[on], spot[on]
    return prints


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def to_hex(prints: np.ndarray) -> list[str]:
    packed = (prints[:, ::2] << 4) | prints[:, 1::2]
    return [row.tobytes().hex() for row in packed]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, less what chance gives: 0 to 1."""
    return np.clip(((a == b).mean(1) - 1 / 16) / (15 / 16), 0, 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", GROUP_CHARS):
            texts = [points(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(to_hex(embed(texts)))], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (pid, ahead, doc_id, text) in partitions that hold whole ranges of doc_id in order, each followed by a copy of
    the first row of the next range (after the last: of the first), marked ``ahead``. One shuffle of the texts; what
    the driver gets is a bounded number of quantiles and one doc_id per range."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("k"), "doc_id", "text").withColumn("d", F.col("k").cast("double"))
    wanted = min(20_000, parts or partitions(spark, 4))
    cuts = sorted(set(rows.approxQuantile("d", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)))) if wanted > 1 else []
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="d", outputCol="p").transform(rows).withColumn("pid", F.col("p").cast("int"))
    else:
        rows = rows.withColumn("pid", F.lit(0))
    heads = sorted((r.pid, r.k) for r in rows.groupBy("pid").agg(F.min("k").alias("k")).collect())  # at most ``wanted`` rows
    if not heads:
        return rows.select("pid", F.lit(False).alias("ahead"), "k", "doc_id", "text")
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    few = spark.createDataFrame([(k, p) for k, p in before.items()], "k long, prev int")
    places = F.array(F.struct(F.col("pid").alias("pid"), F.lit(False).alias("ahead")))
    twice = F.when(F.col("prev").isNotNull(), F.concat(places, F.array(F.struct(F.col("prev").alias("pid"), F.lit(True).alias("ahead"))))).otherwise(places)
    dealt = rows.join(F.broadcast(few), "k", "left").select("k", "doc_id", "text", F.explode(twice).alias("at"))
    return dealt.select("at.pid", "at.ahead", "k", "doc_id", "text").repartition(len(heads), "pid").sortWithinPartitions("pid", "ahead", "k", "text")


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the other text's first as many."""
    m = len(text) // 4
    return text[: len(text) - m] + other[:m]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document."""

    def work(group: list[tuple], ahead: str) -> pa.RecordBatch:
        texts = [t for _, t in group]
        after = [*texts[1:], ahead]
        changed = [edited(t, o) for t, o in zip(texts, after, strict=True)]
        n = len(texts)
        prints = embed([points(t) for t in [*texts, ahead, *changed]])
        own, next_, edit = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in group], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array(to_hex(own)), pa.array(to_hex(edit)), pa.array(likeness(own, edit)), pa.array(likeness(own, next_))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, now = 0, None
        for batch in pieces(batches, "text"):
            for pid, ahead, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                text = text or ""
                if pid != now:
                    now, closed = pid, False
                if ahead:
                    if not closed and group:
                        yield work(group, text)
                    group, size, closed = [], 0, True
                    continue
                if size + len(text) > GROUP_CHARS and group:
                    yield work(group, text)
                    group, size = [], 0
                group.append((doc_id, text))
                size += len(text)

    return in_order(docs.select("doc_id", "text")).mapInArrow(run, _OUT)


def _unpack(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(len(column), -1)
    return np.stack([packed >> 4, packed & 15], 2).reshape(len(column), -1)


def walk(ids: np.ndarray, prints: np.ndarray, least: float, band: int = 0, picks: list[list[int]] | None = None) -> Iterator[list[tuple[int, int, float]]]:
    """All pairs of a bucket at likeness ``least``, a member's at a time; a pair that already agrees in a band before this one
    is left to that band's bucket."""
    for u in range(len(ids) - 1):
        near = likeness(prints[u + 1 :], prints[u])
        hit = np.flatnonzero(near >= least)
        if band and len(hit):
            same = prints[u + 1 + hit] == prints[u]
            hit = hit[~np.any([same[:, p].all(1) for p in picks[:band]], axis=0)]
        if len(hit):
            yield [(max(int(ids[u]), int(ids[v])), min(int(ids[u]), int(ids[v])), float(x)) for v, x in zip(u + 1 + hit, near[hit], strict=True)]


def near_pairs(docs: DataFrame, least: float = 0.8, bands: int = 64, width: int = 8) -> DataFrame:
    """Near-duplicate classes by bit-sampled banding: ``width`` slots are a band's key, documents meet under (band,
    key), and all members of a bucket are compared: any two that meet and are alike are a pair, found in the first band
    where they meet. Equal fingerprints collapse first; all but the first document of a fingerprint are a pair with it.
    Returns doc_id, near_id (a smaller doc_id whose likeness is verified), likeness; a row without doc_id can name no pair."""
    prints = cut(fingerprints(docs.where("doc_id IS NOT NULL")))
    classes = prints.where("n_chars > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("doc"))
    # repeated ids may bring several fingerprints
    classes = cut(classes.select("doc", "fingerprint", F.xxhash64("fingerprint").alias("rep")))
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    picks = [sorted(rng.choice(SLOTS, width, replace=False).tolist()) for _ in range(bands)]
    keys = F.array(*[F.xxhash64(F.lit(b), F.concat(*[F.substring("fingerprint", s + 1, 1) for s in p])) for b, p in enumerate(picks)])
    posts = classes.select("rep", F.posexplode(keys).alias("band", "key"))
    met = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = posts.join(met, "key").join(classes, "rep").select("key", "doc", "fingerprint", "band")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), _unpack(batch.column(2)), np.asarray(batch.column(3)))
            cols = cols if rest is None else tuple(np.concatenate(x) for x in zip(rest, cols, strict=True))
            edges = np.concatenate([[0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1])
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield from batched(walk(cols[1][low:high], cols[2][low:high], least, int(cols[3][low]), picks))
            rest = tuple(c[edges[-1] :] for c in cols)
        if rest is not None:
            yield from batched(walk(rest[1], rest[2], least, int(rest[3][0]), picks))

    def batched(found: Iterator[list[tuple[int, int, float]]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, float]] = []
        for some in found:
            held += some
            if len(held) > 50_000:
                yield _links(held)
                held = []
        if held:
            yield _links(held)

    linked = members.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(verify, "doc_id long, near_id long, likeness double").where("doc_id != near_id").distinct()
    equal = prints.where("n_chars > 0").join(classes, "fingerprint").where("doc_id != doc").select("doc_id", F.col("doc").alias("near_id"), F.lit(1.0).alias("likeness"))
    return linked.unionByName(equal)


def _links(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, x = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.float64())], names=["doc_id", "near_id", "likeness"])


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
