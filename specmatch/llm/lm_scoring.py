"""LM scoring by an interpolated modified Kneser-Ney bigram model.

Counting: each task makes bigram counts of its texts and deals them, as sorted blobs, to shards by the hash of the
first word; a shard adds them up, writes its sorted hash arrays (bigram keys and counts; contexts with their total and
the number of followers seen once, twice, more often) into the shared folder, and passes on how often and after how
many different words each second word came. A second exchange adds those up into the word table. What the driver
gets are sums of a dozen numbers per shard, and which shards have files; a file that is missing later is an error. Scoring memory-maps the arrays and looks up the distinct words, contexts and bigrams of a
few megabytes of text at a time, so a worker's memory does not grow with the model.

Every probability interpolates: p(v|u) = max(c(u,v) - D(c), 0) / c(u) + gamma(u) p(v), where p(v) is the same over
continuation counts with 1 / (V + 1) below it, V + 1 counting one unknown word.

Edge cases: a null or empty text is one end token; a null doc_id counts as held out; long texts are whole; with
no training text at all every token has the uniform probability 1 / (V + 1) = 1. Equal texts have equal scores; an empty table gives an
empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.llm import shared_files
from specmatch.llm.textvec import LOWER, U64, mix, pieces, prefix_hash, span_hash, utf8, words
from specmatch.session import partitions, temporary

BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
_FLUSH = 1_500_000
_STATS = ("n1", "n2", "n3", "n4", "tokens", "types", "m1", "m2", "m3", "m4", "vocabulary")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token) hashes of every token of a batch, ends included, and the first token of each text (n + 1)."""
    data, at = utf8(column)
    start, end, first = words(data, at)
    token = np.insert(span_hash(prefix_hash(LOWER[data]), start, end), first[1:], END)
    first = first + np.arange(len(first))
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = BEGIN
    return before, token, first


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * U64(0x9E3779B97F4A7C15) + v)


def _sum_up(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal keys once, in order, with the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _deal(shards: int, by: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, blobs): the columns cut by ``by % shards``."""
    shard = (by % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    cut = [c[order] for c in columns]
    rows = [(s, *(c[edges[s] : edges[s + 1]].tobytes() for c in cut)) for s in range(shards) if edges[s + 1] > edges[s]]
    if rows:
        yield _rows(rows, kind)


def _rows(rows: list[tuple], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["shard", "kind", "a", "b", "c"])


_BLOBS = "shard int, kind int, a binary, b binary, c binary"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, bytes, bytes]]]]:
    now, group = None, []
    for batch in batches:
        for shard, kind, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now != (shard, kind):
                yield *now, group
                group = []
            now = (shard, kind)
            group.append(tuple(blobs))
    if now is not None:
        yield *now, group


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist()


@dataclass(frozen=True)
class Model:
    """Where the sorted arrays are, and the sums over them."""

    folder: str
    shards: int
    stats: dict[str, int]
    files: frozenset[str]  # such as bigram-3, word-0

    def discounts(self, prefix: str) -> np.ndarray:
        """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more; kept inside (0, count) where counts are few."""
        n1, n2, n3, n4 = (self.stats[f"{prefix}{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))])


def train(docs: DataFrame) -> Model:
    """A model of ``docs`` (doc_id, text), counted in one Spark job."""
    spark = docs.sparkSession
    shards = partitions(spark)
    folder = temporary(spark, "kn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            (u, v), (c,) = _sum_up((np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), (np.concatenate([h[2] for h in held]),))
            yield from _deal(shards, u, [u, v, c.astype(np.uint32)], 0)

        for batch in pieces(batches, "text"):
            u, v, _ = bigrams(batch.column(0))
            held.append((u, v, np.ones(len(u), np.uint64)))
            size += len(u)
            if size > _FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def add_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, group in _by_shard(batches):
            u, v = (np.concatenate([np.frombuffer(g[k], np.uint64) for g in group]) for k in (0, 1))
            c = np.concatenate([np.frombuffer(g[2], np.uint32) for g in group]).astype(np.uint64)
            del group
            (u, v), (c,) = _sum_up((u, v), (c,))
            at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            per_context = np.stack([np.add.reduceat(x, at) for x in (c, (c == 1).astype(np.uint64), (c == 2).astype(np.uint64), (c > 2).astype(np.uint64))], 1)
            key = pair_key(u, v)
            order = np.argsort(key)
            counts = _small(c[order])
            shared_files.write(f"{folder}/bigram-{shard}", [np.array([len(key), counts.itemsize, len(at)], np.uint64), key[order], u[at], per_context, counts])
            stats = [*_counts_of_counts(c), int(c.sum()), len(c), 0, 0, 0, 0, 0]
            (w,), (cw, nw) = _sum_up((v,), (c, np.ones(len(v), np.uint64)))
            yield from _deal(shards, w, [w, _wide(cw), _wide(nw)], 1)
            yield _rows([(shard, np.array(stats, np.int64).tobytes(), b"", b"")], 2)

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, files = [], []
        for shard, kind, group in _by_shard(batches):
            if kind == 2:
                out += [np.frombuffer(g[0], np.int64) for g in group]
                files.append(f"bigram-{shard}")
                continue
            files.append(f"word-{shard}")
            w = np.concatenate([np.frombuffer(g[0], np.uint64) for g in group])
            c, n = (np.concatenate([np.frombuffer(g[k], np.uint32) for g in group]).astype(np.uint64) for k in (1, 2))
            (w,), (c, n) = _sum_up((w,), (c, n))
            shared_files.write(f"{folder}/word-{shard}", [np.array([len(w)], np.uint64), w, c, n])
            out.append(np.array([0, 0, 0, 0, 0, 0, *_counts_of_counts(n), len(w)], np.int64))
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array([int(x)]) for x in np.sum(out, 0)), pa.array([files])], names=[*_STATS, "files"])

    blobs = docs.select("text").mapInArrow(count, _BLOBS)
    parts = blobs.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(add_bigrams, _BLOBS)
    sums = parts.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(add_words, ", ".join(f"{n} long" for n in _STATS) + ", files array<string>")
    got = sums.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _STATS], F.flatten(F.collect_list("files")).alias("files")).first().asDict()
    return Model(folder, shards, {n: got[n] for n in _STATS}, frozenset(got["files"]))


def _wide(counts: np.ndarray) -> np.ndarray:
    if len(counts) and counts.max() > np.iinfo(np.uint32).max:
        raise OverflowError("one task counted a word more than 2**32 times")
    return counts.astype(np.uint32)


class Scorer:
    """Looks up a model's memory-mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}
        s = model.stats
        self.d2, self.d1 = model.discounts("n"), model.discounts("m")
        self.total, self.types, self.vocabulary = s["tokens"], s["types"], s["vocabulary"]
        # mass the continuation counts leave to the uniform distribution
        m1, m2 = s["m1"], s["m2"]
        self.rest = (self.d1[1] * m1 + self.d1[2] * m2 + self.d1[3] * (self.vocabulary - m1 - m2)) / self.types if self.types else 1.0

    def _open(self, kind: str, shard: int) -> tuple | None:
        if (kind, shard) not in self.files:
            if f"{kind}-{shard}" not in self.model.files:  # no word fell to this shard
                self.files[kind, shard] = None
                return None
            raw = shared_files.mapped(f"{self.model.folder}/{kind}-{shard}")
            if kind == "word":
                n = int(raw[:8].view(np.uint64)[0])
                self.files[kind, shard] = tuple(raw[8 + 8 * n * k : 8 + 8 * n * (k + 1)].view(np.uint64) for k in range(3))
            else:
                n, width, contexts = (int(x) for x in raw[:24].view(np.uint64))
                key = raw[24 : 24 + 8 * n].view(np.uint64)
                at = 24 + 8 * n
                context = raw[at : at + 8 * contexts].view(np.uint64)
                at += 8 * contexts
                totals = raw[at : at + 32 * contexts].view(np.uint64).reshape(-1, 4)
                at += 32 * contexts
                self.files[kind, shard] = (key, context, totals, raw[at : at + width * n].view(f"u{width}"))
        return self.files[kind, shard]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def words(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and continuation counts of distinct words."""
        c, n = np.zeros(len(v), np.uint64), np.zeros(len(v), np.uint64)
        shard = (v % U64(self.model.shards)).astype(np.int64)
        for s in np.unique(shard):
            if (file := self._open("word", int(s))) is not None:
                rows = np.flatnonzero(shard == s)
                at, hit = self._find(file[0], v[rows])
                c[rows[hit]], n[rows[hit]] = file[1][at[hit]], file[2][at[hit]]
        return c, n

    def pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct bigrams, sorted by their key, and their contexts' totals."""
        c, totals = np.zeros(len(u), np.uint64), np.zeros((len(u), 4), np.uint64)
        shard = (u % U64(self.model.shards)).astype(np.int64)
        key = pair_key(u, v)
        order = np.argsort(shard, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            if (file := self._open("bigram", int(shard[rows[0]]))) is not None:
                at, hit = self._find(file[0], key[rows])
                c[rows[hit]] = file[3][at[hit]]
                mine, back = np.unique(u[rows], return_inverse=True)
                at, hit = self._find(file[1], mine)
                found = np.where(hit[:, None], file[2][at] if len(file[2]) else 0, 0)
                totals[rows] = found[back]
        return c, totals

    def log10(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p(v|u), the count of v and that of the bigram, for each token."""
        distinct, word_of = np.unique(v, return_inverse=True)
        count, continuation = self.words(distinct)
        lower = self.rest / (self.vocabulary + 1)
        if self.types:
            lower = lower + np.maximum(continuation - self.d1[np.minimum(continuation, 3).astype(np.int64)], 0) / self.types
        lower = np.broadcast_to(lower, len(distinct))
        _, first, pair_of = np.unique(pair_key(u, v), return_index=True, return_inverse=True)
        c, totals = self.pairs(u[first], v[first])
        low, whole = lower[word_of[first]], totals[:, 0].astype(float)
        seen = whole > 0
        bottom = np.where(seen, whole, 1)
        gamma = np.where(seen, (totals[:, 1:] @ self.d2[1:]) / bottom, 1)
        p = np.maximum(c - self.d2[np.minimum(c, 3).astype(np.int64)], 0) / bottom + gamma * low
        return np.log10(p)[pair_of], count[word_of], c[pair_of]


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity and n_rare_pairs of every text. No shuffle.

    ``n_rare_pairs`` is the number of tokens whose bigram the training texts have once at most: of a training text that occurs once most
    bigrams of rare words are its own, of one that occurs twice none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _scorers:
            _scorers.clear()
            _scorers[model.folder] = Scorer(model)
        s = _scorers[model.folder]
        bottom = np.log10(s.total + s.vocabulary + 1)
        for batch in pieces(batches, "text"):
            u, v, first = bigrams(batch.column(1))
            logs, counts, pairs = s.log10(u, v)
            low = first[:-1]
            n = np.diff(first)
            total = np.add.reduceat(logs, low)
            base = np.add.reduceat(np.log10(counts.astype(float) + 1) - bottom, low)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), low)), pa.array(base), pa.array(total), pa.array(10 ** (-total / n)), pa.array(np.add.reduceat((pairs < 2).astype(np.int64), low))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity", "n_rare_pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double, n_rare_pairs long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.stats["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity", "n_rare_pairs")
