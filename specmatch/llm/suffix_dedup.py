"""Suffix-array dedup: remove every byte of a string of a window's bytes that also starts elsewhere in the corpus.

Two windows are used. The contract of the query fixes ``WINDOW``, 400 bytes. The pipeline's stage removes passages of some 50 words: of
51 words in a row of the test prose, 99 in 100 have 243 bytes or more and half have fewer than 320, so 400 bytes miss most of them and the stage takes
``PASSAGE``, 240 bytes. ``digests`` gives the figures of both: a window of 400 bytes that repeats lies in a run of repeated windows of
240, so the second search looks at such runs only.

1. Sampling: every window of 400 (240) bytes chooses the 64-byte (32-byte) substring in it with the least hash, its anchor (a choice by
   content, so equal windows choose equal anchors at equal offsets). Neighbouring windows share an anchor; together they
   cover a span. About one position in 170 (105) is an anchor.
2. Naming: equal spans get equal names (64 bits of the anchor's hash and 64 of the span's), counted by Spark. A span that occurs twice is
   repeated as a whole; an anchor whose content occurs once has no repeated window. Neither is sorted. Equal spans that follow
   each other (a phrase said over and over) are one row with their number, so periodic text costs a row, not one a period.
3. Sorting: what is left are different spans about equal anchors, a part of the text. They are dealt by anchor content, so equal
   windows meet; parts whose core occurs in one span only are left out, and the suffixes of the rest are put in order
   by external induced sorting (``induced_sort``), whose common-prefix values of a window mark the repeated ones. An anchor with more than
   ``SPANS`` different spans (a passage in very many documents) would be one task's: its windows are named one by one instead and
   counted by Spark.
4. Marked windows go back to their documents, are merged to maximal runs, and their bytes are removed.

All occurrences are removed, the first too; strings are judged on the input. Equality is that of both
hashes in step 2 and of 64-bit substring hashes in the sorter's common prefixes. Each step is a table in the shared folder; shuffle files of a
step go when it is written, and tables that no later step reads are deleted.

Edge cases: null counts as empty; texts under a window are untouched; repeated rows are repeated text and are removed; texts
of any length are cut into segments that overlap by a window; runs may begin or end inside a character, in
which case ``text`` drops the broken character and ``kept_sha256`` counts the bytes as they are; an empty table gives an empty result; other columns of
the input, whatever their names, are carried by ``removed`` (but its own four, which are replaced) and by ``stage``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmatch.llm.frames import drop, plain, stored
from specmatch.llm.induced_sort import suffix_order
from specmatch.llm.textvec import U64, pieces, prefix_hash, small_batches, span_hash, utf8
from specmatch.session import partitions

#: Bytes of the contract's window and of a passage, and of their anchors.
WINDOW, GRAM = 400, 64
PASSAGE, PASSAGE_GRAM = 240, 32
_SEGMENT = 1 << 20
_LOW = U64((1 << 22) - 1)
#: Different spans of an anchor that are sorted together: some 4 MB, of which the sorter holds about 80 times as much.
SPANS = 8192
#: Parts of an anchor's window offsets whose cores are compared before sorting.
_PARTS = 8
#: A span's place in one number: its first window (31 bits), times it follows itself (14), number of windows (9) and anchor's offset (9).
_FIRST, _TIMES = 32, 18
_MOST_TIMES = (1 << 14) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, blocks = len(x), -(-len(x) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def spans(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM, within: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, offset of the anchor in the first window, anchor's hash) of each span; positions are in ``data``.
    With ``within`` only the windows in these runs (low, high) count, else those in each text."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, np.zeros(0, U64)
    start = np.arange(len(data) - gram + 1)
    value = span_hash(prefix_hash(data), start, start + gram)
    least = _sliding_min((value & ~_LOW) | start.astype(U64), window - gram + 1)
    anchor = (least & _LOW).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)
    low, high = (at[:-1], at[1:]) if within is None else within
    fits = high - low >= window
    np.add.at(inside, low[fits], 1)
    np.add.at(inside, high[fits] - window + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[:-1])
    if not len(p):
        return none, none, none, none, np.zeros(0, U64)
    text = np.searchsorted(at, p, "right") - 1
    a = anchor[p]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1)]))
    first = p[new]
    return text[new], first, np.diff(np.append(new, len(p))), a[new] - first, value[a[new]]


def _segments(batches: Iterator[pa.RecordBatch], column: str, window: int = WINDOW) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Batches with their bytes; a very long text comes in segments (the last value is where one begins) that share a window."""
    for batch in pieces(batches, column):
        data, at = utf8(batch.column(batch.schema.get_field_index(column)))
        if len(data) <= 2 * _SEGMENT - window:
            yield batch, data, at, 0
            continue
        for i in range(batch.num_rows):
            own = data[at[i] : at[i + 1]]
            for low in range(0, max(1, len(own) - window + 1), _SEGMENT):
                part = own[low : low + _SEGMENT + window - 1]
                yield batch.slice(i, 1), part, np.array([0, len(part)]), low


def _within(runs: pa.Array, at: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' runs as positions in a segment that begins at ``base``."""
    own = np.repeat(np.arange(len(runs)), np.asarray(runs.value_lengths().fill_null(0)))
    flat = runs.flatten()
    low, high = (np.asarray(flat.field(k)) - base + at[own] for k in ("lo", "hi"))
    return np.maximum(low, at[own]), np.minimum(high, at[own + 1])


def _runs(text: np.ndarray, first: np.ndarray, n: np.ndarray, key: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that begin a run of equal spans, each where the one before ends, and the length of the run (longer runs than a place can hold are several)."""
    same = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (name[1:] == name[:-1]) & (n[1:] == n[:-1]) & (first[1:] == (first + n)[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    rank = np.arange(len(text)) - np.repeat(start, np.diff(np.append(start, len(text))))
    head = np.flatnonzero(rank % _MOST_TIMES == 0)
    return head, np.diff(np.append(head, len(text)))


def _name(window: int, gram: int):
    """Rows of (uid, text), or (uid, text, runs) to look at, to named spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at, base in _segments(batches, "text", window):
            within = _within(batch.column(2), at, base) if batch.num_columns > 2 else None
            text, first, n, offset, key = spans(data, at, window, gram, within)
            if not len(text):
                continue
            view = memoryview(np.ascontiguousarray(data))
            name = np.array([xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), (first + n + window - 1).tolist(), strict=True)], U64)
            uid = np.asarray(batch.column(0))[text]
            head, times = _runs(text, first, n, key, name)
            place = (first - at[text] + base)[head] << _FIRST | times << _TIMES | n[head] << 9 | offset[head]
            yield pa.RecordBatch.from_arrays([pa.array(uid[head]), pa.array(key[head].astype(np.int64)), pa.array(name[head].astype(np.int64)), pa.array(place)], names=["uid", "key", "name", "place"])

    return run


def _contexts(window: int):
    """(uid, text, [(key, c, lo, n, off, many)]) to a row for each span, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            lists = batch.column(2)
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            lo, n = np.asarray(flat.field("lo")), np.asarray(flat.field("n"))
            begin = at[owner] + lo
            ctx = [raw[b:e] for b, e in zip(begin.tolist(), (begin + n + window - 1).tolist(), strict=True)]
            for low in range(0, len(ctx), 4096):
                part = slice(low, low + 4096)
                yield pa.RecordBatch.from_arrays([flat.field("key")[part], pa.array(np.asarray(batch.column(0))[owner[part]]), flat.field("c")[part], flat.field("lo")[part], flat.field("n")[part], flat.field("off")[part], pa.array(ctx[part], pa.binary()), flat.field("many")[part]], names=["key", "uid", "c", "lo", "n", "off", "ctx", "many"])

    return run


def _windows_of(window: int):
    """Rows of spans to (key, name, uid, c, lo) of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ctx", 1 << 16):
            data, at = utf8(batch.column(6))
            n = np.asarray(batch.column(4))
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = at[row] + step
            name = span_hash(prefix_hash(data), begin, begin + window).astype(np.int64)
            key, uid, c, lo = (np.asarray(batch.column(k))[row] for k in (0, 1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(uid), pa.array(c), pa.array(lo + step)], names=["key", "name", "uid", "c", "lo"])

    return run


def repeated(key: np.ndarray, n: np.ndarray, off: np.ndarray, data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (span, first window, last window) of windows of the given spans that equal another window of them.

    Spans are different from each other; span i's bytes are ``data[at[i]:at[i+1]]`` and its windows start at its first ``n[i]`` bytes.
    """
    width = -(-(window - gram + 1) // _PARTS)
    prefix = prefix_hash(data)
    anchor = at[:-1] + off
    live = np.zeros((len(n), _PARTS), bool)
    for k in range(_PARTS):  # windows that begin k * width up to (k + 1) * width - 1 bytes before the anchor share this core
        near, far = k * width, (k + 1) * width - 1
        has = (off >= near) & (off - n + 1 <= far)
        # the span's own windows may be fewer: only the bytes that all of its windows of this part surely cover
        low, high = anchor - near, anchor + window - far
        whole = np.flatnonzero(has & (low >= at[:-1]) & (high <= at[1:]))
        if len(whole):
            code = span_hash(prefix, low[whole], high[whole]) ^ key[whole].astype(U64)
            _, back, count = np.unique(code, return_inverse=True, return_counts=True)
            live[whole, k] = count[back] > 1
    runs = []
    grown = np.zeros((len(n), _PARTS + 2), np.int8)
    grown[:, 1:-1] = live
    step = np.diff(grown, axis=1)
    rows, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    # parts first..last-1: windows that begin (last * width - 1) down to first * width before the anchor
    low = np.maximum(0, off[rows] - (last * width - 1))
    high = np.minimum(n[rows] - 1, off[rows] - first * width)
    good = low <= high
    rows, low, high = rows[good], low[good], high[good]
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none
    begin, size = at[rows] + low, high - low + window
    place = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(int(place[-1]) + 1, np.uint16)
    text[place[1:] - 1] = 1
    spot = np.arange(int(place[-1]))
    run = np.repeat(np.arange(len(rows)), size + 1)
    within = spot - place[run]
    body = within < size[run]
    text[spot[body]] = data[(begin[run] + within)[body]].astype(np.uint16) + 2
    order, common = suffix_order(text, window)
    start = np.zeros(len(text), bool)
    start[spot[within < (high - low + 1)[run]]] = True
    of = start[order]
    ranks = np.flatnonzero(of)
    # least common prefix between each window and the window before it in the order
    between = np.minimum.reduceat(common, np.concatenate([[0], ranks[:-1] + 1])) if len(ranks) > 1 else np.zeros(len(ranks), np.int16)
    equal = np.zeros(len(ranks) + 1, bool)
    if len(ranks) > 1:
        edges = np.concatenate([ranks[:-1] + 1, ranks[-1:] + 1])
        between = np.minimum.reduceat(np.append(common, np.int16(0)), edges)[:-1]
        equal[1:-1] = between >= window
    marked = np.zeros(len(text), bool)
    marked[order[ranks[equal[1:] | equal[:-1]]]] = True
    hit = np.flatnonzero(marked)
    if not len(hit):
        return none, none, none
    new = np.concatenate([[True], (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])])
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    r = run[first]
    return rows[r], low[r] + first - place[r], low[r] + last - place[r]


def _sort(window: int, gram: int, limit: int = 1 << 20):
    """Rows of spans in order of key to runs of repeated windows of the spans that occur once. Whole keys are sorted together, several at a time."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.set_column(6, "ctx", table.column(6).cast(pa.large_binary()))  # 64-bit offsets: a key of any size is one array
        (batch,) = table.combine_chunks().to_batches() or [None]
        if batch is None:
            return
        data, at = utf8(batch.column(6))
        c, lo, n, off = (np.asarray(batch.column(k)) for k in (2, 3, 4, 5))
        span, first, last = repeated(np.asarray(batch.column(0)), n.astype(np.int64), off.astype(np.int64), data, at, window, gram)
        once = c[span] == 1
        span, first, last = span[once], first[once], last[once]
        if len(span):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(1))[span]), pa.array(lo[span] + first), pa.array(lo[span] + last + window)], names=["uid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in pieces(batches, "ctx", limit):
            key = np.asarray(batch.column(0))
            held.append(batch)
            size += int(utf8(batch.column(6))[1][-1])
            if size < limit:
                continue
            edge = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if not edge:
                if len(held) > 1 and np.asarray(held[-2].column(0))[-1] != key[0]:  # a key begins with this batch
                    yield from flush(held[:-1])
                    held, size = [batch], int(utf8(batch.column(6))[1][-1])
                continue  # one key goes on; its suffixes may well outgrow memory, the sorter's queues then lie on disk
            yield from flush([*held[:-1], batch.slice(0, edge)])
            held = [batch.slice(edge)]
            size = int(utf8(held[0].column(6))[1][-1])
        if held:
            yield from flush(held)

    return run


def repeated_intervals(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(uid, lo, hi) byte intervals that repeated windows cover, from rows (uid, text) or (uid, text, runs to look at). Intervals may overlap."""
    named = stored(texts.mapInArrow(_name(window, gram), "uid long, key long, name long, place long"))
    lo, n, off = F.shiftright("place", _FIRST), F.shiftright("place", 9).bitwiseAND(F.lit(511)), F.col("place").bitwiseAND(F.lit(511))
    times = F.shiftright("place", _TIMES).bitwiseAND(F.lit(_MOST_TIMES))
    # first() takes uid and place from one row
    counted = stored(named.groupBy("key", "name").agg(F.sum(times).alias("c"), F.first("uid").alias("uid"), F.first("place").alias("place")))
    whole = stored(named.join(counted.where("c > 1").select("key", "name"), ["key", "name"]).select("uid", lo.alias("lo"), (lo + n * times + F.lit(window - 1)).alias("hi")))
    drop(named)
    keys = counted.groupBy("key").agg(F.count("*").alias("d"), F.min("c").alias("least")).where("d > 1 AND least = 1").select("key", (F.col("d") > SPANS).alias("many"))
    open_ = counted.join(keys, "key").select("uid", F.struct("key", "c", lo.alias("lo"), n.alias("n"), off.alias("off"), "many").alias("span")).groupBy("uid").agg(F.collect_list("span").alias("spans"))
    contexts = stored(texts.select("uid", "text").join(open_, "uid").select("uid", "text", "spans").mapInArrow(_contexts(window), "key long, uid long, c long, lo long, n long, off long, ctx binary, many boolean"))
    drop(counted)
    found = whole
    if contexts.where("many").limit(1).count():
        one = stored(contexts.where("many").mapInArrow(_windows_of(window), "key long, name long, uid long, c long, lo long"))
        twice = one.groupBy("key", "name").agg(F.count("*").alias("k")).where("k > 1").select("key", "name")
        found = found.unionByName(stored(one.where("c = 1").join(twice, ["key", "name"]).select("uid", "lo", (F.col("lo") + window).alias("hi"))))
        drop(one)
    sorted_ = stored(contexts.where("NOT many").drop("many").repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_sort(window, gram), "uid long, lo long, hi long"))
    drop(contexts)
    return found.unionByName(sorted_)


def _uid(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _by_text(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a text's intervals."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)].tolist(), strict=True))


def _bodies(batch: pa.RecordBatch, text: int, runs: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each row's bytes and maximal runs."""
    data, at = utf8(batch.column(text))
    raw, lists = data.tobytes(), batch.column(runs)
    flat = lists.flatten()
    lo, hi = np.asarray(flat.field("lo")), np.asarray(flat.field("hi"))
    edges = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
    for i in range(batch.num_rows):
        yield raw[at[i] : at[i + 1]], _merged(lo[edges[i] : edges[i + 1]], hi[edges[i] : edges[i + 1]])


def _without(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, cursor = [], 0
    for low, high in runs:
        out.append(body[cursor:low])
        cursor = high
    return b"".join([*out, body[cursor:]])


def _length(runs: list[tuple[int, int]]) -> int:
    return sum(high - low for low, high in runs)


NEW = ("_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes gone from its text, and _n_bytes, _n_removed, _n_spans, _kept_sha256."""
    small_batches(docs.sparkSession)
    base, name = plain(docs, NEW)
    columns, at = base.columns, base.columns.index(name[text_col])
    base = base.withColumn("uid", _uid(name[id_col], name[text_col]))
    texts = base.select("uid", F.coalesce(F.col(name[text_col]), F.lit("")).alias("text"))
    joined = base.join(_by_text(repeated_intervals(texts, window, gram)), "uid", "left").select(*columns, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, columns[at]):
            nulls = batch.column(at).is_null().to_pylist()
            out = [(len(body), _length(runs), len(runs), _without(body, runs)) for body, runs in _bodies(batch, at, len(columns))]
            text = pa.array([None if none else x[3].decode("utf-8", "ignore") for none, x in zip(nulls, out, strict=True)], pa.string())
            sizes = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(text if j == at else batch.column(j) for j in range(len(columns))), *sizes, pa.array([hashlib.sha256(x[3]).hexdigest() for x in out])], names=[*columns, *NEW])

    schema = T.StructType([*base.select(*columns).schema.fields, *(T.StructField(k, T.LongType()) for k in NEW[:3]), T.StructField(NEW[3], T.StringType())])
    return joined.mapInArrow(run, schema).toDF(*(c for c in docs.columns if c not in NEW), *NEW)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256 at ``WINDOW``, and n_passage_bytes and n_passages, the bytes and maximal
    runs that repeated windows of ``PASSAGE`` bytes cover."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), _uid(id_col, text_col).alias("uid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = _by_text(repeated_intervals(texts.select("uid", "text"), PASSAGE, PASSAGE_GRAM))
    kind = texts.schema["id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in pieces(batches, "text"):
            rows = [(body, runs, [{"lo": a, "hi": b} for a, b in runs if b - a >= WINDOW]) for body, runs in _bodies(batch, 2, 3)]
            known = [(len(body), _length(runs), len(runs)) for body, runs, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array([x[k] for x in known], pa.int64()) for k in range(3)),
                    pa.array([None if long else hashlib.sha256(body).hexdigest() for body, _, long in rows], pa.string()),
                    pa.array([body.decode() if long else None for body, _, long in rows], pa.string()),
                    pa.array([long or None for _, _, long in rows], place),
                ],
                names=["id", "uid", "n_bytes", "n_passage_bytes", "n_passages", "sha", "text", "runs"],
            )

    found = stored(texts.join(short, "uid", "left").select("id", "uid", "text", "runs").mapInArrow(first, f"id {kind}, uid long, n_bytes long, n_passage_bytes long, n_passages long, sha string, text string, runs array<struct<lo:long,hi:long>>"))
    some = found.where("text IS NOT NULL")
    long = _by_text(repeated_intervals(some.select("uid", "text", "runs"), WINDOW, GRAM))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = [(_length(runs), len(runs), hashlib.sha256(_without(body, runs)).hexdigest()) for body, runs in _bodies(batch, 4, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in out], pa.int64()) for k in range(2)), pa.array([x[2] for x in out], pa.string()), batch.column(2), batch.column(3)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"])

    rest = found.where("text IS NULL").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), "n_passage_bytes", "n_passages")
    judged = some.drop("runs").join(long, "uid", "left").select("id", "n_bytes", "n_passage_bytes", "n_passages", "text", "runs").mapInArrow(last, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")
    return rest.unionByName(judged).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _windows(n: int, k: int) -> str:
    """SQL of the maximal runs r{k} (lo, hi from 1) that windows of ``n`` bytes which occur twice cover: every window, one by one."""
    return f"""p{k} AS (SELECT rid, unnest(range(1, size - {n - 2})) AS p FROM d WHERE size >= {n}),
h{k} AS (SELECT d.rid, p, md5(x[p:p + {n - 1}]) AS h FROM p{k} JOIN d ON d.rid = p{k}.rid),
t{k} AS (SELECT rid, p FROM h{k} WHERE h IN (SELECT h FROM h{k} GROUP BY h HAVING count(*) > 1)),
s{k} AS (SELECT rid, p, CASE WHEN p > lag(p) OVER o + {n} OR lag(p) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM t{k} WINDOW o AS (PARTITION BY rid ORDER BY p)),
i{k} AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM s{k}),
r{k} AS (SELECT rid, run, min(p) AS lo, max(p) + {n - 1} AS hi FROM i{k} GROUP BY rid, run)"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
{_windows(WINDOW, 1)},
{_windows(PASSAGE, 2)},
k1 AS (SELECT d.rid, run, x, lo, hi, size, lead(lo) OVER (PARTITION BY d.rid ORDER BY run) AS after FROM r1 JOIN d ON d.rid = r1.rid),
f1 AS (SELECT rid, count(*) AS n, sum(hi - lo + 1) AS gone, string_agg(CASE WHEN run = 1 THEN hex(x[1:lo - 1]) ELSE '' END || hex(x[hi + 1:coalesce(after - 1, size)]), '' ORDER BY run) AS kept FROM k1 GROUP BY rid),
f2 AS (SELECT rid, count(*) AS n, sum(hi - lo + 1) AS gone FROM r2 GROUP BY rid)
SELECT doc_id, size AS n_bytes, CAST(coalesce(f1.gone, 0) AS BIGINT) AS n_removed, coalesce(f1.n, 0) AS n_spans, CASE WHEN f1.rid IS NULL THEN sha256(x) ELSE sha256(unhex(kept)) END AS kept_sha256,
       CAST(coalesce(f2.gone, 0) AS BIGINT) AS n_passage_bytes, coalesce(f2.n, 0) AS n_passages
FROM d LEFT JOIN f1 ON f1.rid = d.rid LEFT JOIN f2 ON f2.rid = d.rid
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, of ``PASSAGE`` bytes or more; n_chars, where there is one, follows the text."""
    names = docs.columns
    base, name = plain(docs)
    out = removed(base, name["doc_id"], name["text"], PASSAGE, PASSAGE_GRAM)
    if "n_chars" in name:
        out = out.withColumn(name["n_chars"], F.length(name["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*base.columns).toDF(*names)
