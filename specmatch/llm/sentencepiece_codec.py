"""SentencePiece encoding and decoding on the ``tokenizers`` backend.

The model protobuf is parsed here and rebuilt as a ``tokenizers`` pipeline: normaliser (precompiled character map,
blank folding, dummy prefix), metaspace marker, BPE merges or unigram scores, and byte fallback. Every worker holds the
rebuilt tokenizer against the SentencePiece library before its first row and over the first ``verify_rows`` rows of
each task, and stops the task on any difference.

Edge cases: a null or empty text encodes to no ids and decodes to the empty text; control pieces written out in a
text are ordinary characters; very long texts are whole; other columns pass through (``ids``, ``n_tokens`` and
``decoded`` replace columns of those names).
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from specmatch.llm.frames import plain
from specmatch.llm.textvec import pieces

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
PROBES = ("", " ", "a", "  two  blanks ", "Hello, world! \t tabs\nlines", "naïve façade – ßtraße", "日本語 \U0001f600 \x00 \x7f", "<s> </s> <unk> <0x41>", MARK + "mark", "aaaaaaaaaaaaaaaaaaaa", "1234567890 1,000.50")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_blanks: bool = True
    escape_blanks: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, kind, data[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield tag >> 3, kind, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")


def parse(data: bytes) -> Model:
    model = Model()
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.fold_blanks = bool(v)
                elif n == 5:
                    model.escape_blanks = bool(v)
    if model.kind not in (1, 2):
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which SentencePiece's scores would join them."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    joins = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL and len(piece) > 1:
            joins += [(-score, i, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
    return [(a, b) for _, _, _, a, b in sorted(joins)]


def rebuild(model: Model):
    """A ``tokenizers.Tokenizer`` that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), None)
    if model.kind == 2:
        core = models.BPE(vocab=vocab, merges=_merges(model), unk_token=model.pieces[unk][0] if unk is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        least = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0) - 20
        core = models.Unigram([(p, s if k in (NORMAL, USER) else least) for p, s, k in model.pieces], unk_id=unk, byte_fallback=model.byte_fallback)
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.fold_blanks:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARK if model.escape_blanks else " "
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if model.kind == 2 and not any(MARK in p.lstrip(MARK) for p, _, k in model.pieces if k == NORMAL):
        # no piece goes on past a mark, so a join never crosses the start of a run of marks
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    parts = [decoders.Replace(MARK, " ")] if model.escape_blanks else []
    parts += [decoders.ByteFallback()] if model.byte_fallback else []
    parts += [decoders.Fuse()]
    parts += [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tok.decoder = decoders.Sequence(parts)
    return tok


class Codec:
    """Encode and decode batches; ``verify`` compares ids and texts with the SentencePiece library."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = parse(data)
        self.tok = rebuild(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.verify(list(PROBES))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def verify(self, texts: list[str]) -> None:
        if not texts:
            return
        ours, theirs = self.encode(texts), self.judge.encode(texts, num_threads=1)
        for text, a, b in zip(texts, ours, theirs, strict=True):
            if a != list(b):
                raise ValueError(f"ids differ from SentencePiece for {text[:80]!r}")
        for text, a, b in zip(texts, self.decode(ours), self.judge.decode(theirs), strict=True):
            if a != b:
                raise ValueError(f"decoded text differs from SentencePiece for {text[:80]!r}")


_codecs: dict[str, Codec] = {}
#: Threads a worker encodes with. More than an executor has cores for a task only contend.
THREADS = 2


def codec(data: bytes) -> Codec:
    """The worker's codec of a model, made once."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library starts its threads
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model's file; by default the public BPE model with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _put(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), *new.values()], names=[*keep, *new])


def _schema(df: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])


def encode(docs: DataFrame, model: bytes | None = None, text_col: str = "text", verify_rows: int = 8) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens``. The model is half a megabyte and goes to the workers by broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, left = codec(held.value), verify_rows
        for batch in pieces(batches, text_col):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            if left > 0:
                c.verify(texts[:left])
                left -= len(texts)
            got = c.encode(texts)
            sizes = np.array([len(x) for x in got], np.int64)
            flat = np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum()))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield _put(batch, ids=ids, n_tokens=pa.array(sizes))

    return docs.mapInArrow(run, _schema(docs, ids=T.ArrayType(T.IntegerType()), n_tokens=T.LongType()))


def decode(coded: DataFrame, model: bytes | None = None, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of its ids (null ids: empty)."""
    held = coded.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                ids = [x or [] for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
                yield _put(batch, decoded=pa.array(c.decode(ids), pa.string()))

    return coded.mapInArrow(run, _schema(coded, decoded=T.StringType()))


def digest(docs: DataFrame, model: bytes | None = None, verify_rows: int = 8) -> DataFrame:
    """Per document: number of ids, their SHA-256 (little-endian int32), and whether they decode to the text again."""
    held = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, left = codec(held.value), verify_rows
        for batch in pieces(batches, "text"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if left > 0:
                c.verify(texts[:left])
                left -= len(texts)
            ids = c.encode(texts)
            back = c.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(np.asarray(x, "<i4").tobytes()).hexdigest() for x in ids]), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                names=["doc_id", "n_tokens", "ids_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: every document with its columns, and its ids and n_tokens (which replace columns of these names)."""
    new = ("ids", "n_tokens")
    base, name = plain(docs, new)
    return encode(base, text_col=name["text"]).toDF(*(c for c in docs.columns if c not in new), *new)
