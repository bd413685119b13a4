"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed by its protobuf wire format: pieces with scores and types, the model type, byte fallback and the
normaliser's settings. From these a tokenizer is rebuilt: the normaliser (precompiled map, white-space collapsing, dummy
prefix, the metaspace marker for spaces), a unigram model over the scores or a BPE model whose merges follow the scores, with
byte fallback, and the decoder. Its ids and its decoded text are the result; batches are encoded by the library's threads.

Where no piece has the marker inside (measured on the vocabulary), no piece can cross from a word into the next marker, so
text is cut before every run of markers and each distinct chunk of a worker is encoded and decoded once. Parity is verified on
every distinct chunk: the SentencePiece library encodes it as well. Only a chunk on which the two differ gets the library's
ids; ``parity`` is false for its texts and ``n_odd`` counts such chunks in a text (none on the test tables).

Defined cases: a null or empty text has no tokens and decodes to the empty text; characters that the vocabulary lacks become
byte pieces (or the unknown piece in models without byte fallback, which does not decode back); repeated rows each keep
their row; texts of any length are encoded whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20
MARK = "▁"
CACHE_CHUNKS = 500_000
CACHE_CHARS = 64
SLICE = 256
JOINED = 512
#: Threads of the library in each Python worker.
THREADS = 2
#: Fixed values of the model format: piece types and model types.
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints, fixed words and length-delimited bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def chunked(self) -> bool:
        """No piece has the marker behind another character."""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind not in (CONTROL, UNKNOWN))


def parse(data: bytes) -> Model:
    m = Model([])
    for field, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, 1
            for f, v in _fields(value):
                if f == 1:
                    piece = v.decode("utf-8")
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif field == 2:
            for f, v in _fields(value):
                if f == 3:
                    m.kind = v
                elif f == 35:
                    m.byte_fallback = bool(v)
        elif field == 3:
            for f, v in _fields(value):
                if f == 2:
                    m.charsmap = v
                elif f in (3, 4, 5):
                    setattr(m, {3: "dummy_prefix", 4: "collapse", 5: "escape"}[f], bool(v))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    return m


def build(m: Model):
    """A tokenizers.Tokenizer whose normaliser, model and decoder stand for the parsed model's."""
    from tokenizers import Regex, Tokenizer, decoders, normalizers
    from tokenizers.models import BPE as Bpe
    from tokenizers.models import Unigram

    if m.kind == UNIGRAM:
        model = Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
    else:
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        merges = []
        for p, score, kind in m.pieces:
            if kind in (UNKNOWN, CONTROL, BYTE):
                continue
            pairs = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
            merges += [(-score, -len(a), ids[a], ids[b], a, b) for a, b in pairs]
        # SentencePiece merges the leftmost of equal scores first, so a piece grows from the left: longer left parts go first
        merges.sort()
        model = Bpe(ids, [(a, b) for *_, a, b in merges], unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.collapse:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


class Codec:
    """Encode and decode batches of texts. Ids are little-endian int32 arrays."""

    def __init__(self, data: bytes, threads: int = THREADS):
        # read by the library's thread pool when it first runs, here in the worker
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece
        from tokenizers import Tokenizer, decoders, pre_tokenizers

        self.model = m = parse(data)
        self.full = build(m)
        self.inner = Tokenizer.from_str(self.full.to_str())  # chunks are normalised already, and keep their first space
        self.inner.normalizer = None
        self.inner.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.row = Tokenizer.from_str(self.inner.to_str())  # many chunks in a row, cut before each marker
        self.row.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.row.decoder = self.inner.decoder
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        # the normaliser only puts the marker before the text and for its spaces, and no piece crosses a cut
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if m.chunked and m.dummy_prefix and not m.charsmap and not m.collapse else None
        self.ids: dict[str, bytes] = {}
        self.back: dict[str, str] = {}  # chunks that do not decode to themselves
        self.odd: set[str] = set()
        self.is_byte = np.array([k == BYTE for _, _, k in m.pieces], bool)
        self.begins = np.array([p.startswith(MARK) for p, _, _ in m.pieces], bool)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The tokenizer's ids of each chunk; what does not decode back is noted in ``back``."""
        out = []
        for ids, c in zip([e.ids for e in self.inner.encode_batch_fast(chunks, add_special_tokens=False)], chunks, strict=True):
            out.append(struct.pack(f"<{len(ids)}i", *ids))
            if (text := self.inner.decode(ids, skip_special_tokens=False)) != c.replace(MARK, " "):
                self.back[c] = text
        return out

    def _encode_rows(self, chunks: list[str]) -> list[bytes]:
        """``_encode`` for chunks of one marker and text behind it: many are encoded and decoded as one string."""
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        rows = ["".join(g) for g in groups]
        coded = [e.ids for e in self.row.encode_batch_fast(rows, add_special_tokens=False)]
        texts = self.row.decode_batch(coded, skip_special_tokens=False)
        out: list[bytes] = []
        for g, r, ids, text in zip(groups, rows, coded, texts, strict=True):
            flat = np.array(ids, "<i4")
            starts = np.flatnonzero(self.begins[flat])
            if len(starts) != len(g) or text != r.replace(MARK, " "):  # one by one, to tell which
                out += self._encode(g)
                continue
            packed, at = flat.tobytes(), [*(4 * starts).tolist(), 4 * len(flat)]
            out += [packed[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _learn(self, chunks: list[str]) -> None:
        single = [c for c in chunks if len(c) > 1 and c[1] != MARK]
        other = [c for c in chunks if len(c) == 1 or c[1] == MARK]
        chunks = single + other
        got = self._encode_rows(single) + self._encode(other)
        # every chunk begins with a marker, which SentencePiece itself puts before what follows it
        want = self.peer.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        alone = [self.peer.piece_to_id(MARK)]
        want = [w if len(c) > 1 else alone for c, w in zip(chunks, want, strict=True)]
        if b"".join(got) != np.fromiter(chain.from_iterable(want), "<i4").tobytes() or [len(g) for g in got] != [4 * len(w) for w in want]:
            for i, (c, w) in enumerate(zip(chunks, want, strict=True)):
                if got[i] != (held := struct.pack(f"<{len(w)}i", *w)):
                    got[i] = held
                    self.odd.add(c)
                    self.back.pop(c, None)
                    if (text := self.inner.decode(w, skip_special_tokens=False)) != c.replace(MARK, " "):
                        self.back[c] = text
        self.ids.update(zip(chunks, got, strict=True))

    def code(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[int], list[str]]:
        """Ids, the number of chunks on which SentencePiece disagreed, and the text that the ids decode to, of each text."""
        if self.cut is None:
            given = [t or "" for t in texts]
            got, want = [e.ids for e in self.full.encode_batch_fast(given, add_special_tokens=False)], self.peer.encode(given, num_threads=1)
            return [np.array(w, "<i4") for w in want], [int(g != w) for g, w in zip(got, want, strict=True)], self.decode(want)
        if len(self.ids) > CACHE_CHUNKS:
            self.ids, self.back, self.odd = {}, {}, set()
        parts = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        packed: list[bytes | None] = []
        unknown: set[str] = set()
        for p in parts:
            try:
                packed.append(b"".join(map(self.ids.__getitem__, p)))
            except KeyError:
                packed.append(None)
                unknown.update(p)
        new = [*unknown.difference(self.ids)]
        if new:
            self._learn(new)
            packed = [b"".join(map(self.ids.__getitem__, p)) if x is None else x for x, p in zip(packed, parts, strict=True)]
        odd = [0 if not self.odd or self.odd.isdisjoint(p) else sum(c in self.odd for c in p) for p in parts]
        # a text decodes to its chunks' decoded texts, which are the chunks' own where ``back`` has no other
        same = lambda p: not self.back or self.back.keys().isdisjoint(p)
        back = [t or "" if same(p) else "".join([self.back.get(c) or c.replace(MARK, " ") for c in p])[1:] for t, p in zip(texts, parts, strict=True)]
        for c in new:  # long chunks are not worth their memory
            if len(c) > CACHE_CHARS:
                del self.ids[c]
                self.back.pop(c, None)
                self.odd.discard(c)
        return [np.frombuffer(x, "<i4") for x in packed], odd, back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.full.decode_batch(ids, skip_special_tokens=False)


_CODEC: dict = {}


def codec(given) -> Codec:
    """One codec per Python worker, kept between tasks. ``given``: a broadcast of the model file's bytes."""
    if _CODEC.get("of") != given.value:
        _CODEC["of"], _CODEC["codec"] = given.value, Codec(given.value)
    return _CODEC["codec"]


def _broadcast(spark: SparkSession, model: str):
    with open(model, "rb") as f:  # the driver reads the file, whose size is checked
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{model} has more than {MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _coded(docs: DataFrame, model: str, columns, schema: str) -> DataFrame:
    """doc_id and the arrays that ``columns`` makes of a slice of texts and their codes."""
    given = _broadcast(docs.sparkSession, model)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(given)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                texts = part.column("text").to_pylist()
                ids, odd, back = c.code(texts)
                trip = [(t or "") == d for t, d in zip(texts, back, strict=True)]
                made = [*columns(c, ids, back), pa.array(odd, pa.int64()), pa.array([not n for n in odd], pa.bool_()), pa.array(trip, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *names, "n_odd", "parity", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}, n_odd long, parity boolean, round_trip boolean")


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_odd (chunks on which the encoders differ), parity (none) and round_trip (the ids decode to the text)."""

    def columns(c: Codec, ids, back):
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))]

    return _coded(docs, model, columns, "ids array<int>")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids decode to a null text."""
    given = _broadcast(tokens.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(given)
        for b in batches:
            ids = b.column("ids").to_pylist()
            text = [None if i is None else t for i, t in zip(ids, c.decode([i or [] for i in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def summary(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Digest columns of ``encode``, made next to it so that ids need not leave the worker."""

    def columns(c: Codec, ids, back):
        return [
            pa.array([len(x) for x in ids], pa.int64()), pa.array([int(c.is_byte[x].sum()) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
        ]

    return _coded(docs, model, columns, "n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))
