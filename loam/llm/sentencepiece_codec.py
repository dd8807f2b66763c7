"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and types, the trainer's model type and
byte fallback, the normaliser's flags and character map. From these a tokenizers pipeline is rebuilt:
normaliser (precompiled character map, metaspace marker for spaces, dummy prefix), a Unigram model from
the scores or a BPE model whose merges follow from them, byte fallback, and the decoder. Batches are
encoded multithreaded by that library. Where no piece of the model crosses the start of a word, texts
are cut there first, and a batch hands the library each different new segment once; the ids of known
segments are remembered, up to a bound. `parity` compares with the reference implementation.

Defined results: null texts count as empty; an empty text has no pieces and decodes to ''. Repeated rows
are encoded one by one; extra columns are ignored; texts are encoded whole. Without documents there are no
rows. The file must be at the same
path on every executor.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from .common import TOKENIZERS, give_back, lean_batches, spread_table

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose ids a task remembers; forgotten all at once beyond that, and at its end.
REMEMBERED = 600_000
#: Different words encoded as one text.
JOINED = 512
# Field numbers and enum values of the public SentencePiece model protobuf.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.charsmap = UNIGRAM, False, b""
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for number, value in fields(data):
            if number == PIECES:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == NORMALIZER:
                rules = dict(fields(value))
                self.charsmap = rules.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces in the order in which BPE merges them: by the score of what they make."""
        ids = {piece: i for i, (piece, _, _) in enumerate(self.pieces)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                halves = ((piece[:i], piece[i:]) for i in range(1, len(piece)))
                found += [(-score, ids[a], ids[b], a, b) for a, b in halves if a in ids and b in ids]
        return [(a, b) for *_, a, b in sorted(found)]


def build(data: bytes) -> Tokenizer:
    """The tokenizers pipeline equal to a model file."""
    model = Model(data)
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == BPE:
        vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, model.merges(), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(piece, score) for piece, score, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +| +\z"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", SPACE))
    if model.squeeze:  # markers that the text itself ends with go as well
        steps.append(normalizers.Replace(Regex(rf"{SPACE}+\z"), ""))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    # Where no piece has the marker behind another character, texts can be cut before each run of markers.
    if not any(SPACE in piece.lstrip(SPACE) for piece, _, kind in model.pieces if kind == NORMAL):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    return tokenizer


def segmentable(model: Model) -> bool:
    """Whether texts may be cut before each run of markers without changing their pieces."""
    crossing = any(SPACE in piece.lstrip(SPACE) for piece, _, kind in model.pieces if kind == NORMAL)
    return model.dummy_prefix and model.byte_fallback and not (model.squeeze or model.charsmap or crossing)


class Encoder:
    """Encodes batches of texts to piece ids as little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        model = Model(data)
        self.tokenizer, self.segments = build(data), segmentable(model)
        self.dummy, self.squeeze = model.dummy_prefix, model.squeeze
        shown = {UNKNOWN: lambda piece: " ⁇ ".encode(), CONTROL: lambda piece: b"", BYTE: lambda piece: bytes([int(piece[3:5], 16)])}
        self.bytes = [shown.get(kind, lambda piece: piece.replace(SPACE, " ").encode())(piece) for piece, _, kind in model.pieces]
        self.opens = np.array([piece.startswith(SPACE) for piece, _, _ in model.pieces])
        alone = next((i for i, p in enumerate(model.pieces) if p[0] == SPACE), None)
        self.marker = {} if alone is None else {"": np.array([alone], "<i4").tobytes()}
        self.known = dict(self.marker)
        self.segments = self.segments and alone is not None

    def _library(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for group in _slices(texts, 1 << 20):
            found += [np.asarray(x.ids, "<i4").tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        return found

    @staticmethod
    def cut(text: str) -> list[str]:
        """Segments of a text, each without the marker that it starts with."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]+| +", " " + text.replace(SPACE, " "))]

    def _learn(self, segments: list[str]) -> None:
        """Remember the ids of segments. Plain words are encoded many in a text, whose pieces that start
        with the marker say where each word begins; segments with several markers go one by one.
        """
        plain = [x for x in segments if x and x[0] != " "]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        for words, raw in zip(groups, self._library([" ".join(words) for words in groups]), strict=True):
            begins = (np.append(np.flatnonzero(self.opens[np.frombuffer(raw, "<i4")]), len(raw) // 4) * 4).tolist()
            self.known.update((x, raw[a:b]) for x, a, b in zip(words, begins, begins[1:], strict=False))
        odd = [x for x in segments if x and x[0] == " "]
        self.known.update(zip(odd, self._library(odd), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.segments:
            return self._library(texts)
        cut = [self.cut(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        self._learn(list({x for parts in cut for x in parts}.difference(known)))
        return [b"".join([known[x] for x in parts]) for parts in cut]

    def forget(self) -> None:
        self.known = dict(self.marker)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of piece ids: the pieces' bytes, joined; each byte that is part of no UTF-8 becomes U+FFFD.

        With a dummy prefix one leading marker goes. Where extra white space is removed, pieces lose theirs for
        as long as the text so far is empty; an unknown piece keeps its own blank.
        """
        found: list[str] = []
        for one in ids:
            parts = [self.bytes[i] for i in one]
            for at, i in enumerate(one if self.dummy or self.squeeze else ()):
                if self.opens[i]:
                    parts[at] = parts[at][1:]
                    if not self.squeeze:
                        break
                if parts[at]:
                    break
            found.append(b"".join(parts).decode(errors="bytewise"))
        return found


codecs.register_error("bytewise", lambda error: ("\ufffd" * (error.end - error.start), error.end))


@lru_cache(maxsize=1)
def load(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def original(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _slices(texts: list[str], chars: int) -> Iterator[list[str]]:
    """texts in groups of about so many characters, so that one group's encodings fit in memory."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """Columns of `keep` and piece_ids of docs(text, *keep)."""
    schema = docs.select(*keep).schema.add("piece_ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = _slices(batch.column("_text").to_pylist(), 1 << 20)
            ids = pa.array([np.frombuffer(x, "<i4") for group in groups for x in load(path).encode(group)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids], schema.names)
        load(path).forget()
        give_back()

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """Columns of `keep` and text of encoded(piece_ids, *keep)."""
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = load(path).decode([x or [] for x in batch.column("piece_ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], schema.names)

    return encoded.select(*keep, "piece_ids").mapInArrow(run, schema)


def encode_report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row a document: n_pieces, pieces_sha256 (ids as little-endian 32-bit), round_trip and parity.

    round_trip: the pieces decode to the text. parity: the reference implementation gives the same ids,
    and the same text for them.
    """
    schema = docs.select("doc_id").schema.add("n_pieces", "long").add("pieces_sha256", "string").add("round_trip", "boolean").add("parity", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, theirs = load(path), original(path)
        for batch in batches:
            rows = []
            for group in _slices(batch.column("_text").to_pylist(), 1 << 20):
                packed = ours.encode(group)
                ids = [np.frombuffer(x, "<i4").tolist() for x in packed]
                decoded = ours.decode(ids)
                wanted = theirs.encode(group, num_threads=1)
                for text, raw, mine, back, other in zip(group, packed, ids, decoded, wanted, strict=True):
                    rows.append((len(mine), hashlib.sha256(raw).hexdigest(), back == text, mine == other and theirs.decode(mine) == back))
            kinds = pa.int64(), pa.string(), pa.bool_(), pa.bool_()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], schema.names)
        ours.forget()
        give_back()

    lean_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_report(spread_table(spark, sf_dir, "documents", "doc_id", "text"))
