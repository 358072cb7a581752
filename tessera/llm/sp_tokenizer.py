"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read and its tokenizer rebuilt: the normaliser (character map, extra blanks, marker in front
and for blanks), the model (unigram scores, or merges that follow from the scores of a BPE vocabulary) and byte
fallback, with the rules for user-defined and control pieces. Under a BPE model with byte fallback and no piece that
spans a cut of sp_model.segments, texts are encoded by their distinct segments: those that a bounded memo lacks go
through the library many to a text, with new lines between, as one multithreaded batch. Otherwise whole texts do.

Each text is decoded again, and its ids are held against the sentencepiece library's (column `parity`).

Nulls and edges: a null text has null ids and counts 0, an empty one no ids; texts are encoded whole at any length;
repeated rows and null ids pass through; an empty table gives an empty result."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, prepare
from tessera.llm.sp_model import BPE, BYTE, NORMAL, SPACE, USER, SpModel
from tessera.llm.token_counts import vocabulary_path

MEMO = 400_000
#: Segments that go through the library as one text.
JOINED = 64
#: Fixed value of the sentencepiece library (measured): the score of a user-defined piece in a unigram model.
USER_SCORE = 0.1
#: A code point that is no character.
NO_TEXT = "\ufdd0"


def merges(m: SpModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the best-scored pieces first."""
    ids = {p: k for k, p in enumerate(m.pieces)}
    out = []
    for k, (p, kind) in enumerate(zip(m.pieces, m.types, strict=True)):
        if kind in (NORMAL, USER):
            ways = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
            out += [(-m.scores[k], k, ids[a], ids[b], a, b) for a, b in ways]
    return [(a, b) for *_, a, b in sorted(out)]


def normaliser(m: SpModel):
    """What the model does to a text first: its character map, extra blanks, the marker in front and for blanks."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if m.escape_whitespaces else " "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", SPACE))
    return normalizers.Sequence(steps)


def build(m: SpModel):
    """The model's tokenizer for normalised texts.

    User-defined pieces are found first in a BPE model; in a unigram model each has the score USER_SCORE. Control, unused
    and unknown pieces match no text, so a unigram vocabulary has them under names with a character that texts don't hold."""
    from tokenizers import AddedToken, Tokenizer, models

    if m.kind == BPE:
        vocab = {p: k for k, p in enumerate(m.pieces)}
        model = models.BPE(vocab, merges(m), unk_token=m.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        names = [p if kind in (NORMAL, USER, BYTE) else f"{NO_TEXT}{k}" for k, (p, kind) in enumerate(zip(m.pieces, m.types, strict=True))]
        scores = [USER_SCORE if kind == USER else s for s, kind in zip(m.scores, m.types, strict=True)]
        model = models.Unigram(list(zip(names, scores, strict=True)), m.unk_id, m.byte_fallback)
    tokenizer = Tokenizer(model)
    if m.kind == BPE:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p, kind in zip(m.pieces, m.types, strict=True) if kind == USER])
    return tokenizer


RUNS = re.compile(" +[^ \n]*|[^ \n]+|\n")


def parts(text: str) -> list[str]:
    """What sp_model.segments gives, with blanks for markers; empty parts can lie between."""
    if not text:
        return []
    text = " " + text.replace(SPACE, " ")
    if "  " in text or "\0" in text:
        return RUNS.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class SpTokenizer:
    def __init__(self, path: str):
        self.model = SpModel.load(path)
        ids = {p: k for k, p in enumerate(self.model.pieces) if self.model.types[k] == BYTE}
        # With a byte piece for each byte no run of unknowns spans a cut, and a new line is always the same single id.
        self.cut = self.model.kind == BPE and self.model.byte_fallback and self.model.plain and all(f"<0x{b:02X}>" in ids for b in range(256))
        self.newline = ids.get("<0x0A>")
        self.normaliser, self.library = normaliser(self.model), build(self.model)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() for p, kind in zip(self.model.pieces, self.model.types, strict=True)]
        self.fixed = {"": b"", "\n": array("I", [self.newline]).tobytes()} if self.cut else {}
        self.recent: dict[str, bytes] = dict(self.fixed)
        self.before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, new: list[str]) -> list[bytes]:
        """The ids of each part; none of them holds a new line, so the ids of joined parts are cut at its id."""
        joined = ["\n".join(new[k : k + JOINED]).replace(" ", SPACE) for k in range(0, len(new), JOINED)]
        ids = array("I")
        for e in self.library.encode_batch_fast(joined, add_special_tokens=False):
            ids.extend(e.ids)
            ids.append(self.newline)
        all_ = ids.tobytes()
        ends = (np.flatnonzero(np.frombuffer(all_, np.uint32) == self.newline) * 4).tolist()
        return [all_[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if not self.cut:
            return self._encode([self.normaliser.normalize_str(t) if t else t for t in texts])
        cut = [parts(t) for t in texts]
        found = [list(map(self.recent.get, c)) for c in cut]
        lacking: set[str] = set()
        for c, f in zip(cut, found, strict=True):
            lacking.update([s for s, ids in zip(c, f, strict=True) if ids is None])
        own = {s: ids for s in lacking if (ids := self.before.get(s)) is not None}
        new = [s for s in lacking if s not in own]
        own.update(zip(new, self._encode_parts(new), strict=True))
        if len(self.recent) > MEMO:
            self.before, self.recent = self.recent, dict(self.fixed)
        self.recent.update(own)
        return [b"".join([own[s] if ids is None else ids for s, ids in zip(c, f, strict=True)]) for c, f in zip(cut, found, strict=True)]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        text = b"".join(map(table.__getitem__, array("I", ids))).decode("utf-8", "replace")
        if self.model.escape_whitespaces:
            text = text.replace(SPACE, " ")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text


_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """The tokenizer and the library that it is held against, once for each Python worker."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = SpTokenizer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def encode(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with ids, the decoded text, and whether the sentencepiece library gives the same ids."""
    prepare(df.sparkSession)
    path = model or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [t or "" for t in texts]
            ids = [array("I", x) for x in own.encode(known)]
            cols = [
                pa.array([None if t is None else x for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32())),
                pa.array([None if t is None else own.decode(x.tobytes()) for t, x in zip(texts, ids, strict=True)], pa.string()),
                pa.array([x.tolist() == y for x, y in zip(ids, other.encode(known, num_threads=1), strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "ids", "decoded", "parity"])

    slim = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>, decoded string, parity boolean")


def digests(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with n_ids, the CRC-32 of the ids (little-endian, four bytes each), parity, and whether decoding gives the text back."""
    prepare(df.sparkSession)
    path = model or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [t or "" for t in texts]
            ids = own.encode(known)
            cols = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([x == array("I", y).tobytes() for x, y in zip(ids, other.encode(known, num_threads=1), strict=True)]),
                pa.array([own.decode(x) == t for x, t in zip(ids, known, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "n_ids", "ids_crc32", "parity", "round_trip"])

    slim = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_ids long, ids_crc32 long, parity boolean, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
