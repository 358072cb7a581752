"""Best-fit packing by exact-complement hashing: documents become fixed-size training sequences.

1. Each document is tokenised once into pieces of at most `size` tokens (only longer documents are cut; the first
   piece takes the remainder). The pieces, without their ids, are written to the shared folder.
2. The plan needs the histogram of piece lengths alone, which has at most `size` entries however many pieces there
   are. For each length, longest first, the gap to `size` is looked up among the sums of one, two and three other
   lengths, and such an exact combination is used as often as the counts allow. What has no exact complement goes
   best-fit, longest first, into the fullest sequence with room. The plan is a list of (lengths, how many sequences).
3. Each piece gets its rank among the pieces of its length; the plan maps (length, rank) to a sequence and a place.

Nulls and edges: a null or empty text is the closing token alone; a null doc_id is kept as null; repeated rows are
packed each by itself; an empty table gives an empty result; columns besides `id_col` and `text_col` are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe
from tessera.llm.common import documents, gapless_rank, prepare, shared_table, tidy

SIZE = 2048
CLOSING = np.zeros(1, "<u4").tobytes()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- pieces -------------------------------------------------------------------------------------------------------


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what is over."""
    first = n % size or min(n, size)
    starts = [0, *range(first, n, size)] if n > first else [0]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(df: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and CRC-32 of the ids of every piece."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids(text.as_py() or "") + CLOSING
                out += [(doc, k, a, n, zlib.crc32(memoryview(ids)[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, size))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(tidy(run, "byte_bpe"), "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- plan ---------------------------------------------------------------------------------------------------------


class _Sums:
    """Which sums two available lengths make: the number of unordered pairs for each sum, kept as lengths run out."""

    def __init__(self, left: np.ndarray):
        self.left, self.has = left, left > 0
        whole = np.convolve(self.has.astype(np.int64), self.has.astype(np.int64))
        whole[::2] += self.has[: len(whole[::2])]  # a length with itself
        self.pairs = whole // 2

    def take(self, parts: tuple[int, ...], n: int) -> None:
        for x in parts:
            self.left[x] -= n
        for x in set(parts):
            if not self.left[x]:
                self.pairs[x + np.flatnonzero(self.has)] -= 1
                self.has[x] = False

    def fits(self, parts: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // parts.count(x) for x in set(parts))

    def pair(self, total: int, most: int, base: tuple[int, ...]) -> tuple[int, ...] | None:
        """base with the two lengths that make total, the larger as large as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        i = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        for x in i[self.has[i] & self.has[total - i]]:
            if self.fits(found := (*base, int(x), int(total - x))):
                return found
        return None

    def complement(self, x: int, size: int) -> tuple[int, ...] | None:
        """x with one, two or three lengths no longer than x that fill the sequence."""
        gap = size - x
        if not gap:
            return (x,)
        if gap <= x and self.fits((x, gap)):
            return (x, gap)
        if found := self.pair(gap, x, (x,)):
            return found
        first = np.flatnonzero(self.has[: min(x, gap - 2) + 1])[::-1] if gap > 2 else []
        for y in (y for y in first if self.pairs[gap - y]):
            if found := self.pair(int(gap - y), int(y), (x, int(y))):
                return found
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in falling order, number of sequences) that hold every piece."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    sums, out = _Sums(left), []
    for x in range(size, 0, -1):
        while left[x] and (found := sums.complement(x, size)):
            n = sums.fits(found)
            sums.take(found, n)
            out.append((tuple(sorted(found, reverse=True)), n))
    return out + best_fit({x: int(left[x]) for x in np.flatnonzero(left)}, size)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the sequence with the least room that is enough; equal sequences are handled as one entry with a count."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    some = np.zeros(size + 1, bool)

    def put(lengths: tuple[int, ...], n: int, gap: int) -> None:
        if n:
            room[gap].append((lengths, n))
            some[gap] = True

    for x in sorted(counts, reverse=True):
        c = counts[x]
        while c:
            fitting = np.flatnonzero(some[x:])
            if len(fitting):
                gap = x + int(fitting[0])
                lengths, n = room[gap].pop()
                some[gap] = bool(room[gap])
            else:
                gap, lengths, n = size, (), c
            each = min(gap // x, c)
            used = min(n, c // each)
            put(lengths + (x,) * each, used, gap - each * x)
            if lengths:
                put(lengths, n - used, gap)
            c -= used * each
    return [entry for at in room for entry in at]


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: the ranks from `first` (with the length above bit 48) lie `each` to a sequence, from sequence `base` and place `at` on."""
    rows, used, base = [], {}, 0
    for lengths, n in runs:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            each = lengths.count(x)
            first = used.get(x, 0)
            rows.append((x << 48 | first, first, each, base, at))
            used[x] = first + each * n
            at += each * x
        base += n
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("key", "first", "each", "base", "at"), cols, strict=True))


# --- packing ------------------------------------------------------------------------------------------------------


def pack(df: DataFrame, tokenizer: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cutout = shared_table(pieces(df, tokenizer or tokenizer_path(), size, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cutout.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    where = df.sparkSession.sparkContext.broadcast(places(plan(counts, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            k = np.searchsorted(p["key"], length << 48 | rank, side="right") - 1
            nth = rank - p["first"][k]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["base"][k] + nth // p["each"][k]), pa.array(p["at"][k] + nth % p["each"][k] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = gapless_rank(cutout, "length", ["doc_id", "piece", "ids_crc32"], max(counts.values(), default=0))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(run, "byte_bpe"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
