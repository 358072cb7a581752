"""Language ID by prediction by partial matching (PPM).

For each language a variable-order context tree over bytes is counted from a bounded sample of labelled documents and
then frozen. A text's exact code length under a language is the sum over its bytes of -log2 of the PPM probability:
the longest seen context of at most `order` bytes predicts, and where it has not seen the byte it pays its escape
probability (method C) and the next shorter context predicts; below order 0 all 256 bytes are alike. The language with
the shortest code wins (ties: the smaller name); the score is its posterior probability under equal priors.

Frozen statistics make the code length of a byte a function of it and the `order` bytes before. All languages share
one trie of reversed byte strings, so one walk back from each position, vectorised over positions, finds both the
deepest counted string that ends there and the deepest context for the next byte; costs are tables by trie node.

Nulls and edges: a null text, or one without a letter (Unicode category L), is `und` with score 0 and is never learned
from; with no labelled row at all every text is `und`. Texts of any length are scored in segments of bounded memory.
Repeated rows get equal results; a null doc_id counts as not held out; an empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import documents, held_out, keep, prepare, tidy

ORDER = 4
#: Bound of the sample: UTF-8 bytes of text that are learned from for each language. Longer documents are not sampled.
SAMPLE_BYTES = 256 * 1024
#: Bound of all languages' samples together: with more than 256 languages each gets an equal part of it.
SAMPLE_TOTAL = 64 << 20
#: Code lengths are counted in units of 1/4096 bit, so that sums are exact and do not depend on how a text is cut.
UNIT = 4096
SEGMENT = 1 << 19
#: Never part of UTF-8; it ends each text in a buffer.
END = 0xFF
UNKNOWN = "und"
LETTER = r"\p{L}"


@dataclass
class Model:
    """languages, the class of each byte (0: never seen), and by trie node its parent, class and costs for each language."""

    languages: list[str]
    classes: np.ndarray
    parent: np.ndarray
    last: np.ndarray
    cost: np.ndarray
    tail: np.ndarray
    order: int
    inner: int
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def children(self) -> np.ndarray:
        """Node by node and class; 0 where there is none. Nodes from `inner` on are leaves."""
        table = np.zeros((self.inner, int(self.classes.max()) + 1), np.int32)
        table[self.parent[1:], self.last[1:]] = np.arange(1, len(self.parent))
        return table


def train(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    languages = sorted(samples)
    parts = [np.frombuffer(t.encode() + bytes([END]), np.uint8) for name in languages for t in samples[name]]
    owner = np.concatenate([np.full(sum(len(t.encode()) + 1 for t in samples[name]), k) for k, name in enumerate(languages)]) if parts else np.zeros(0, int)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    seen = np.unique(data[data != END])
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width, own, n_lang = len(seen) + 1, classes[data], len(languages)

    # nodes, level by level: a string of d bytes is its last d - 1 bytes (the parent) and the byte before them
    parent, last, depth, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros((1, n_lang))]
    at, total, inner = np.zeros(len(data), np.int64), 1, 1
    for d in range(1, order + 2):
        back = np.zeros_like(own)
        back[d - 1 :] = own[: max(len(own) - d + 1, 0)]
        ok = (back > 0) & ((at > 0) | (d == 1))
        keys, inverse = np.unique(at[ok] * width + back[ok], return_inverse=True)
        inner = total
        parent.append(keys // width)
        last.append(keys % width)
        depth.append(np.full(len(keys), d))
        counts.append(np.bincount(inverse * n_lang + owner[ok], minlength=len(keys) * n_lang).reshape(len(keys), n_lang).astype(float))
        at = np.zeros(len(data), np.int64)
        at[ok] = inverse + total
        total += len(keys)
    parent, last, depth, n = (np.concatenate(x) for x in (parent, last, depth, counts))
    model = Model(languages, classes, parent, last, np.zeros(0), np.zeros(0), order, inner)
    child = model.children()

    # the context of a string is the string without its last byte; its followers are what the tree counts
    context = np.zeros(total, np.int64)
    levels = [np.flatnonzero(depth == d) for d in range(order + 2)]
    for d in range(2, order + 2):
        context[levels[d]] = child[context[parent[levels[d]]], last[levels[d]]]
    followed, kinds = np.zeros((total, n_lang)), np.zeros((total, n_lang))
    np.add.at(followed, context[1:], n[1:])
    np.add.at(kinds, context[1:], (n[1:] > 0).astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(followed > 0, np.log2((followed + kinds) / kinds), 0.0)
        direct = np.log2((followed[context] + kinds[context]) / n)
    full = np.zeros((total, n_lang))
    full[0] = escape[0] + 8
    above = np.zeros((total, n_lang))  # escapes of orders 1 to the node's depth, as a context
    for d in range(1, order + 2):
        k = levels[d]
        full[k] = np.where(n[k] > 0, direct[k], full[parent[k]] + escape[context[k]] * (d > 1))
        if d == 1:
            full[k] = np.where(n[k] > 0, direct[k], full[0])
        above[k] = above[parent[k]] + (escape[k] if d <= order else 0)
    tail = np.rint(above * UNIT).astype(np.int64)
    cost = np.rint((full - np.where((np.arange(total) > 0)[:, None], above[context], 0)) * UNIT).astype(np.int64) + tail
    model.cost, model.tail = cost.astype(np.int32), tail.astype(np.int32)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        child = model.children()
        child[0] = 0  # a walk that has ended stays ended
        self.width, self.child = child.shape[1], child.ravel()
        self.classes = model.classes.astype(np.int32)
        self.columns = [np.ascontiguousarray(model.cost[:, k]) for k in range(len(model.languages))]

    def nodes(self, data: np.ndarray) -> np.ndarray:
        own = self.classes[data]
        at = own.copy()  # the nodes of depth 1 are numbered as their classes
        best = at.copy()
        for d in range(1, self.m.order + 1):
            back = np.zeros_like(own)
            back[d:] = own[:-d] if d < len(own) else own[:0]
            at = self.child[at * self.width + back]
            np.maximum(best, at, out=best)
        return best

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in units."""
        out = np.zeros((len(texts), len(self.m.languages)), np.int64)
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if len(t) > SEGMENT:
                out[k] = self._long(t)
                continue
            group.append(k)
            size += len(t) + 1
            if size > SEGMENT:
                out[group] = self._group([texts[i] for i in group])
                group, size = [], 0
        if group:
            out[group] = self._group([texts[i] for i in group])
        return out

    def _group(self, texts: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(t) + 1 for t in texts])
        at = self.nodes(np.frombuffer(bytes([END]).join(texts) + bytes([END]), np.uint8))
        starts = np.concatenate([[0], ends[:-1]])
        # each segment holds its text and the end mark, which is taken off again; an empty text is the mark alone
        sums = np.stack([np.add.reduceat(c[at], starts, dtype=np.int64) - c[0] for c in self.columns], 1)
        final = at[np.maximum(ends - 2, 0)]
        return sums - np.where((ends - starts > 1)[:, None], self.m.tail[final], 0)

    def _long(self, text: bytes) -> np.ndarray:
        data, total, before = np.frombuffer(text, np.uint8), np.zeros(len(self.m.languages), np.int64), self.m.order
        for a in range(0, len(data), SEGMENT):
            lead = min(a, before)
            at = self.nodes(data[a - lead : a + SEGMENT])[lead:]
            total += [int(c[at].sum(dtype=np.int64)) for c in self.columns]
        return total - self.m.tail[at[-1]]


_scorers: dict[str, Scorer] = keep("language_id")


def scorer(model: Model) -> Scorer:
    """Tables are built once for each Python worker and model."""
    if model.uid not in _scorers:
        _scorers.clear()
        _scorers[model.uid] = Scorer(model)
    return _scorers[model.uid]


def sample(df: DataFrame, text_col: str, lang_col: str, bytes_each: int) -> dict[str, list[str]]:
    """For each language the documents with the smallest hashes, up to bytes_each of text: at most that much for each language reaches the driver.

    Repeats of a text in a language count once. A first pass finds how much distinct text each language has, so that the
    second ranks only about twice what is needed; languages whose sample isn't full then are ranked again over more."""
    rows = df.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.octet_length(text_col).alias("n"), F.xxhash64(text_col).alias("h"))
    rows = rows.where(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.col("n") <= bytes_each) & F.col("t").rlike(LETTER))
    have = {r["l"]: r["n"] for r in rows.select("l", "h", "n").distinct().groupBy("l").agg(F.sum("n").alias("n")).collect()}
    bytes_each = min(bytes_each, SAMPLE_TOTAL // max(len(have), 1))
    shares = {name: min(1.0, (2 * bytes_each + 2**20) / n) for name, n in have.items()}
    order = W.partitionBy("l").orderBy("h", "t").rowsBetween(W.unboundedPreceding, 0)
    out: dict[str, list[str]] = {}
    while shares:
        share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        likely = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.element_at(share, F.col("l"))).distinct()
        # the first text beyond the bound comes along: it shows that the sample is full
        ranked = likely.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") - F.col("n") < bytes_each)
        found: dict[str, list[tuple[str, int]]] = {}
        for r in ranked.select("l", "t", "sum").orderBy("l", "h").collect():
            found.setdefault(r["l"], []).append((r["t"], r["sum"]))
        full = {name for name, x in shares.items() if x == 1 or name in found and found[name][-1][1] >= bytes_each}
        out |= {name: [t for t, total in found[name] if total <= bytes_each] or [found[name][0][0]] for name in full & found.keys()}
        shares = {name: min(1.0, 4 * x) for name, x in shares.items() if name not in full}
    return out


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, bytes_each: int = SAMPLE_BYTES) -> Model:
    return train(sample(df, text_col, lang_col, bytes_each), order)


def with_language(df: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """Columns `keep` with lang_pred, score and bits_per_byte (the shortest code length by byte; null for `und`)."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value, scorer(shared.value)
        for batch in batches:
            known = [t.encode() if letter and m.languages else b"" for t, letter in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            bits = s.lengths(known) / UNIT if m.languages else np.zeros((len(known), 1))
            best = bits.argmin(1)
            least = bits[np.arange(len(known)), best]
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            sizes = np.array([len(t) for t in known], np.int64)
            none = sizes == 0
            pred = [UNKNOWN if skip else m.languages[k] for skip, k in zip(none, best, strict=True)]
            cols = [pa.array(pred, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(least / np.maximum(sizes, 1), mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], [*batch.schema.names[2:], "lang_pred", "score", "bits_per_byte"])

    slim = df.select(F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("_letter"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[2:])
    return slim.mapInArrow(tidy(run, "language_id"), f"{schema}, lang_pred string, score double, bits_per_byte double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return with_language(docs, model, ["doc_id", "held_out"])
