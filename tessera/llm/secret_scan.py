"""Secret scans: base patterns, and a character network over every candidate.

Base findings are of three kinds (assign, access, hex), leftmost and non-overlapping within a kind, and always stay.
Candidates of the network are all base findings and every further run of 20 or more key characters that overlaps no base
finding; runs whose calibrated probability (the highest along the run, which
can have any length) reaches the recall-constrained threshold are added as kind `net`. Offsets are in code points, the end exclusive.

Nulls and edges: a null or empty text has no spans (the SHA-256 is that of nothing); texts are scanned whole at any
length; equal texts get equal spans; repeated rows and null ids pass through; an empty table gives an empty result."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.char_cnn import Net, train, windows
from tessera.llm.common import documents, prepare, tidy

KINDS = ("assign", "access", "hex", "net")
# The base patterns, what must be in a lower-cased text for the first to match, and the least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Windows that wait to be scored together.
WAITING = 16384

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) in order."""
    out: list[Span] = []
    folded = text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    if any(w in folded for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters that overlap no base finding; both lists are in order, so one pass is enough."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            out.append((m.start(), m.end()))
    return out


def scan_texts(texts: list[str | None], net: Net) -> tuple[list[list[Span]], list[float | None]]:
    """All spans of each text, and the highest probability among its candidates."""
    spans: list[list[Span]] = []
    top: list[float | None] = [None] * len(texts)
    rows, owner, waiting = [], [], 0

    def judge() -> None:
        for (k, a, b, found), x in zip(owner, net.probability_of(rows), strict=True):
            top[k] = max(top[k] or 0.0, float(x))
            if not found and x >= net.threshold:
                spans[k].append((a, 3, b))
        rows.clear()
        owner.clear()

    for k, t in enumerate(texts):
        t = t or ""
        own = base_spans(t)
        spans.append(own)
        for a, b, found in [(a, b, True) for a, _, b in own] + [(a, b, False) for a, b in candidates(t, own)]:
            rows.append(windows(t, a, b))
            owner.append((k, a, b, found))
            waiting += len(rows[-1])
            if waiting >= WAITING:
                judge()
                waiting = 0
    judge()
    return [sorted(s) for s in spans], top


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@functools.cache
def network() -> Net:
    return train()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """The id with its spans (start, end, kind) and the highest probability."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(net or network())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans, top = scan_texts(batch.column(1).to_pylist(), shared.value)
            listed = [[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in s] for s in spans]
            base = [[x for x in s if x[1] < 3] for s in spans]
            counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digests, pa.array([written(s) for s in spans], pa.string()), pa.array(top, pa.float64()), pa.array(listed, kind)],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_probability", "span_list"],
            )

    slim = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    own = f"`{id_col}` {slim.schema[0].dataType.simpleString()}"
    return slim.mapInArrow(tidy(run), f"{own}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, top_probability double, span_list array<struct<start: long, end: long, kind: string>>")


def mask_text(text: str, spans: list[Span], label: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], label]
            at = b
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text", label: str = "[SECRET]", net: Net | None = None) -> DataFrame:
    """df with every finding in the text replaced by the label; texts without findings, and nulls, stay as they are."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(net or network())
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans, _ = scan_texts(texts, shared.value)
            if any(spans):
                masked = pa.array([mask_text(t, s, label) if s else t for t, s in zip(texts, spans, strict=True)], batch.schema.field(at).type)
                batch = batch.set_column(at, batch.schema.field(at), masked)
            yield batch

    return df.mapInArrow(tidy(run), df.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("span_list")
