"""Sharding by a K-d tree over document metadata, with DataFrame functions only.

Documents get coordinates in the unit cube: the id and the logarithm of the size, scaled to their ranges, and hashes
of the language and the source. The root stands for all shards; a node for k shards is split along its widest
dimension at the weighted quantile that leaves k // 2 shards' worth of bytes on the lower side (the weighted median
for even k), until each leaf is one shard of the target bytes, total / shards.

Quantiles are exact to a thousandth of a shard: histograms of BINS bins over each node's range are summed for all nodes
of a level at once, and the bin that holds the quantile is taken apart again until it weighs little enough. A tiny
offset by a hash of the document (and a yet tinier one by its place in the input) sets equal coordinates apart, so a
hot source or language, a group of copies or repeated rows can be split as well. The driver holds a row for each node.

Nulls and edges: a null text weighs 8 bytes and has CRC 0; a null id, language or source has coordinate 0; a null id
stays null; an empty table gives an empty result; columns besides those named are ignored. Equal texts are not kept
together: this is the `bytes` law, which only evens out sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, gapless_rank, shared_table

SHARDS = 24
BINS = 1024
ROUNDS = 6
TOLERANCE = 1e-3
#: Added to each document's size.
OVERHEAD = 8
DIMENSIONS = ("_id", "_size", "_lang", "_source")


@dataclass
class Node:
    """Shards first to first + shards - 1; once split, a dimension, a threshold and two children."""

    first: int
    shards: int
    dim: str = ""
    threshold: float = 0.0
    below: Node | None = None
    above: Node | None = None
    search: dict = field(default_factory=dict)

    def shard(self) -> Column:
        """The first shard of the leaf (so far) that a row falls in."""
        if not self.below:
            return F.lit(self.first)
        return F.when(F.col(self.dim) < self.threshold, self.below.shard()).otherwise(self.above.shard())

    def leaves(self) -> list[Node]:
        return self.below.leaves() + self.above.leaves() if self.below else [self]


def _unit(*cols: str | Column) -> Column:
    """A hash in [0, 1)."""
    return F.xxhash64(*cols) / F.lit(2.0**64) + 0.5


def metadata(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of each document."""
    slim = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *(F.when(F.col(c).isNotNull(), _unit(F.lit(c), c)).otherwise(0.0).alias(f"_{c}") if c in df.columns else F.lit(0.0).alias(f"_{c}") for c in ("lang", "source")),
        F.monotonically_increasing_id().alias("_row"),
    )
    slim = shared_table(slim, "metadata")
    r = slim.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("size").alias("s")).first()
    low, span = float(r["a"] or 0), max(float(r["b"] or 0) - float(r["a"] or 0), 1.0)
    top = max(float(r["s"] or 2), 2.0)
    apart = _unit("doc_id", "text_crc32") * 1e-6 + _unit("_row") * 1e-12
    own = {"_id": F.coalesce((F.col("doc_id") - F.lit(low)) / span, F.lit(0.0)), "_size": F.log2("size") / F.log2(F.lit(top)), "_lang": F.col("_lang"), "_source": F.col("_source")}
    return shared_table(slim.select("doc_id", "size", "text_crc32", *((x + apart).alias(name) for name, x in own.items())), "coordinates")


def _bin(nodes: list[Node]) -> Column:
    """The bin of a row in the range that its node is searched in; null for other nodes."""
    out = F.lit(None).cast("long")
    for n in nodes:
        out = F.when(F.col("_node") == n.first, F.floor((F.col(n.dim) - n.search["low"]) / n.search["width"])).otherwise(out)
    return out


def _split(df: DataFrame, root: Node) -> bool:
    """One level: splits every leaf that stands for several shards and has bytes. False if there is none."""
    at = df.withColumn("_node", root.shard())
    sums = [F.sum("size").alias("bytes"), *(f(c).alias(f"{name}{c}") for c in DIMENSIONS for name, f in (("min", F.min), ("max", F.max)))]
    found = {r["_node"]: r for r in at.groupBy("_node").agg(*sums).collect()}  # a row for each node
    open_ = [n for n in root.leaves() if n.shards > 1 and n.first in found]
    for n in open_:
        r = found[n.first]
        n.dim = max(DIMENSIONS, key=lambda c: r[f"max{c}"] - r[f"min{c}"])
        a, b = r[f"min{n.dim}"], r[f"max{n.dim}"]
        n.search = {"low": a, "width": max(b - a, 1e-15) * (1 + 1e-9) / BINS, "before": 0, "target": r["bytes"] * (n.shards // 2) / n.shards, "close": TOLERANCE * r["bytes"] / n.shards}
    searching = open_
    for _ in range(ROUNDS):
        if not searching:
            break
        rows = at.select("_node", "size", _bin(searching).alias("bin")).where(F.col("bin").between(0, BINS - 1))
        bins: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("_node", "bin").agg(F.sum("size").alias("bytes")).collect():  # at most BINS rows for each node
            bins.setdefault(r["_node"], {})[r["bin"]] = r["bytes"]
        for n in searching:
            s, own = n.search, bins.get(n.first, {})
            for k in sorted(own):
                if s["before"] + own[k] >= s["target"]:
                    s["low"], s["weight"] = s["low"] + k * s["width"], own[k]
                    break
                s["before"] += own[k]
            else:
                s["low"], s["weight"] = s["low"] + BINS * s["width"], 0
            n.threshold = s["low"] + (s["width"] if s["target"] - s["before"] > s["weight"] / 2 else 0.0)
            s["width"] /= BINS
        searching = [n for n in searching if n.search["weight"] > n.search["close"] and n.search["width"] > 1e-16]
    for n in open_:
        half = n.shards // 2
        n.below, n.above = Node(n.first, half), Node(n.first + half, n.shards - half)
    return bool(open_)


def tree(df: DataFrame, shards: int = SHARDS) -> Node:
    """The K-d tree over rows of metadata()."""
    root = Node(0, shards)
    while _split(df, root):
        pass
    return root


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shard and its slot there, with its size and the CRC-32 of its text."""
    rows = metadata(df, id_col, text_col)
    placed = shared_table(rows.select("doc_id", "size", "text_crc32", tree(rows, shards).shard().cast("int").alias("shard")), "shards")
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    return gapless_rank(placed, "shard", ["doc_id", "text_crc32", "size"], largest).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
