"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector. Queries are taken in blocks of bounded size; a block is broadcast, and the
vectors stay where they are: each task scores its own vectors and sends histograms only. A round counts, for each
query, scores in BINS bins of its current range; the sums over all tasks show in which bin the kth highest score lies,
and that bin is the next range, until it is one value. The last round scores again and keeps what is above the kth
score, and of what equals it as many rows as are needed, smallest ids first.

Within a task a histogram is sent from the top down to the bin that reaches the count sought: the kth score of all
vectors cannot lie below that of one task, so what is left out cannot matter. The driver holds the ranges of one block
of queries.

Nulls and edges: vectors that are null, empty or hold null or non-finite components, and null ids, take no part; a
query meets only vectors of its own dimension; rows with the query's id are its own and no candidates; an id that
repeats among queries asks once (with its smallest vector), among candidates each row counts, in whatever task it lies;
a query with fewer than k candidates returns all of them; components so large that a long could not hold every score
are an error; an empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import prepare
from tessera.sources.shared import shared_dir

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Queries that are broadcast together.
QUERIES_A_BLOCK = 4096
#: Queries and vectors that a task scores at once.
TILE = 1024
BINS = 512


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of every vector that takes part."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & whole)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("vec"), F.size(vec_col).alias("dim"))


class Block:
    """The queries of one dimension in a block, with the range in which each seeks its kth score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, largest: int):
        self.ids, self.vectors = ids, vectors
        reach = np.abs(vectors.astype(np.int64)).sum(1) * largest
        self.low, self.floor, self.high = -reach, -reach, reach + 1
        self.width = -(-(2 * reach + 1) // BINS)
        self.need = np.full(len(ids), k, np.int64)
        self.last = np.zeros(len(ids), bool)

    def open(self) -> Block:
        """Those that have not found their kth score yet."""
        out = object.__new__(Block)
        out.__dict__ = {name: x[~self.last] for name, x in self.__dict__.items()}
        return out

    def narrow(self, hits: dict[int, tuple[int, int]]) -> None:
        """hits: of queries, the bin that holds the kth score and how many of it are needed. A query without one has too few candidates and keeps all."""
        for k in np.flatnonzero(~self.last):
            if hit := hits.get(int(self.ids[k])):
                self.low[k] += hit[0] * self.width[k]
                self.high[k] = self.low[k] + self.width[k]
                self.need[k] = hit[1]
                self.last[k] = self.width[k] == 1
                self.width[k] = -(-self.width[k] // BINS)
            else:
                self.low[k], self.need[k], self.last[k] = self.floor[k] - 1, 0, True


def _tiles(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block], exact: type) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, first and end of the queries, their scores against some vectors, the vectors' ids, which are a query's own)."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in blocks}

    def scored(dim: int) -> Iterator[tuple]:
        own, block = waiting[dim], blocks[dim]
        if own:
            ids, vectors = (np.concatenate(x) for x in zip(*own, strict=True))
            own.clear()
            for a in range(0, len(block.ids), TILE):
                scores = (block.vectors[a : a + TILE].astype(exact) @ vectors.T.astype(exact)).astype(np.int64)
                yield dim, a, a + len(scores), scores, ids, block.ids[a : a + TILE, None] == ids[None, :]

    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in blocks.keys() & set(dims.tolist()):
            part = batch.filter(pa.array(dims == dim))
            for k in range(0, len(part), TILE):
                piece = part.slice(k, TILE)
                waiting[dim].append((piece.column(0).to_numpy(), piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                if sum(len(i) for i, _ in waiting[dim]) >= TILE:
                    yield from scored(dim)
    for dim in blocks:
        yield from scored(dim)


def _histograms(blocks, exact: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks.value
        counts = {dim: np.zeros((len(b.ids), BINS), np.int64) for dim, b in own.items()}
        for dim, a, e, scores, _, mine in _tiles(batches, own, exact):
            low, high, width = (x[a:e, None] for x in (own[dim].low, own[dim].high, own[dim].width))
            bins = (scores - low) // width
            bins[mine | (scores < low) | (scores >= high)] = BINS  # of no concern
            flat = bins + np.arange(len(bins))[:, None] * (BINS + 1)
            counts[dim][a:e] += np.bincount(flat.ravel(), minlength=len(bins) * (BINS + 1)).reshape(-1, BINS + 1)[:, :BINS]
        for dim, b in own.items():
            above = counts[dim][:, ::-1].cumsum(1)[:, ::-1] - counts[dim]
            row, at = np.nonzero((counts[dim] > 0) & (above < b.need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[row]), pa.array(at.astype(np.int32)), pa.array(counts[dim][row, at])], ["query_id", "bin", "n"])

    return run


def _best(blocks, exact: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks.value
        none = np.zeros(0, np.int64)
        ties = {dim: (none, none) for dim in own}
        for dim, a, e, scores, ids, mine in _tiles(batches, own, exact):
            b = own[dim]
            kth = b.low[a:e, None]
            row, at = np.nonzero((scores > kth) & ~mine)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[a + row]), pa.array(ids[at]), pa.array(scores[row, at])], ["query_id", "vec_id", "score"])
            row, at = np.nonzero((scores == kth) & ~mine & (b.need[a:e, None] > 0))
            rows, found = np.concatenate([ties[dim][0], a + row]), np.concatenate([ties[dim][1], ids[at]])
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = place < b.need[rows]
            ties[dim] = rows[keep], found[keep]
        for dim, (rows, found) in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(own[dim].ids[rows]), pa.array(found), pa.array(own[dim].low[rows])], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each query. Both inputs as quantised() gives them."""
    spark = vectors.sparkSession
    prepare(spark)
    largest, dim = vectors.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max("dim")).first()
    largest, dim = int(largest or 0), int(dim or 1)
    bound = dim * largest**2
    if bound >= 1 << 62:
        raise ValueError("components are so large that scores could not be held")
    exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    slim = "array<smallint>" if largest < 1 << 15 else "array<bigint>"
    stored = vectors.select("vec_id", F.col("vec").cast(slim).alias("vec"), "dim")

    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("vec", "dim")).alias("q")).select("query_id", F.col("q.vec").cast(slim).alias("vec"), "q.dim")
    n_blocks = max(1, -(-queries.count() // QUERIES_A_BLOCK))
    asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/asked")
    asked = spark.read.schema(f"query_id long, vec {slim}, dim int, block int").parquet(f"{folder}/asked")

    for number in range(n_blocks):
        rows = asked.where(F.col("block") == number).orderBy("query_id").toArrow()
        blocks: dict[int, Block] = {}
        for d in set(rows["dim"].to_pylist()):
            part = rows.filter(pa.array(rows["dim"].to_numpy() == d)).combine_chunks()
            blocks[d] = Block(part["query_id"].to_numpy(), part["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d), k, largest)
        while still := {d: o for d, b in blocks.items() if len((o := b.open()).ids)}:
            sent = spark.sparkContext.broadcast(still)
            need = spark.createDataFrame(pa.table({"query_id": np.concatenate([b.ids for b in still.values()]), "need": np.concatenate([b.need for b in still.values()])}))
            counts = stored.mapInArrow(_histograms(sent, exact), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
            down = W.partitionBy("query_id").orderBy(F.desc("bin"))
            upto = counts.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(need), "query_id").where("upto >= need")
            hit = upto.groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need")), "bin").alias("hit"))
            hits = {r["query_id"]: tuple(r["hit"]) for r in hit.collect()}  # no more than a block of queries
            sent.unpersist()
            for b in blocks.values():
                b.narrow(hits)
        found = stored.mapInArrow(_best(spark.sparkContext.broadcast(blocks), exact), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/best/block={number}")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*(f"{folder}/best/block={number}" for number in range(n_blocks)))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


#: The whole of op2 in SQL; pairs of the stated queries and all vectors.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
