"""What the operators share: tables in the cluster's shared folder, and code on the executors."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import settled

#: Spark's setting by which an execution drops its shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one Arrow batch. Texts can be long, so a batch is far smaller than Spark's default of 10,000 rows.
BATCH_ROWS = 400
#: A batch of long texts ends sooner, once it holds so many bytes.
BATCH_BYTES = 16 << 20

_shipped: set[str] = set()
_kept: dict[str, dict] = {}


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, as a Parquet table of the shared folder: lineage ends here, and a lost executor costs nothing. Shuffle files of the step go with it, where Spark can drop them."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        return settled(df, name)
    finally:
        spark.conf.set(CLEAN_UP, before)


def prepare(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, and bounds the rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def keep(name: str) -> dict:
    """What an operator keeps in a Python worker from task to task."""
    return _kept.setdefault(name, {})


def release(own: str = "") -> None:
    """Drops what operators other than `own` keep in this process, and gives freed memory back to the system."""
    for name, held in _kept.items():
        if name != own:
            held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidy(run: Callable, own: str = "") -> Callable:
    """run, for mapInArrow, in a worker that holds no more than its own tables: workers outlive a task and serve each operator in turn, so what all of them left would add up."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(own)
        yield from run(batches)
        release(own)

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """Every third document, by the CRC of its id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gapless_rank(df: DataFrame, group: str, order: list[str], largest: int, rows_a_task: int = 100_000) -> DataFrame:
    """df with `rank`: from 0, without gaps, within each value of `group`.

    A group can hold a third of all rows, so it is dealt into sub-groups by a hash of the order columns; each is
    numbered by itself and starts where the one before ends. `largest`: rows of the largest group."""
    from pyspark.sql import Window as W

    subs = max(1, -(-largest // rows_a_task))
    dealt = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(subs)))
    starts = (
        dealt.groupBy(group, "_sub")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(W.partitionBy(group).orderBy("_sub")) - F.col("_n"))
        .select(F.col(group).alias("_g"), F.col("_sub").alias("_s"), "_start")
    )
    own = F.row_number().over(W.partitionBy(group, "_sub").orderBy(*order)) - 1
    numbered = dealt.withColumn("_own", own.cast("long"))
    return (
        numbered.join(starts, (F.col(group) == F.col("_g")) & (F.col("_sub") == F.col("_s")))
        .withColumn("rank", F.col("_own") + F.col("_start"))
        .drop("_sub", "_own", "_g", "_s", "_start")
    )
