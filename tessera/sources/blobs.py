"""External values: a file for each (entity, attribute, key), written to a stage and moved in place on commit."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlobStore:
    """A driver-side folder, as the values that one save writes; reading them all is distributed (`table`)."""

    def __init__(self, folder: str):
        self.folder, self.staged = Path(folder), {}
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, entity: str, attribute: str, key: str) -> Path:
        return self.folder / entity / attribute / f"{key}.bin"

    def put(self, entity: str, attribute: str, key: str, data: bytes | None) -> None:
        """Stages a value; None stages a removal."""
        self.staged[self.path(entity, attribute, key)] = data

    def commit(self) -> None:
        """All or nothing: files that are replaced are kept aside until every new one is in place."""
        kept: list[tuple[Path, Path | None]] = []
        try:
            for p, data in self.staged.items():
                p.parent.mkdir(parents=True, exist_ok=True)
                backup = p.with_suffix(".old") if p.exists() else None
                if backup:
                    p.rename(backup)
                kept.append((p, backup))
                if data is not None:
                    new = p.with_suffix(".new")
                    new.write_bytes(data)
                    new.rename(p)
        except OSError:
            for p, backup in reversed(kept):
                p.unlink(missing_ok=True)
                if backup:
                    backup.rename(p)
            raise
        for _, backup in kept:
            if backup:
                backup.unlink()
        self.staged = {}

    def rollback(self) -> None:
        self.staged = {}

    def get(self, entity: str, attribute: str, key: str) -> bytes | None:
        """A value; None for a missing file."""
        p = self.path(entity, attribute, key)
        return p.read_bytes() if p.exists() else None

    def erase(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def table(self, spark: SparkSession, entity: str, attribute: str) -> DataFrame:
        """(pk, value) of every file of an attribute."""
        at = self.folder / entity / attribute
        at.mkdir(parents=True, exist_ok=True)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(str(at))
        return files.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("pk"), F.col("content").alias("value"))


def relocate_out(df: DataFrame, key: str, column: str, folder: str) -> DataFrame:
    """Moves a column's values into a Parquet side table of the folder and leaves a marker."""
    df.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("pk"), F.col(column).alias("value")).write.mode("overwrite").parquet(folder)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.concat(F.lit("external:"), F.col(key).cast("string"))))


def relocate_in(df: DataFrame, key: str, column: str, folder: str) -> DataFrame:
    """Takes the values of a side table back into the column."""
    side = df.sparkSession.read.parquet(folder).toDF("_pk", "_value")
    columns = df.columns
    return df.join(side, F.col(key).cast("string") == F.col("_pk"), "left").withColumn(column, F.col("_value")).select(columns)
