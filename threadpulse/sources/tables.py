"""Tables: written and read again, checked, profiled."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names; unset, a temporary folder will do for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "threadpulse-shared")
    return f"{base.rstrip('/')}/threadpulse-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """The frame written as a table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raises before any job where columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def optional_table(spark: SparkSession, name: str, schema) -> DataFrame:
    """A catalog table, or no rows of the schema where it is absent."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def save_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format("parquet")
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)


def infer_types(df: DataFrame) -> DataFrame:
    """column, inferred: INTEGER where every value that isn't blank parses as a whole number, else REAL as a number, else TEXT; all blank is TEXT. One pass over text columns."""
    parts = []
    for c in df.columns:
        v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        bad = lambda t, v=v: F.count_if(v.isNotNull() & v.try_cast(t).isNull())
        whole = F.count_if(v.isNotNull() & ~v.rlike("^[+-]?[0-9]+$"))
        parts.append(F.struct(F.lit(c).alias("column"), F.when(F.count(v) == 0, "TEXT").when(whole == 0, "INTEGER").when(bad("double") == 0, "REAL").otherwise("TEXT").alias("inferred")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exclude(df: DataFrame, names: list[str], column: str = "community") -> DataFrame:
    """Rows outside of the named communities; case and a leading r/ don't count."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), "(?i)^r/", ""))
    return df.where(~F.coalesce(norm(F.col(column)).isin(*[n.strip().lower().removeprefix("r/") for n in names]), F.lit(False)))
