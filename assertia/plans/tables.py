"""Written tables in the shared folder: how loops cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a join's side may have for Spark to broadcast it: some MB in the driver.
FEW = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``. Unset, a local session gets a temporary one;
    on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="assertia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/assertia/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, its size is known, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A join's side that is dealt to tasks by its key, not broadcast, unless it is known to have few rows. Spark judges by the size of files, and a few compressed
    megabytes can be millions of ids, of which the driver would build a table."""
    return df if rows is not None and rows <= FEW else df.hint("merge")
