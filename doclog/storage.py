"""Tables put down in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"  # a local master is one machine
    return f"{root}/doclog-{uuid.uuid4().hex}"


def put_down(rows: DataFrame) -> DataFrame:
    """`rows` as a table there: what is used more than once is made once, and survives executors."""
    path = shared(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Narrow rows that are broadcast at most.
FEW = 200_000


def few(rows: DataFrame) -> DataFrame:
    """`rows`, narrow ones, as a table there; what they are joined with is not shuffled where they are at most FEW.

    Until they are put down Spark takes them for as many as what they come from, and shuffles both sides before it knows better.
    """
    held = put_down(rows)
    return F.broadcast(held) if held.count() <= FEW else held
