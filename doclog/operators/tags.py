"""Tags that come and go: `t` sets a tag, `t~1` takes it back, `t~2` sets it again, and so on. Nothing in the log is ever removed.

A tag holds where the number of its levels that are there without a gap, from 0 on, is odd. Since ages never change, it holds from the
position where an even level completes the row of levels below it up to the one where the next level does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Catalog

LEVEL = r"~([1-9][0-9]*)$"


def parsed(value: Column) -> tuple[Column, Column]:
    """tag and level of a value."""
    level = F.coalesce(F.nullif(F.regexp_extract(value, LEVEL, 1), F.lit("")).cast("int"), F.lit(0))
    return F.regexp_replace(value, LEVEL, "").alias("tag"), level.alias("level")


def tag_levels(c: Catalog, field: str = "tag") -> DataFrame:
    """(file_id, tag, level, sort_id) of each value of the field that a file has."""
    said = c.metadata.filter(F.col("field") == field).select("meta_file_id", *parsed(F.col("value")))
    return said.join(c.targets(), "meta_file_id").groupBy("file_id", "tag", "level").agg(F.min("meta_file_id").alias("sort_id"))


def tag_intervals(levels: DataFrame) -> DataFrame:
    """(file_id, tag, since, until): where a tag holds, from a position on up to, but not with, another (null: to this day)."""
    own = Window.partitionBy("file_id", "tag").orderBy("level")
    rows = levels.withColumn("nth", F.row_number().over(own) - 1).filter("nth = level")
    rows = rows.withColumn("since", F.max("sort_id").over(own))
    rows = rows.withColumn("until", F.lead("since").over(own)).filter("level % 2 = 0")
    return rows.filter("until is null or until > since").select("file_id", "tag", "since", "until")


def tags_as_of(intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """(at, file_id, tag, since) of the tags that hold at each position that is asked for (tag, at), once however often it is asked."""
    wanted = asked.select("tag", "at").distinct()
    return intervals.join(wanted, "tag").filter("since <= at and (until is null or until > at)").select("at", "file_id", "tag", "since")
