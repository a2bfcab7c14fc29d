"""What one log still has to fetch from others, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import put_down
from . import filters
from .catalog import Catalog


def sync_plan(src: DataFrame, dst_uris: DataFrame) -> DataFrame:
    """Rows of `src` (source_id, uri, ...) that the destination lacks; one plan for all sources."""
    return src.join(dst_uris.select("uri"), "uri", "left_anti")


def sync_meta_plan(metas: DataFrame, synced: DataFrame, dst_uris: DataFrame) -> DataFrame:
    """Meta-files (source_id, uri, target_uri) that are missing and whose target came from the same source."""
    missing = metas.join(dst_uris.select("uri"), "uri", "left_anti")
    return missing.join(synced.select("source_id", F.col("uri").alias("target_uri")), ["source_id", "target_uri"], "left_semi")


def sync_order(files: DataFrame, metas: DataFrame) -> DataFrame:
    """All steps: each file (source_id, position, uri) and then its meta-files (source_id, hint_id, uri, target_uri)."""
    own = files.select("source_id", "position", F.lit(0).alias("is_meta"), F.lit(0).cast("long").alias("hint_id"), "uri")
    at = files.select("source_id", F.col("uri").alias("target_uri"), "position")
    held = metas.join(at, ["source_id", "target_uri"]).select("source_id", "position", F.lit(1).alias("is_meta"), F.col("hint_id").cast("long").alias("hint_id"), "uri")
    return own.union(held).orderBy("source_id", "position", "is_meta", "hint_id")


def sync_closure(edges: DataFrame, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(file_id, depth): the wanted files and all that they depend on, step by step, which the destination lacks.

    edges (src_file_id, dst_file_id) say what depends on what, held (file_id) is at the destination: it is neither fetched nor looked
    into. Each round reads the dependencies of the files that the last one found first, until none are new, so cycles end. Rounds are
    put down: the next one starts from a table. So are the edges, without those to what is held: no round works them out again.
    """
    known = edges.filter("dst_file_id is not null").select("src_file_id", "dst_file_id").distinct()
    steps = put_down(known.join(held.select(F.col("file_id").alias("dst_file_id")), "dst_file_id", "left_anti").select("src_file_id", "dst_file_id"))
    reached = put_down(wanted.select("file_id").distinct().join(held.select("file_id"), "file_id", "left_anti").withColumn("depth", F.lit(0)))
    newest, depth = reached, 0
    while not newest.isEmpty():
        depth += 1
        found = steps.join(newest.select(F.col("file_id").alias("src_file_id")), "src_file_id").select(F.col("dst_file_id").alias("file_id")).distinct()
        newest = put_down(found.join(reached.select("file_id"), "file_id", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.union(newest)
    return reached


def pull_sets(c: Catalog, pulls: DataFrame, clauses: DataFrame, holdings: DataFrame, dst_uris: DataFrame) -> DataFrame:
    """(pull_id, source_id, sort_id, file_id, uri): what each pull has to fetch from its source, one plan for all; sort_id is its order.

    pulls (pull_id, source_id) ask sources for queries of their own: clauses are those of many_queries(), by query_id = pull_id.
    holdings (source_id, file_id, uri) are the sources' files. All pulls of all sources look up their clauses together; a file that
    several pulls of a source ask for is fetched by the first of them, and none that the destination has (dst_uris: uri).
    """
    found = filters.many_queries(c, clauses).withColumnRenamed("query_id", "pull_id").join(pulls.select("pull_id", "source_id"), "pull_id")
    lacking = holdings.join(dst_uris.select("uri"), "uri", "left_anti")
    once = found.join(lacking, ["source_id", "file_id"]).groupBy("source_id", "file_id").agg(F.min(F.struct("pull_id", "sort_id", "uri")).alias("x"))
    return once.select("x.pull_id", "source_id", "x.sort_id", "file_id", "x.uri")
