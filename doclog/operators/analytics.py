"""Statistics over results and indexes, and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import put_down
from .catalog import Catalog


def stats(c: Catalog, result: DataFrame) -> DataFrame:
    rows = c.files.join(result.select("file_id"), "file_id", "left_semi")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.avg("size").alias("mean_bytes"))


def type_histogram(c: Catalog, result: DataFrame) -> DataFrame:
    return c.files.join(result.select("file_id"), "file_id", "left_semi").groupBy("type").agg(F.count("*").alias("files"))


def value_counts(c: Catalog, field: str) -> DataFrame:
    """field, value and how many files have it. Pairs are made distinct first, so a common value is no single group."""
    rows = c.metadata.filter(F.col("field") == field).join(c.targets(), "meta_file_id")
    return rows.select("field", "value", "file_id").distinct().groupBy("field", "value").agg(F.count("*").alias("files"))


def term_stats(c: Catalog) -> DataFrame:
    return c.postings.groupBy("term").agg(F.count("*").alias("documents"))


def link_graph(c: Catalog, field: str = "link") -> DataFrame:
    """src_file_id, dst_uri, dst_file_id (oldest file of that address; null for dangling links)."""
    links = c.metadata.filter(F.col("field") == field).select("meta_file_id", F.col("value").alias("dst_uri"))
    edges = links.join(c.targets(), "meta_file_id").select(F.col("file_id").alias("src_file_id"), "dst_uri").distinct()
    known = c.standing_for(links.select(F.col("dst_uri").alias("uri"))).groupBy("uri").agg(F.min("file_id").alias("dst_file_id"))
    return edges.join(known, F.col("dst_uri") == F.col("uri"), "left").select("src_file_id", "dst_uri", "dst_file_id")


def backlinks_two_hops(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(src_file_id, dst_file_id, ways): files that link to files that link to a file, and over how many; edges (src_file_id, dst_file_id).

    A file that more than `most` others link to is a hub: its backlinks are dealt over as many parts as they fill, and what it links to
    goes to each part, so no task gets a hub whole. Loops and dangling links are no hops; a file may come back to itself.
    """
    hops = put_down(edges.filter("dst_file_id is not null and src_file_id <> dst_file_id").select("src_file_id", "dst_file_id").distinct())
    hubs = hops.groupBy(F.col("dst_file_id").alias("via")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("via", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    first = hops.select("src_file_id", F.col("dst_file_id").alias("via")).join(hubs, "via", "left")
    first = first.select("src_file_id", "via", F.pmod(F.hash("src_file_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    second = hops.select(F.col("src_file_id").alias("via"), "dst_file_id").join(hubs, "via", "left")
    second = second.select("via", "dst_file_id", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return first.join(second, ["via", "part"]).groupBy("src_file_id", "dst_file_id").agg(F.count("*").alias("ways"))
