"""Ordering, paging and presenting results (sort_id, file_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import format_hash_uri, short_uri
from ..functions.text import cdata, human_size
from ..storage import few
from .catalog import Catalog
from .meta import first_value


class AnchorError(LookupError):
    """The start of a page is unknown, ambiguous, or not in the result."""


def order(result: DataFrame, direction: str = "a") -> DataFrame:
    keys = ["sort_id", "file_id"]
    return result.orderBy(*keys) if direction == "a" else result.orderBy(*(F.desc(k) for k in keys))


def latest(result: DataFrame, count: int = 10) -> DataFrame:
    return order(result, "z").limit(count)


def first(result: DataFrame, direction: str = "a") -> DataFrame:
    return order(result, direction).limit(1)


def anchor(c: Catalog, result: DataFrame, uri: str) -> tuple[int, int]:
    """Position of the one file with this address in the result."""
    files = c.standing_for(c.files.sparkSession.range(1).select(F.lit(uri).alias("uri"))).select("file_id").distinct().limit(2).collect()
    if len(files) != 1:
        raise AnchorError(f"{uri} is {'ambiguous' if files else 'unknown'}")
    found = result.filter(F.col("file_id") == files[0].file_id).select("sort_id", "file_id").limit(1).collect()
    if not found:
        raise AnchorError(f"{uri} is not in the result")
    return found[0].sort_id, found[0].file_id


def anchors(c: Catalog, result: DataFrame, wanted: DataFrame) -> DataFrame:
    """uri, status, sort_id, file_id of each address in `wanted` (uri) as the start of a page of the result, many at a time.

    status: found, or why page() would refuse it: unknown (no file has the address), ambiguous (several have), absent (not in the result).
    """
    asked = wanted.select("uri").filter("uri is not null").distinct()
    files = c.standing_for(asked).groupBy("uri").agg(F.count_distinct("file_id").alias("files"), F.min("file_id").alias("file_id"))
    told = asked.join(files, "uri", "left").join(result.select("file_id", "sort_id"), "file_id", "left")
    status = F.when(F.col("files").isNull(), "unknown").when(F.col("files") > 1, "ambiguous").when(F.col("sort_id").isNull(), "absent").otherwise("found")
    found = lambda name: F.when(F.col("status") == "found", F.col(name)).alias(name)
    return told.withColumn("status", status).select("uri", "status", found("sort_id"), found("file_id"))


def page(c: Catalog, result: DataFrame, start: str | None = None, count: int = 50, direction: str = "a") -> DataFrame:
    """`count` rows after `start` (left out itself), with their number `at` in output order.

    `-address` walks backwards from it and a bare `-` from the newest; the rows come out in `direction` either way.
    """
    backward = bool(start) and start.startswith("-")
    uri = (start or "").removeprefix("-")
    walk = ("z" if direction == "a" else "a") if backward else direction
    if uri:
        sort_id, file_id = anchor(c, result, uri)
        here, there = F.struct("sort_id", "file_id"), F.struct(F.lit(sort_id).alias("sort_id"), F.lit(file_id).alias("file_id"))
        result = result.filter(here > there if walk == "a" else here < there)
    limited = order(result, walk).limit(count)  # top-k, no full sort
    from pyspark.sql import Window

    keys = ["sort_id", "file_id"] if direction == "a" else [F.desc("sort_id"), F.desc("file_id")]
    return limited.withColumn("at", F.row_number().over(Window.orderBy(*keys)))  # over `count` rows


def with_uri(result: DataFrame, files: DataFrame) -> DataFrame:
    """`result` with the columns of its files, and their addresses. It is put down first: a small result shuffles no files."""
    return own_uri(few(result).join(files, "file_id"))


def own_uri(files: DataFrame) -> DataFrame:
    return files.withColumn("uri", format_hash_uri("sha256", F.col("hash")))


def export_plan(c: Catalog, result: DataFrame) -> DataFrame:
    """file_id, path, escapes: smallest source-path, else ./unknown/ and the smallest title, else the hash."""
    rows = c.targets().join(c.metadata.filter("field in ('source-path', 'title')"), "meta_file_id")
    named = rows.groupBy("file_id").agg(F.min(F.when(F.col("field") == "source-path", F.col("value"))).alias("source"), F.min(F.when(F.col("field") == "title", F.col("value"))).alias("title"))
    path = F.coalesce("source", F.concat(F.lit("./unknown/"), "title"), F.concat(F.lit("./unknown/"), "hash"))
    out = few(result).join(c.files.select("file_id", "hash"), "file_id").join(named, "file_id", "left").select("file_id", path.alias("path"))
    return out.withColumn("escapes", F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"))


def preview(c: Catalog, result: DataFrame) -> DataFrame:
    """One row per file with title, description, links and a readable size."""
    named = with_uri(result.select("file_id"), c.files)
    for field, missing in (("title", "(no title)"), ("description", "(no description)")):
        values = first_value(c.metafiles, c.metadata, field).select(F.col("target_uri").alias("uri"), F.col("value").alias(field))
        named = named.join(values, "uri", "left").withColumn(field, F.coalesce(field, F.lit(missing)))
    query = lambda text: F.concat(F.lit("?q="), F.url_encode(text))
    return named.select(
        "file_id", "title", "description", F.col("uri").alias("hash_uri"), F.concat(F.lit("/file/sha256/"), "hash").alias("raw_uri"), query(F.col("uri")).alias("query_uri"),
        query(short_uri(F.col("uri"))).alias("short_uri"), query(F.concat(F.lit("link="), F.col("uri"))).alias("backlinks_uri"), human_size(F.col("size")).alias("size"),
    )


def feed(c: Catalog, result: DataFrame, content: DataFrame, count: int = 10) -> DataFrame:
    """Feed items of the newest `count` results; `content` has file_id and html."""
    rows = with_uri(latest(result, count), c.files).join(content, "file_id", "left")
    titles = first_value(c.metafiles, c.metadata, "title").select(F.col("target_uri").alias("uri"), F.col("value").alias("title"))
    rows = rows.join(titles, "uri", "left")
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    item = tag("item", F.concat(tag("title", cdata(F.coalesce("title", F.lit("(no title)")))), tag("guid", F.col("uri")), tag("description", cdata(F.coalesce("html", F.lit(""))))))
    return rows.select("sort_id", "file_id", item.alias("item"))


def meta_line(uri: Column, target: Column) -> Column:
    return F.concat_ws(" -> ", uri, target)
