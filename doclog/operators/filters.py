"""Filters: each gives (sort_id, file_id), a file once, at the log position where it first satisfies the filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, first_token, porter_stem, split_tokens
from ..storage import put_down
from .catalog import Catalog, synonyms


def _itself(rows: DataFrame, name: str = "file_id") -> DataFrame:
    """Rows of tables that hold a file once at most."""
    return rows.select(F.col(name).alias("sort_id"), F.col(name).alias("file_id"))


def _earliest(c: Catalog, metas: DataFrame) -> DataFrame:
    """Files that the meta-files (meta_file_id) target, at the earliest of these."""
    return metas.join(c.targets(), "meta_file_id").groupBy("file_id").agg(F.min("meta_file_id").alias("sort_id")).select("sort_id", "file_id")


def all_files(c: Catalog) -> DataFrame:
    return _itself(c.files)


def visible(c: Catalog) -> DataFrame:
    return c.targets().groupBy("file_id").agg(F.min("meta_file_id").alias("sort_id")).select("sort_id", "file_id")


def meta_files(c: Catalog) -> DataFrame:
    return _itself(c.metafiles, "meta_file_id")


def _one(c: Catalog, uri: str) -> DataFrame:
    return c.files.sparkSession.range(1).select(F.lit(uri).alias("uri"))


def by_uri(c: Catalog, uri: str) -> DataFrame:
    return _itself(c.standing_for(_one(c, uri)))


def by_target(c: Catalog, uri: str) -> DataFrame:
    return _itself(c.metafiles.filter(F.col("target_uri") == uri), "meta_file_id")


def by_type(c: Catalog, kind: str) -> DataFrame:
    return _itself(c.files.filter(F.col("type") == kind))


def fulltext(c: Catalog, text: str) -> DataFrame:
    """Files with a meta-file that holds the first token of `text`; later tokens are ignored, none is an error.

    A log with stems is searched for the token's stem, another one for the token.
    """
    words = split_tokens(text)
    if not words:
        raise ValueError(f"no token in {text!r}")
    if c.stems is None:
        return _earliest(c, c.postings.filter(F.col("term") == words[0]).select("meta_file_id"))
    return _earliest(c, c.stems.filter(F.col("term") == porter_stem(words[0])).select("meta_file_id"))


def phrase(c: Catalog, places: DataFrame, text: str) -> DataFrame:
    """Files with a meta-file that holds all tokens of `text` in a row; `places` has term, meta_file_id and positions.

    Only the rows of its terms are read. Positions of the k-th token, less k, are places where the phrase may start; where all
    tokens' places meet, it does.
    """
    words = split_tokens(text)
    if not words:
        raise ValueError(f"no token in {text!r}")
    shifts = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(words)))
    mine = F.transform(F.filter(shifts, lambda x: x.w == F.col("term")), lambda x: F.struct(x.k.alias("k"), F.transform("positions", lambda p: p - x.k).alias("starts")))
    each = places.filter(F.col("term").isin(*set(words))).select("meta_file_id", F.explode(mine).alias("x"))
    whole = each.groupBy("meta_file_id").agg(F.collect_list("x.starts").alias("starts")).filter(F.size("starts") == len(words))
    meet = F.aggregate("starts", F.get("starts", F.lit(0)), F.array_intersect)
    return _earliest(c, whole.filter(F.size(meet) > 0).select("meta_file_id"))


def metadata(c: Catalog, field: str, value: str, ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        same = (ascii_lower(F.col("field")) == field.lower()) & (ascii_lower(F.col("value")) == value.lower())
    else:
        same = (F.col("field") == field) & (F.col("value") == value)
    return _earliest(c, c.metadata.filter(same).select("meta_file_id"))


def links_to(c: Catalog, uri: str) -> DataFrame:
    """Files with a link to any address of the file that `uri` stands for: at most the addresses of one file."""
    wanted = synonyms(c.uris, _one(c, uri)).select(F.col("synonym").alias("value"))
    return _earliest(c, c.metadata.filter("field = 'link'").join(wanted, "value", "left_semi").select("meta_file_id"))


def linked_from(c: Catalog, uri: str) -> DataFrame:
    """Files that those with address `uri` link to, at the earliest such link."""
    sources = c.standing_for(_one(c, uri)).select("file_id")
    metas = c.targets().join(sources, "file_id", "left_semi").select("meta_file_id").distinct()
    links = c.metadata.filter("field = 'link'").join(metas, "meta_file_id", "left_semi")
    known = c.standing_for(links.select(F.col("value").alias("uri")))
    found = links.join(known, F.col("value") == F.col("uri"))
    return found.groupBy("file_id").agg(F.min("meta_file_id").alias("sort_id")).select("sort_id", "file_id")


def all_of(*parts: DataFrame) -> DataFrame:
    """Files in every part, at the latest of their positions: one shuffle whatever the number of parts."""
    if len(parts) == 1:
        return parts[0]
    tagged = reduce(DataFrame.union, (p.select("sort_id", "file_id", F.lit(k).alias("part")) for k, p in enumerate(parts)))
    found = tagged.groupBy("file_id").agg(F.count_distinct("part").alias("n"), F.max("sort_id").alias("sort_id"))
    return found.filter(F.col("n") == len(parts)).select("sort_id", "file_id")


def any_of(*parts: DataFrame) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.union, (p.select("sort_id", "file_id") for p in parts)).groupBy("file_id").agg(F.min("sort_id").alias("sort_id")).select("sort_id", "file_id")


def without(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Drop files that the negated part had matched at or before their position."""
    n = negative.select(F.col("file_id").alias("gone_id"), F.col("sort_id").alias("gone_at"))
    return positive.join(n, (F.col("file_id") == F.col("gone_id")) & (F.col("gone_at") <= F.col("sort_id")), "left_anti")


def many_queries(c: Catalog, clauses: DataFrame) -> DataFrame:
    """(query_id, sort_id, file_id) of a table of saved queries, each an AND of groups of ORed clauses.

    clauses: query_id, group_id, kind ('metadata' or 'fulltext'), field, value, negated. A negated group removes files that any
    of its clauses had matched at or before the position of the rest; a query of negated groups alone gives nothing.

    Each distinct clause is looked up once, whatever the number of queries that share it. A query starts from the positive group with
    the fewest matches; its other groups meet only the files that are left.
    """
    word = F.when(F.col("kind") == "fulltext", F.coalesce(first_token(F.col("value")), F.lit(""))).otherwise(F.col("value"))
    asked = clauses.select("query_id", "group_id", "kind", F.when(F.col("kind") == "metadata", F.col("field")).otherwise("").alias("field"), word.alias("value"), "negated")
    wanted = asked.select("kind", "field", "value").distinct()
    meta = wanted.filter("kind = 'metadata'").join(c.metadata, ["field", "value"]).select("kind", "field", "value", "meta_file_id")
    full = wanted.filter("kind = 'fulltext'").join(c.postings.select(F.col("term").alias("value"), "meta_file_id"), "value").select("kind", "field", "value", "meta_file_id")
    own = ["kind", "field", "value"]
    ages = put_down(meta.union(full).join(c.targets(), "meta_file_id").groupBy(*own, "file_id").agg(F.min("meta_file_id").alias("age")))  # used three times
    sizes = ages.groupBy(*own).agg(F.count("*").alias("files"))
    groups = asked.join(sizes, own, "left").groupBy("query_id", "group_id", "negated").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    plans = groups.groupBy("query_id").agg(F.min(F.when(~F.col("negated"), F.struct("files", "group_id"))).alias("rarest"), F.count_if(~F.col("negated")).alias("needed"), F.count_if(~F.col("negated") & (F.col("files") == 0)).alias("empty"))
    live = asked.join(plans.filter("rarest is not null and empty = 0").select("query_id", "rarest.group_id", "needed").withColumnRenamed("group_id", "first"), "query_id")
    seeds = live.filter("group_id = first").join(ages, own).groupBy("query_id", "needed", "file_id").agg(F.min("age").alias("age"))
    rest = live.filter("group_id <> first").select("query_id", "group_id", "negated", *own)
    # files of the rarest group meet the query's other clauses, and those the clauses' ages by file: no clause meets all its files
    met = seeds.select("query_id", "file_id").join(rest, "query_id").join(ages, [*own, "file_id"])
    hits = met.groupBy("query_id", "file_id", "group_id", "negated").agg(F.min("age").alias("age"))
    plus = ~F.col("negated")
    each = hits.groupBy("query_id", "file_id").agg(F.count_if(plus).alias("n"), F.max(F.when(plus, F.col("age"))).alias("latest"), F.min(F.when(~plus, F.col("age"))).alias("gone_at"))
    found = seeds.join(each, ["query_id", "file_id"], "left").withColumn("sort_id", F.greatest("age", F.coalesce("latest", "age")))
    good = found.filter("coalesce(n, 0) = needed - 1 and (gone_at is null or gone_at > sort_id)")
    return good.select("query_id", "sort_id", "file_id")
