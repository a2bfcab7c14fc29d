"""Meta-files: a target address, a blank line, and a JSON map of fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_time, porter_stem, tokens

META_TYPES = ("application/vnd.doclog.meta", "text/x-doclog-meta", "text/doclog-meta")
META_LIMIT = 1 << 20


def is_meta(kind: Column, types: tuple[str, ...] = META_TYPES) -> Column:
    return F.lower(kind).isin(*types)


def select_meta(files: DataFrame, types: tuple[str, ...] = META_TYPES) -> DataFrame:
    return files.filter(is_meta(F.col("type"), types))


def split_target(metas: DataFrame) -> DataFrame:
    """`metas` (content) with target_uri (null if invalid) and body: the first line, cut at 1023 bytes, and what follows."""
    line = F.regexp_extract("content", r"^([^\r\n]{0,1023})", 1)
    target = F.when((line != "") & ~F.contains(line, F.lit("\0")), line)
    return metas.withColumn("target_uri", target).withColumn("body", F.regexp_replace("content", r"^[^\r\n]*[\r\n]*", ""))


def _scan_prefix(body: str) -> list[dict]:
    """Pairs that are complete in a JSON object which may be cut anywhere."""
    import json
    import re

    out, depth, key, at = [], 0, None, 0
    decoder = json.JSONDecoder(strict=False)
    while at < len(body):
        c = body[at]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == '"':
            try:
                text, at = decoder.raw_decode(body, at)
            except ValueError:
                break
            after = re.compile(r"\s*(.)?", re.S).match(body, at)[1]
            if after == ":" and depth == 1:
                key = text
            elif (depth == 2 and after == ":" or depth == 1 and after in (",", "}")) and key is not None:
                out.append({"field": key, "value": text})
            continue
        at += 1
    return out


def over_limit_pairs(body: Column) -> Column:
    def scan(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else _scan_prefix(b))

    return F.pandas_udf(scan, "array<struct<field: string, value: string>>")(body)


def flatten_meta(metas: DataFrame) -> DataFrame:
    """`metas` with fields: array of struct(field, value), or null where the body is rejected.

    Top-level keys with a string, or with each key of their map; deeper levels are ignored, repeated keys all count. Numbers,
    booleans, nulls and arrays at any depth reject the meta-file, and so do unclosed bodies, unless the content is over 1 MiB: then
    the pairs complete before the cut count.
    """
    body, large, strict_json = F.col("body"), F.octet_length("content") > META_LIMIT, {"allowSingleQuotes": "false"}
    entries = lambda text: F.map_entries(F.from_json(text, "map<string,string>", strict_json))
    # the body without its strings: braces, colons, commas and a mark for each string; anything else is a value of another type
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\\[\s\S]", ""), r'"[^"]*"', '"'), r"[ \t\r\n]", "")
    braces = F.filter(F.split(F.regexp_replace("bare", "[^{}]", ""), ""), lambda c: c != "")

    def walk(s: Column, c: Column) -> Column:
        opens = c == "{"
        inside = (s.depth > 0) | ~s.begun
        return F.struct((s.depth + F.when(opens, 1).otherwise(-1)).alias("depth"), (s.maps + F.when(opens & (s.depth == 1), 1).otherwise(0)).alias("maps"), (s.whole & inside).alias("whole"), F.lit(True).alias("begun"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("maps"), F.lit(True).alias("whole"), F.lit(False).alias("begun"))
    # most bodies have no braces inside: nothing to walk over
    flat = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("maps"), F.lit(True).alias("whole"), F.lit(True).alias("begun"))
    shape = F.when(F.col("bare").rlike(r"^\{[^{}]*\}$"), flat).otherwise(F.aggregate(braces, start, walk))
    told = metas.withColumn("bare", bare).withColumn("shape", shape).withColumn("outer", entries(body))
    whole = F.col("bare").rlike(r'^\{[{}:,"]*\}$') & F.col("shape.whole") & (F.col("shape.depth") == 0) & F.col("outer").isNotNull()
    # a value that starts with a brace is a map, unless some strings do as well: the scan tells those bodies' strings and maps apart
    braced = F.size(F.filter("outer", lambda e: e.value.startswith("{")))
    plain = (F.col("shape.maps") == 0) | (F.col("shape.maps") == braced)
    names = lambda e: F.when((F.col("shape.maps") > 0) & e.value.startswith("{"), F.transform(entries(e.value), lambda n: n.key)).otherwise(F.array(e.value))
    built = F.flatten(F.transform("outer", lambda e: F.transform(names(e), lambda v: F.struct(e.key.alias("field"), v.alias("value")))))
    cut_body = F.regexp_replace(F.expr(f"make_valid_utf8(cast(substring(cast(content as binary), 1, {META_LIMIT}) as string))"), r"^[^\r\n]*[\r\n]*", "")
    scanned = over_limit_pairs(F.when(large, cut_body).when(whole & ~plain, body))
    return told.withColumn("fields", F.when(large, scanned).when(whole, F.when(plain, built).otherwise(scanned))).drop("bare", "shape", "outer")


def add_metadata(rows: DataFrame) -> DataFrame:
    """Distinct (meta_file_id, field, value) with a value; `rows` has meta_file_id and fields, one row for each meta-file, so nothing is shuffled."""
    flat = rows.select("meta_file_id", F.explode(F.array_distinct("fields")).alias("f")).select("meta_file_id", "f.field", "f.value")
    return flat.filter("value <> ''")


def judge_parse(metas: DataFrame) -> DataFrame:
    """`metas` as flatten_meta() gives them, with reason: why one is rejected by what it says, else null.

    target: no valid first line; json: the body is no JSON, or is cut below the limit (so does one that repeats a key, if it has a value
    of another kind); kind: some value, at any depth, is a number, a boolean, a null or an array, or the body is no map.
    """
    bad = F.when(F.try_parse_json("body").isNotNull(), "kind").otherwise("json")
    return metas.withColumn("reason", F.when(F.col("target_uri").isNull(), "target").when(F.col("fields").isNull(), bad))


def first_of(found: DataFrame) -> DataFrame:
    """target_uri, file_id, of_meta: the oldest file of each address in `found` (uri, file_id, of_meta)."""
    return found.groupBy("uri").agg(F.min(F.struct("file_id", "of_meta")).alias("first")).select(F.col("uri").alias("target_uri"), "first.*")


def judge_target(judged: DataFrame, first: DataFrame) -> DataFrame:
    """`judged` (meta_file_id, target_uri, reason, ...) with reason 412 where the target's first file (target_uri, file_id, of_meta) isn't there yet, or is a meta-file."""
    known = judged.join(first, "target_uri", "left")
    good = (F.col("file_id") < F.col("meta_file_id")) & ~F.col("of_meta")
    return known.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(good, F.lit(False)), "412"))).drop("file_id", "of_meta")


def validate_target(metas: DataFrame, uris: DataFrame, known_metas: DataFrame) -> DataFrame:
    """`metas` (meta_file_id, target_uri) whose target is an older file, its oldest one no meta-file."""
    older = metas.join(uris, F.col("target_uri") == F.col("uri")).filter("file_id < meta_file_id")
    oldest = older.groupBy("meta_file_id").agg(F.min("file_id").alias("oldest"))
    good = oldest.join(known_metas.select(F.col("meta_file_id").alias("oldest")), "oldest", "left_anti")
    return metas.join(good.select("meta_file_id"), "meta_file_id", "left_semi")


def first_unique(metafiles: DataFrame) -> DataFrame:
    return metafiles.groupBy("target_uri").agg(F.min("meta_file_id").alias("meta_file_id"))


def merge_meta(metafiles: DataFrame, metadata: DataFrame) -> DataFrame:
    """target_uri, fields: the union of all values per field (sorted), full texts left out."""
    rows = metafiles.join(metadata.filter("field <> 'fulltext'"), "meta_file_id")
    each = rows.groupBy("target_uri", "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return each.groupBy("target_uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values")))).alias("fields"))


def first_value(metafiles: DataFrame, metadata: DataFrame, field: str) -> DataFrame:
    """target_uri, value: smallest value in the earliest meta-file of exactly that address that has the field."""
    rows = metafiles.join(metadata.filter(F.col("field") == field), "meta_file_id")
    return rows.groupBy("target_uri").agg(F.min_by("value", F.struct("meta_file_id", "value")).alias("value"))


def make_submission_meta(files: DataFrame, title: Column, submitter: str, repository: str, when: Column, software: str) -> DataFrame:
    """target_uri and fields of a meta-file for each file (uri)."""
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))
    fields = F.array(pair("title", title), pair("submitter-name", F.lit(submitter)), pair("submitter-repo", F.lit(repository)), pair("submission-time", iso_time(when)), pair("submission-software", F.lit(software)), pair("fulltext", title))
    return files.select(F.col("uri").alias("target_uri"), fields.alias("fields"))


def add_tags(result: DataFrame, tags: list[str]) -> DataFrame:
    """target_uri and content of a meta-file that tags each result (uri); `tags` is a literal list."""
    body = "{" + '"tag":{' + ",".join(f'"{t}":{{}}' for t in tags) + "}}"
    return result.select(F.col("uri").alias("target_uri"), F.concat("uri", F.lit("\n\n" + body)).alias("content"))


def build_postings(texts: DataFrame) -> DataFrame:
    """Distinct (term, meta_file_id); `texts` has meta_file_id and fulltext."""
    return texts.select(F.explode(F.array_distinct(tokens(F.col("fulltext")))).alias("term"), "meta_file_id")


def build_places(texts: DataFrame) -> DataFrame:
    """term, meta_file_id, positions: where each term stands in a text, ascending; `texts` has meta_file_id and fulltext."""
    flat = texts.select("meta_file_id", F.posexplode(tokens(F.col("fulltext"))).alias("at", "term"))
    return flat.groupBy("term", "meta_file_id").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def stem(word: Column) -> Column:
    def each(words: pd.Series) -> pd.Series:
        return words.map(porter_stem)

    return F.pandas_udf(each, "string")(word)


def stemmed(postings: DataFrame) -> DataFrame:
    """Postings under stems; only distinct terms go through the stemmer."""
    stems = postings.select("term").distinct().withColumn("stem", stem(F.col("term")))
    return postings.join(stems, "term").select(F.col("stem").alias("term"), "meta_file_id").distinct()
