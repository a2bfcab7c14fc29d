"""Checks of stored content against its addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import ALGORITHMS, parse_hash_uri


def verify_content(rows: DataFrame, algorithms: dict = ALGORITHMS) -> DataFrame:
    """`rows` (uri, content, size) with ok: the content has the address's hash, by the address's algorithm, and its length."""
    parsed, content = parse_hash_uri(F.col("uri")), F.col("content").cast("binary")
    digest = reduce(lambda other, a: F.when(parsed.algo == a[0], a[1][1](content)).otherwise(other), algorithms.items(), F.lit(None).cast("string"))
    same = F.startswith(digest, F.lower(parsed.hash)) & (F.length(parsed.hash) >= 24) & (F.octet_length(content) == F.col("size"))
    return rows.withColumn("ok", F.coalesce(same, F.lit(False)))


def verify_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(~F.col("ok")).alias("bad"), F.count("*").alias("total"))


def verify_list(listed: DataFrame, uris: DataFrame) -> DataFrame:
    """Listed addresses that stand for no file."""
    return listed.select("uri").join(uris.select("uri"), "uri", "left_anti").distinct()


def missing_blobs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalogued files (hash) without a blob in the listing (hash)."""
    return files.join(listing.select("hash"), "hash", "left_anti")
