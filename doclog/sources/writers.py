"""Lists and dumps; part files keep the result's order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import digests, internal_hash, parse_hash_uri, storage_prefix
from ..functions.text import embeds_in_markdown, is_text_type, links_in_markdown, links_in_text
from ..operators.catalog import Catalog, written_out
from ..operators.results import meta_line


def write_uri_list(result: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """uri of each row (sort_id, file_id, uri), range-partitioned and sorted, lines ended by CRLF."""
    lines = result.repartitionByRange("sort_id", "file_id").sortWithinPartitions("sort_id", "file_id").select("uri")
    lines.write.mode(mode).text(path, lineSep="\r\n")


def write_tree(files: DataFrame, path: str) -> int:
    """Each row (name, content binary) as a file of a tree, at its name below `path`; gives their number. The store is one that pyarrow opens.

    Tasks write the files themselves, over what a failed one has left: Spark's writers need a folder for each name, which the driver moves one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        made, n = set(), 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content.as_buffer())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return files.select("name", "content").mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_meta_list(result: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    write_uri_list(result.withColumn("uri", meta_line(F.col("uri"), F.col("target_uri"))), path, mode=mode)


def dump(files: DataFrame, metas: DataFrame, path: str) -> None:
    """file.log and meta.log, and blobs by algorithm and two-digit prefix. files: sort_id, file_id, uri, type, content."""
    write_uri_list(files.withColumn("uri", F.concat("uri", F.lit("?type="), F.url_encode("type"))), f"{path}/file.log")
    write_meta_list(metas, f"{path}/meta.log")
    parsed = parse_hash_uri(F.col("uri"))
    blobs = files.select("uri", "content", parsed.algo.alias("algo"), storage_prefix(parsed.hash).alias("prefix"))
    blobs.repartition("algo", "prefix").write.partitionBy("algo", "prefix").parquet(f"{path}/blobs")


class Converter(NamedTuple):
    """What turns a text of some types into links and embeds, as columns."""

    fits: Callable[[Column], Column]
    links: Callable[[Column], Column]
    embeds: Callable[[Column], Column]

    def rows(self, files: DataFrame) -> DataFrame:
        return files.select("uri", F.explode(fields_of(self.links(F.col("content")), self.embeds(F.col("content")), F.col("content"))).alias("f")).select("uri", "f.field", "f.value")


class TableConverter(NamedTuple):
    """A converter of one's own: a Python table function of (type, content) that gives any number of rows (field, value) for a text."""

    fits: Callable[[Column], Column]
    function: type

    def rows(self, files: DataFrame) -> DataFrame:
        made = F.udtf(self.function, returnType="field string, value string", useArrow=True)
        return files.lateralJoin(made(F.col("type").outer(), F.col("content").outer())).select("uri", "field", "value").filter("field is not null and value is not null")


NONE = lambda body: F.array().cast("array<string>")
#: The first whose test of the type holds is used.
CONVERTERS: Sequence[Converter | TableConverter] = (
    Converter(lambda t: F.lower(t).rlike(r"^text/(x-)?markdown\b"), links_in_markdown, embeds_in_markdown),
    Converter(is_text_type, links_in_text, NONE),
)


def fields_of(links: Column, embeds: Column, content: Column) -> Column:
    """Fields of a converted text; null where it is refused."""
    pair = lambda name: lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"))
    return F.concat(F.transform(links, pair("link")), F.transform(embeds, pair("embed")), F.array(pair("fulltext")(content)))


def fulltext_meta(files: DataFrame, converters: Sequence[Converter] = CONVERTERS) -> DataFrame:
    """target_uri and fields (link, embed, fulltext) of a meta-file for each text file (uri, type, content string)."""
    links, embeds, any_ = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(False)
    for c in reversed(converters):
        own = c.fits(F.col("type"))
        links, embeds, any_ = F.when(own, c.links(F.col("content"))).otherwise(links), F.when(own, c.embeds(F.col("content"))).otherwise(embeds), any_ | own
    return files.filter(any_).select(F.col("uri").alias("target_uri"), fields_of(links, embeds, F.col("content")).alias("fields")).filter("fields is not null")


def converted(files: DataFrame, converters: Sequence[Converter | TableConverter] = CONVERTERS) -> DataFrame:
    """target_uri, field, value of files (uri, type, content string): a row for each value, by the first converter that fits the type.

    Converters may be columns or table functions in Python; only files that come to a table function go through Python. A null type
    fits none.
    """
    which = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(converters))):
        which = F.when(c.fits(F.col("type")), k).otherwise(which)
    dealt = files.select("uri", "type", "content", which.alias("which"))
    parts = [c.rows(dealt.filter(F.col("which") == k)) for k, c in enumerate(converters)]
    return reduce(DataFrame.union, parts).withColumnRenamed("uri", "target_uri")


def reprocess(files: DataFrame, path: str, converters: Sequence[Converter] = CONVERTERS) -> None:
    """Run extraction over existing files again and append what it gives."""
    fulltext_meta(files, converters).write.mode("append").parquet(path)


def save_table(rows: DataFrame, root: str, name: str, keys: list[str], *, spread: bool = False) -> None:
    """Write a table clustered by its lookup keys, so that equality filters skip row groups; `spread`: sorted over all its files."""
    rows = rows.repartitionByRange(*keys) if spread else rows
    rows.sortWithinPartitions(*keys).write.mode("append").parquet(f"{root}/{name}")


def load_catalog(spark: SparkSession, root: str, *, texts: bool = False, stems: bool = False) -> Catalog:
    """The tables of a log below a folder, those made of full texts where they are asked for.

    Files and addresses are columns of `blobs`, or follow from the contents in `metas`; postings are columns of `places`.
    """
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    blobs, metas = read("blobs"), read("metas")
    content = F.col("content").cast("binary")
    made = metas.select("file_id", internal_hash(content).alias("hash"), "type", F.octet_length(content).cast("long").alias("size"), digests(content).alias("digests"))
    whole = blobs.select(*made.columns).union(made)
    valid, places = metas.filter("valid").withColumnRenamed("file_id", "meta_file_id"), read("places") if texts else None
    return Catalog(
        whole.select("file_id", "hash", "type", "size"), written_out(whole), valid.select("meta_file_id", "target_uri"), read("metadata"), places.select("term", "meta_file_id") if texts else None,
        read("stems") if stems else None, places, whole.select("file_id", "hash", "type", "digests"), read("targets"), valid.select("meta_file_id", "target_uri", internal_hash(content).alias("hash")),
    )
