"""Trees, lists and dumps as DataFrames."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.address import format_hash_uri
from ..functions.text import is_text_type, natural_key
from ..storage import put_down

DEFAULT_TYPE = "application/octet-stream"
EXCERPT = 512 * 1024
#: Files that a task reads, about, and bytes of contents that it gives on at once.
FILES, BATCH = 1024, 8 << 20


def mime_types(spark: SparkSession, types: dict[str, str] | None = None) -> DataFrame:
    """ext, type; the standard library's table by default, and Markdown."""
    table = types or {**mimetypes.types_map, ".md": "text/markdown", ".markdown": "text/markdown"}
    return spark.createDataFrame(sorted(table.items()), "ext string, type string")


def with_type(paths: DataFrame, types: DataFrame) -> DataFrame:
    """`paths` (path) with their type by extension; the table has some hundred rows, so it is broadcast."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return paths.withColumn("ext", ext).join(F.broadcast(types), "ext", "left").withColumn("type", F.coalesce("type", F.lit(DEFAULT_TYPE))).drop("ext")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _spelled(path: str) -> str:
    """A folder's path as Spark's readers give it."""
    store, root = _store(path)
    return (f"file:{root}" if isinstance(store, fs.LocalFileSystem) else path).rstrip("/")


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """name (from `path` on), size, modified of each file below a folder, but for empty ones and names that Spark's readers hide; contents are not read.

    Folders are listed by tasks, level by level, and what they hold is put down, so the driver has no list of the files. The store has to
    be one that pyarrow opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}{folder}")) if f.base_name[0] != "." and (f.base_name[0] != "_" or "=" in f.base_name) and not f.base_name.endswith("._COPYING_")]
                names = pa.array([f"{folder}/{f.base_name}" for f in found], pa.string())
                times = pa.array([f.mtime_ns // 1_000_000 * 1000 if f.mtime_ns else None for f in found], pa.timestamp("us", "UTC"))
                columns = [names, pa.array([not f.is_file for f in found], pa.bool_()), pa.array([f.size for f in found], pa.int64()), times]
                yield pa.RecordBatch.from_arrays(columns, ["name", "folder", "size", "modified"])

    tasks = spark.sparkContext.defaultParallelism
    level, files = spark.createDataFrame([("",)], "name string"), None
    while files is None or not level.isEmpty():
        found = put_down(level.repartition(tasks, "name").mapInArrow(run, "name string, folder boolean, size long, modified timestamp"))
        level, own = found.filter("folder").select("name"), found.filter("not folder and size > 0").select("name", "size", "modified")
        files = own if files is None else files.union(own)
    return files


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content, modified of each file below a folder, in natural order of path: names are sorted, and contents read in that order."""
    base = _spelled(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names, times, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([base + n for n in names], pa.string()), pa.array(data, pa.binary()), pa.array(times, pa.timestamp("us", "UTC"))], ["path", "content", "modified"])

        for batch in batches:
            rows, held = [], 0
            for name, modified in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), strict=True):
                with store.open_input_stream(f"{root.rstrip('/')}{name}") as f:
                    rows.append((name, modified, f.read()))
                held += len(rows[-1][2])
                if held >= BATCH:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    listed = list_tree(spark, path)
    size = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, size.files // FILES, size.bytes // (64 << 20))
    key = natural_key(F.concat(F.lit(base), "name"))
    rows = listed.select("name", "modified", key.alias("key")).repartitionByRange(tasks, "key").sortWithinPartitions("key").select("name", "modified")
    return rows.mapInArrow(run, "path string, content binary, modified timestamp")


def read_tree(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """path, content, type, title, modified, fulltext of each file below a folder, in natural order of path."""
    title = F.regexp_extract("path", "([^/]+)$", 1)
    typed = with_type(contents(spark, path), mime_types(spark, types)).withColumn("title", title)
    text = F.when(is_text_type(F.col("type")) | F.startswith("type", F.lit("text/")), F.concat(F.lit("\n"), F.substring(F.expr("try_validate_utf8(content)"), 1, EXCERPT)))
    return typed.select("path", "content", "type", "title", "modified", F.concat("title", F.coalesce(text, F.lit(""))).alias("fulltext"))


def tree_meta(tree: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Meta-file fields of read_tree() rows (title, source-path, modification-time, fulltext), and the rows' columns to keep."""
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    when = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.array(pair("title", F.col("title")), pair("source-path", F.col("path")), pair("modification-time", when), pair("fulltext", F.col("fulltext")))
    return tree.select(format_hash_uri("sha256", F.sha2("content", 256)).alias("target_uri"), fields.alias("fields"), *keep)


def read_uri_list(spark: SparkSession, path: str) -> DataFrame:
    """uri of each line, in CR, LF or CRLF files; blank lines and comments are dropped. An unterminated last line counts."""
    lines = spark.read.text(path, lineSep="\n").select(F.explode(F.split("value", "\r")).alias("uri"))
    return lines.filter("trim(uri) <> '' and not startswith(uri, '#')")


def read_numbered_uri_list(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1 on, in the order of the files' numbers) and uri of what write_uri_list() wrote; one row a split is numbered in one task."""
    split = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path, lineSep="\n").select(*split, F.explode(F.split("value", "\r")).alias("uri"))
    lines = lines.filter("trim(uri) <> '' and not startswith(uri, '#')").withColumn("at", F.monotonically_increasing_id())
    before = Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return lines.withColumn("own", own).join(starts, ["file", "block"]).select((F.col("start") + F.col("own")).cast("long").alias("line"), "uri")


def read_meta_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(uri, target_uri) of lines `uri -> target`, and the lines of another form."""
    lines, form = read_uri_list(spark, path), r"^(\S+) -> (\S+)$"
    good = lines.filter(F.col("uri").rlike(form))
    return good.select(F.regexp_extract("uri", form, 1).alias("meta_uri"), F.regexp_extract("uri", form, 2).alias("target_uri")), lines.filter(~F.col("uri").rlike(form))


def load_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What dump() wrote: files (uri, type, content) and meta-files (meta_uri, target_uri) whose target is there."""
    listed = read_uri_list(spark, f"{path}/file.log")
    entries = listed.select(F.regexp_extract("uri", r"^([^?]+)", 1).alias("uri"), F.url_decode(F.regexp_extract("uri", r"[?&]type=([^&]*)", 1)).alias("type"))
    blobs = spark.read.parquet(f"{path}/blobs").select("uri", "content")
    metas, _ = read_meta_list(spark, f"{path}/meta.log")
    return entries.join(blobs, "uri"), metas.join(entries.select(F.col("uri").alias("target_uri")), "target_uri", "left_semi").select("meta_uri", "target_uri")


def hash_tree(spark: SparkSession, path: str, algorithm: str = "sha256") -> DataFrame:
    """uri of each file in a tree of two-digit folders; contents are not read."""
    names = list_tree(spark, path)
    digest = F.regexp_extract("name", r"/([0-9a-f]{2})/(\1[0-9a-f]+)$", 2)
    return names.withColumn("digest", digest).filter("digest <> ''").select(format_hash_uri(algorithm, F.col("digest")).alias("uri"))
