"""The tables of a log and the meta-files that it rejected, kept up to date by its micro-batches (seq, content, type, fulltext).

The log comes in the order of seq, batch by batch: a meta-file's target is in an earlier batch or in its own. A batch is hashed and
parsed once. Two questions need history: is a file new (by its hash), and what was the first file of a target (by its address). The
tables that answer them are bucketed by what is asked, so the batch's few keys go to the buckets and history stays where it is:
no shuffle grows with the log. Everything else follows from the batch, whose whole rows are shuffled once. Of a digest's addresses
the table keeps the shortest, which all others start with, and the digest; read() writes them out.

A micro-batch is a partition of each table, written again as a whole if it is run again. A marker, written last, makes it visible, so
readers see all or nothing. compact() merges what many batches have left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import SHORT_FORMS, forms, short_form
from ..operators.catalog import dedup_rows, ingest
from ..operators.meta import add_metadata, build_postings, first_of, flatten_meta, is_meta, judge_parse, judge_target, split_target

#: Columns of the tables, and the key that a table is bucketed by.
TABLES = {
    "files": ("file_id long, hash string, type string, size long", "hash"),
    "uris": ("uri string, digest binary, file_id long, of_meta boolean", "uri"),
    "metafiles": ("meta_file_id long, target_uri string", None),
    "metadata": ("meta_file_id long, field string, value string", None),
    "postings": ("term string, meta_file_id long", None),
    "rejects": ("meta_file_id long, target_uri string, reason string", None),
}


class LogTables:
    """The tables under a folder that all executors see, in their newest generation. `buckets` counts where there is none yet."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, generation: int | None = None) -> None:
        self.spark, self.top = spark, root
        spark.range(0).select(F.col("id").alias("generation"), F.col("id").alias("buckets")).write.mode("ignore").parquet(f"{root}/generations/of=none")
        known = spark.read.schema("generation long, buckets long").parquet(f"{root}/generations").agg(F.max(F.struct("generation", "buckets")).alias("g")).first().g
        self.generation = generation if generation is not None else known.generation if known else 0
        self.buckets = known.buckets if known and known.generation == self.generation else buckets
        self.root = root = f"{root}/{self.generation}"
        prefix = f"log_{hashlib.md5(root.encode()).hexdigest()[:16]}"
        self.names = {name: f"{prefix}_{name}" for name in TABLES}
        whole = self.complete()
        for name, (columns, key) in TABLES.items():
            clustered = f"CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS" if key else ""
            if not spark.catalog.tableExists(self.names[name]):
                spark.sql(f"CREATE TABLE {self.names[name]} ({columns}, batch_id long) USING parquet PARTITIONED BY (batch_id) {clustered} LOCATION '{root}/{name}'")
                if whole >= 0:  # another session's partitions
                    spark.sql(f"ALTER TABLE {self.names[name]} RECOVER PARTITIONS")

    def complete(self) -> int:
        """The last batch that is whole; -1: none."""
        self.spark.range(0).select(F.col("id").alias("batch_id")).write.mode("ignore").parquet(f"{self.root}/complete/batch=none")
        return self.spark.read.schema("batch_id long").parquet(f"{self.root}/complete").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]

    def mark(self, batch_id: int) -> None:
        """From now on readers see the batch."""
        self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/complete/batch={batch_id}")

    def compact(self, buckets: int | None = None) -> LogTables:
        """The same tables in a new generation: a bucket's files of all batches become one, in as many buckets as the log needs by now.

        The last batch stays by itself, as the stream may run it again. Readers and writers of the old generation go on with that one;
        the new one counts for whoever opens the tables from then on.
        """
        last = self.complete()
        new = LogTables(self.spark, self.top, buckets or self.buckets, self.generation + 1)
        for name in TABLES:
            if last > 0:
                new.write(name, self.before(name, last), last - 1)
            if last >= 0:
                new.write(name, self.spark.table(self.names[name]).filter(F.col("batch_id") == last), last)
        new.mark(last)
        row = self.spark.range(1).select(F.lit(new.generation).cast("long").alias("generation"), F.lit(new.buckets).cast("long").alias("buckets"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.top}/generations/of={new.generation}")
        return new

    def read(self, name: str) -> DataFrame:
        """What whole batches have brought; of uris all addresses."""
        rows = self.before(name, self.complete() + 1)
        return rows.select(F.explode(F.array_distinct(forms(F.regexp_extract("uri", "^hash://([^/]+)/", 1), F.col("digest")))).alias("uri"), "file_id", "of_meta") if name == "uris" else rows

    def before(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.table(self.names[name]).filter(F.col("batch_id") < batch_id).drop("batch_id")

    def write(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """Make `rows` the table's partition of this batch; what comes back is read from there."""
        key = TABLES[name][1]
        rows = rows.select(*(c.split()[0] for c in TABLES[name][0].split(", ")))
        rows = rows.repartition(self.buckets, key) if key else rows
        spark = rows.sparkSession  # a micro-batch has one of its own
        spark.sql(f"INSERT OVERWRITE TABLE {self.names[name]} PARTITION (batch_id = {batch_id}) SELECT * FROM {{rows}}", rows=rows)
        return spark.table(self.names[name]).filter(F.col("batch_id") == batch_id).drop("batch_id")

    def put_down(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows`, a batch's at most, as a table that the next batch replaces: a table can't be written from what is read from it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.root}/{name}")


def _found(history: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a bucketed table with one of the distinct keys: these are dealt to its buckets and looked up there."""
    return history.join(keys.hint("shuffle_hash"), key)


def known_files(history: DataFrame, staged: DataFrame) -> DataFrame:
    """hash, type of the staged files that history has."""
    return _found(history.select("hash", "type"), staged.select("hash").distinct(), "hash")


def short_uris(files: DataFrame) -> DataFrame:
    """Rows of the table uris for files (file_id, type, digests): one for each algorithm."""
    meta = F.coalesce(is_meta(F.col("type")), F.lit(False)).alias("of_meta")
    each = F.array(*(F.struct(short_form(name, F.col("digests")[name]).alias("uri"), F.col("digests")[name].alias("digest")) for name in files.schema["digests"].dataType.names))
    return files.select(F.explode(each).alias("x"), "file_id", meta).select("x.*", "file_id", "of_meta")


def first_files(history: DataFrame, own: DataFrame, metas: DataFrame) -> DataFrame:
    """target_uri, and the least file_id with whether it is a meta-file, of the targets of `metas` that history or the batch's `own` uris have."""
    start = F.regexp_extract("target_uri", rf"^(hash://[^/]+/[0-9a-f]{{{min(SHORT_FORMS)}}})[0-9a-f]*$", 1)
    wanted = metas.select(F.col("target_uri").alias("asked"), start.alias("uri")).filter("uri <> ''").distinct()
    digits = F.length("uri") - min(SHORT_FORMS)
    whole = F.concat(F.substring(F.col("uri"), F.lit(1), digits), F.lower(F.hex("digest")))
    same = F.startswith(whole, F.col("asked")) & ((F.length("asked") - digits).isin(*SHORT_FORMS) | (F.length("asked") == F.length(whole)))
    old, new = (_found(rows, wanted, "uri").filter(same).select(F.col("asked").alias("uri"), "file_id", "of_meta") for rows in (history, own))
    return first_of(old.union(new))


def append_batch(log: LogTables, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch into all tables; the batch is parsed once, and kept until its tables are written."""
    metas = judge_parse(flatten_meta(split_target(batch.filter(is_meta(F.col("type"))))))
    others = batch.filter(~F.coalesce(is_meta(F.col("type")), F.lit(False)))
    kept = {"target_uri": "string", "fields": "array<struct<field: string, value: string>>", "fulltext": "string", "reason": "string"}
    none = [F.lit(None).cast(kind).alias(name) for name, kind in kept.items()]
    # whole rows are dealt once: files, uris and meta-files of the batch all follow from what is kept here
    staged = dedup_rows(ingest(metas, keep=tuple(kept)).unionByName(ingest(others).select("*", *none))).persist()
    known = log.put_down("known", known_files(log.before("files", batch_id), staged))
    same = (F.col("hash") == F.col("known_hash")) & F.col("type").eqNullSafe(F.col("known_type"))
    new = staged.join(known.select(F.col("hash").alias("known_hash"), F.col("type").alias("known_type")), same, "left_anti")
    log.write("files", new, batch_id)
    uris = log.write("uris", short_uris(new), batch_id)
    said = new.filter(F.coalesce(is_meta(F.col("type")), F.lit(False))).select(F.col("file_id").alias("meta_file_id"), *kept)
    judged = judge_target(said, first_files(log.before("uris", batch_id), uris, said)).persist()
    log.write("rejects", judged.filter("reason is not null"), batch_id)
    valid = judged.filter("reason is null")
    log.write("metafiles", valid, batch_id)
    log.write("metadata", add_metadata(valid), batch_id)
    log.write("postings", build_postings(valid.filter("fulltext is not null")), batch_id)
    log.mark(batch_id)
    judged.unpersist()
    staged.unpersist()


def maintain(stream: DataFrame, log: LogTables, checkpoint: str) -> None:
    """Append what a stream has to the tables, micro-batch by micro-batch, and stop; a later call goes on from there."""
    stream.writeStream.foreachBatch(lambda batch, k: append_batch(log, batch, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
