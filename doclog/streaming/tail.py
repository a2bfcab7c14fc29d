"""Queries that follow a growing log: history first, then what arrives, each file once.

State is kept per file or per target for as long as the query lives; order is log position, so there are no watermarks. The log comes
in order: no row of a later micro-batch has a smaller position than one of an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.address import packed, unpacked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk_state(spark: SparkSession) -> None:
    """State in RocksDB, of which a micro-batch reads and writes what its keys need; set unless the session has a choice of its own."""
    for name, value in (("providerClass", ROCKSDB), ("rocksdb.changelogCheckpointing.enabled", "true")):
        if spark.conf.get(f"spark.sql.streaming.stateStore.{name}", None) is None:
            spark.conf.set(f"spark.sql.streaming.stateStore.{name}", value)


#: When a row was seen: the time of its micro-batch, the same for all its rows, and again when a failed one is run once more.
SEEN = "seen_"


def tail(matches: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """First sight of each key in a stream with sort_id: its least position, in output mode update.

    A streaming aggregation keeps position and time of the first sight; only the micro-batch whose time it is gives the row. (Dropping
    duplicates would keep any of a micro-batch's rows, not its first.)
    """
    first = matches.withColumn(SEEN, F.current_timestamp()).groupBy(*keys).agg(F.min("sort_id").alias("sort_id"), F.min(SEEN).alias(SEEN))
    return first.filter(F.col(SEEN) == F.current_timestamp()).select("sort_id", *keys)


def tail_all_of(matches: DataFrame, clauses: int) -> DataFrame:
    """Files of a stream (sort_id, file_id, clause, negated) when the last of `clauses` positive clauses (from 0) arrives, in output mode update.

    A negated clause at or before that position excludes the file for good.
    """
    own = [(F.col("clause") == k) & ~F.col("negated") for k in range(clauses)]
    least = lambda what, when: F.min(F.when(when, F.col(what)))
    ages = [least("sort_id", w).alias(f"age{k}_") for k, w in enumerate(own)] + [least(SEEN, w).alias(f"seen{k}_") for k, w in enumerate(own)]
    state = matches.withColumn(SEEN, F.current_timestamp()).groupBy("file_id").agg(*ages, least("sort_id", F.col("negated")).alias("gone_at"))

    def last(name: str) -> Column:
        parts = [F.col(f"{name}{k}_") for k in range(clauses)]
        every = parts[0].isNotNull()
        for p in parts[1:]:
            every = every & p.isNotNull()
        return F.when(every, F.greatest(*parts) if clauses > 1 else parts[0])

    done = state.withColumn("sort_id", last("age")).filter((last("seen") == F.current_timestamp()) & (F.col("gone_at").isNull() | (F.col("gone_at") > F.col("sort_id"))))
    return done.select("sort_id", "file_id")


class _Number(StatefulProcessor):
    """Meta-files of one address, numbered in the order in which they come; the state is how many there were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "done long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:  # noqa: N802
        done = self.told.get()[0] if self.told.exists() else 0
        for row in sorted(rows, key=lambda r: r.seq):
            yield Row(seq=row.seq, uri=None if row.uri is None else bytes(row.uri), target_uri=bytes(key[0]), position=done)
            done += 1
        self.told.update((done,))

    def close(self) -> None:
        pass


def hold_until_target(steps: DataFrame) -> DataFrame:
    """Release meta-files once their target is there: a stream of (target_uri, seq, is_meta, uri, addresses) gives (seq, uri, target_uri, position).

    A file row opens each of its addresses (`addresses`, or else target_uri); the meta-files held under any of them follow it in the
    order in which they came, later ones at once. So a meta-file's position is known when it comes, and releasing is a join of two
    streams: Python sees the meta-files only, and none of the addresses, which are several for each file and mostly no target.
    State is kept per address and meta-file, released ones too, in output mode append; addresses are binary there, in half their bytes.
    """
    on_disk_state(steps.sparkSession)
    metas = steps.filter("is_meta and target_uri is not null").select(packed(F.col("target_uri")).alias("target_uri"), "seq", packed(F.col("uri")).alias("uri"))
    numbered = metas.groupBy("target_uri").transformWithState(_Number(), "seq long, uri binary, target_uri binary, position long", "append", "none")
    files = steps.filter("not is_meta").select(F.explode(F.coalesce("addresses", F.array("target_uri"))).alias("opened"))
    opened = files.select(packed(F.col("opened")).alias("opened")).dropDuplicates(["opened"])
    found = numbered.join(opened, F.col("target_uri") == F.col("opened"))
    return found.select("seq", unpacked(F.col("uri")).alias("uri"), unpacked(F.col("target_uri")).alias("target_uri"), "position")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call with the same checkpoint goes on from there. Read the result with spark.read.parquet.

    In mode update every micro-batch is a folder of its own, written again if it is run again.
    """
    on_disk_state(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path).option("compression", "zstd")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch_id={k}"))
    writer.start().awaitTermination()
