"""What the operators of this subpackage share: reading tables, cutting lineage, union-find and connected components."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch of rows that a Python worker gets at once, where the session has Spark's own default.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of `sf_dir`; from here on the session's workers get smaller batches, as rows hold whole texts."""
    if spark.conf.get(BATCH[0], BATCH[1]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What workers keep from task to task, by name; a task of another kind drops it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(f: Callable, keep: str | None = None) -> Callable:
    """`f`, a generator over batches, for workers that Spark uses again: at its end the memory that it freed goes back to the system.

    Idle workers would hold on to it else, and an executor has a worker for each Python step that its running stages have had.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        for name, drop in KEPT.items():
            if name != keep:
                drop()
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. The session must name it, but for a local master, as in tests: all of that is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; what comes back survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (node, smallest node), without the smallest nodes themselves."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def local_forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of one task shrunk to stars, at most `most` links in memory."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) >= most:
            a, b = forest(a, b)
            if len(a) >= most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = forest(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def tasks_for(rows: int) -> int:
    """Tasks for narrow rows of a few longs."""
    return max(8, rows // 500_000)


#: Links (16 bytes each) that one task joins at most.
ONE_TASK = 1 << 20


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable over `links` (a, b), for nodes that have a link.

    Each task shrinks its links to stars. Up to `one_task` of these go through one task more, as rounds over so few rows would only cost
    time, and the driver's memory for their plans and tasks; more go through rounds(). Null ends are dropped; a null links with nothing.
    """
    edges = checkpoint(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(lean(local_forest), "a long, b long"))
    n = edges.count()
    if n <= one_task:
        stars = checkpoint(edges.coalesce(1).mapInArrow(lean(functools.partial(local_forest, most=2 * one_task + 2)), "a long, b long"))
    else:
        stars = rounds(edges, tasks_for(n))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def rounds(edges: DataFrame, tasks: int, most: int = 60) -> DataFrame:
    """Stars (a, b) of the components of links a > b: each node with its component's smallest one.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each a shuffle whose result is checkpointed. The minima are
    written before they are joined, so that both sides of the join are plain exchanges and AQE can split a hub. A round's tables have
    as many tasks as their links need, whatever the number of shuffle partitions: the driver keeps a record of each task.
    """
    edges, seen = edges.coalesce(tasks), None
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = checkpoint(large.filter("a <> b").coalesce(tasks))  # a > b for every row
        least = checkpoint(down.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.distinct().coalesce(tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges
        seen = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a compressed table in the shared folder."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a bitmap for each value, and least and most powers of two of bits: 2^30 are 128 MB.
BITMAP_SHARE, BITMAP_LEAST, BITMAP_MOST, BITMAP_PIECES = 16, 20, 30, 128
#: Bytes of a bitmap that comes to the driver at once.
BITMAP_WHOLE = 8 << 20


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A filter of the lower bits of a long column of hashes that passes all its members, in bytes.

    The lower ones, as hashes that were chosen for being least are alike in their upper bits. Its size follows the number of hashes up to 2^30 bits; past that it passes more of what it should stop, so what it lets through
    is only ever a saving. Its pieces are filled by tasks; the driver only joins them.
    """
    name = hashes.columns[0]
    hashes = checkpoint(hashes)
    n = hashes.count()
    power = min(max((BITMAP_SHARE * n).bit_length(), BITMAP_LEAST), BITMAP_MOST)
    width = 1 << (power - 3)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(1).to_numpy()
            for piece in np.unique(batch.column(0).to_numpy()).tolist():
                bits = pieces.setdefault(piece, np.zeros(width // BITMAP_PIECES, np.uint8))
                own = slots[batch.column(0).to_numpy() == piece] - piece * len(bits) * 8
                np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([b.tobytes() for b in pieces.values()], pa.binary())], ["piece", "bits"])

    slot = F.col(name).bitwiseAND((1 << power) - 1).alias("slot")
    dealt = hashes.select(slot).select((F.col("slot") * BITMAP_PIECES / (1 << power)).cast("int").alias("piece"), "slot").repartition("piece")
    out = np.zeros(width, np.uint8)
    filled = dealt.coalesce(tasks_for(n)).mapInArrow(lean(fill), "piece int, bits binary")
    for piece, bits in filled.collect() if width <= BITMAP_WHOLE else filled.toLocalIterator():  # a job for each partition, where it is large
        out[piece * len(bits) : (piece + 1) * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def among(hashes: DataFrame, *columns, once: bool = False):
    """A column: whether the first of `columns`, a hash, is among `hashes`, or seems to be in a bitmap of them; with `once` for the
    first of a task's rows with equal `columns` only.
    """
    bits = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes))

    def held(own: pa.Array) -> np.ndarray:
        return in_bitmap(bits.value, own.to_numpy(zero_copy_only=False).view(np.uint64))

    @F.arrow_udf("boolean")
    @lean
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in parts:
            yield pa.array(held(own))

    @F.arrow_udf("boolean")
    @lean
    def first(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        seen: set[tuple] = set()
        for own in parts:
            out = held(own[0])
            for k in np.flatnonzero(out).tolist():
                key = tuple(x[k].as_py() for x in own)
                out[k] = key not in seen
                seen.add(key)
            yield pa.array(out)

    return first(*columns) if once else found(*columns)
