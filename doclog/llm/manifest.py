"""A Merkle manifest as an append log: a tree of RUN-ary runs over each group's leaves, its nodes kept in postorder, the order of completion.

A node's place in the log follows from sizes of subtrees alone. Before leaf i stand i leaves and every full node that ends before it,
floor(i / RUN^h) on each level h. A full node stands behind the last of its leaves and the full nodes of lower levels that end there;
the nodes of the right edge that are not full come last, from low to high. So any sibling is found by its address, without the tree.

Builders are aligned: each takes BLOCK = RUN^DEPTH nodes of a level that start at a multiple of BLOCK and writes the nodes of the next
levels. What a builder of leaves writes below its top is one segment of the log, whatever the other builders do; the tops, and what
is built over them, are the log's spine. A proof reads the segment of its block, and its place in the spine by addresses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, stored

RUN, DEPTH = 16, 3
BLOCK = RUN**DEPTH


def address(level: int, index: int, n: int) -> int:
    """Place in the log of node `index` of `level` in a tree over `n` leaves."""
    end = (index + 1) * RUN**level
    if end <= n:  # full: full nodes over it that end with it come later
        place, size = end - 1, RUN
        for h in range(1, 64):
            if size > n:
                break
            place += end // size if h <= level else (end - 1) // size
            size *= RUN
        return place
    place, size, h = n, RUN, 1
    while size <= n:
        place += n // size
        size *= RUN
    return place + sum(n % RUN**h != 0 for h in range(1, level))


def width(level: int, n: int) -> int:
    """Nodes of a level."""
    return -(-n // RUN**level)


def siblings(level: int, index: int, n: int) -> list[int]:
    """The node's run on its level."""
    return list(range(index - index % RUN, min(index - index % RUN + RUN, width(level, n))))


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def built(level: int, first: int, nodes: list[bytes], n: int) -> list[tuple[int, int, bytes]]:
    """(level, index, digest) of what a builder makes of consecutive nodes of a level, up to DEPTH levels or the root, itself included."""
    out = [(level, first + k, x) for k, x in enumerate(nodes)]
    for h in range(level + 1, level + DEPTH + 1):
        if width(h - 1, n) == 1:
            break
        nodes, first = [digest(nodes[k : k + RUN]) for k in range(0, len(nodes), RUN)], first // RUN
        out += [(h, first + k, x) for k, x in enumerate(nodes)]
    return out


def counted(value: Column) -> Column:
    """A value with its number of bytes in front; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(counted, values)), 256)


def ranked(leaves: DataFrame) -> DataFrame:
    """`leaves` (group_key, order_key, leaf, ...) with index (from 0 in each group) and n, the group's number of leaves.

    Rows are sorted over all partitions at once, so a group of any size is spread; a partition's rows of a group are numbered from the
    place of the first one and the numbers of the group's rows in partitions before it.
    """
    keyed = leaves.withColumn("tie", F.monotonically_increasing_id())
    keys = ["group_key", F.asc_nulls_first("order_key"), "leaf", "tie"]
    placed = stored(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "sorted")
    parts = stored(placed.groupBy("group_key", "part").agg(F.min("place").alias("first"), F.count("*").alias("own")), "parts")
    whole = Window.partitionBy("group_key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("group_key", "part", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"), F.sum("own").over(whole).alias("n"))
    return placed.join(starts, ["group_key", "part"]).withColumn("index", F.col("place") - F.col("first") + F.col("start")).drop("place", "part", "first", "start")


SPINE = "group_key string, n long, level int, index long, address long, digest string"


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _over(nodes: DataFrame, level: int) -> DataFrame:
    """The spine over nodes of one level: what builders make of them, aligned block by block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in SPINE.split(", ")], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            made = ((r["group_key"], r["n"], node) for r in batch.to_pylist() for node in built(level, r["block"] * BLOCK, [x.encode() for x in r["nodes"]], r["n"]))
            yield _table([(g, n, h, k, address(h, k, n), x.decode()) for g, n, (h, k, x) in made if h > level], names, kinds)

    one = F.transform(F.array_sort(F.collect_list(F.struct("index", "digest"))), lambda x: x.digest)
    blocks = nodes.groupBy("group_key", "n", F.expr(f"index div {BLOCK}").alias("block")).agg(one.alias("nodes"))
    return blocks.select("group_key", "n", "block", "nodes").mapInArrow(lean(build), SPINE)


class Log(NamedTuple):
    """blocks(group_key, n, block, leaves, start, segment): aligned blocks of leaves in order, each with its piece of the log, digests of
    32 bytes from the place `start` on; spine: nodes of level DEPTH and over with their places; roots(group_key, root).
    """

    blocks: DataFrame
    spine: DataFrame
    roots: DataFrame

    def nodes(self) -> DataFrame:
        """group_key, address, digest: the whole log, a row for each node."""
        pieces = F.expr("transform(sequence(0, cast(octet_length(segment) / 32 as int) - 1), k -> lower(hex(substring(segment, 32 * k + 1, 32))))")
        each = self.blocks.select("group_key", "start", F.posexplode(pieces).alias("k", "digest"))
        return each.select("group_key", (F.col("start") + F.col("k")).alias("address"), "digest").union(self.spine.select("group_key", "address", "digest"))


def append_log(leaves: DataFrame) -> Log:
    """The log of the trees over `leaves` (group_key string, not null, order_key, leaf, and any others), a tree for each group.

    Leaves ascend by order_key (null first); equal keys, by leaf. Groups of any size are spread over blocks; an empty table has no tree.
    """
    others = [c for c in leaves.columns if c not in ("group_key", "leaf")]
    rows = ranked(leaves)
    blocks = rows.groupBy("group_key", "n", F.expr(f"index div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("index", "leaf", *others))).alias("leaves"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's segment, and its top: a node of level DEPTH, or the root of a group without that level."""
        for batch in batches:
            made = []
            for n, block, held in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist(), batch.column("leaves"), strict=True):
                nodes = built(0, block * BLOCK, [x.encode() for x in held.values.field("leaf").to_pylist()], n)
                level, index, top = nodes[-1]
                kept = sorted((address(h, k, n), x) for h, k, x in nodes if h < DEPTH)
                made.append((kept[0][0], bytes.fromhex(b"".join(x for _, x in kept).decode()), level, address(level, index, n), top.decode()))
            new = _table(made, ["start", "segment", "level", "address", "digest"], [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.columns], [*batch.schema.names, *new.schema.names])

    schema = StructType([*blocks.schema, *StructType.fromDDL("start long, segment binary, level int, address long, digest string")])
    blocks = stored(blocks.mapInArrow(lean(write), schema), "blocks")
    tops = blocks.select("group_key", "n", "level", F.col("block").alias("index"), "address", "digest")
    spine = tops.filter(F.col("level") == DEPTH)
    level, most = DEPTH, blocks.agg(F.max("n")).first()[0] or 0
    while width(level, most) > 1:
        above = stored(_over(tops.filter((F.col("level") == level) & (F.col("n") > RUN**level)).select("group_key", "n", "index", "digest"), level), "spine")
        tops, spine, level = tops.union(above), spine.union(above), level + DEPTH
    # a root is the one node of its level
    root = tops.filter((F.col("index") == 0) & (F.col("n") <= F.pow(F.lit(float(RUN)), "level")))
    return Log(blocks.drop("level", "address", "digest"), spine, root.select("group_key", F.col("digest").alias("root")))


def _upper(log: Log) -> DataFrame:
    """group_key, block, upper: the siblings in the spine on a block's way to the root, level by level, found by their addresses."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                level, index = DEPTH, block
                while width(level, n) > 1:
                    rows += [(group, block, level * RUN + k % RUN, address(level, k, n)) for k in siblings(level, index, n) if k != index]
                    level, index = level + 1, index // RUN
            yield _table(rows, ["group_key", "block", "at", "address"], [pa.string(), pa.int64(), pa.int32(), pa.int64()])

    asked = log.blocks.select("group_key", "n", "block").mapInArrow(lean(wanted), "group_key string, block long, at int, address long")
    found = asked.join(log.spine.select("group_key", "address", "digest"), ["group_key", "address"])
    return found.groupBy("group_key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x.digest).alias("upper"))


def _ways(n: int, block: int, leaves: int, start: int, segment: bytes, upper: list[bytes], beyond: list[tuple[bytes, bytes]]) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block, its siblings left and right of its way, level by level up to the root and then those `beyond` it."""
    text = segment.hex().encode()
    inner, level = [], 0
    while level < DEPTH and width(level, n) > 1:
        first = block * BLOCK // RUN**level
        spots = [64 * (address(level, k, n) - start) for k in range(first, min(first + BLOCK // RUN**level, width(level, n)))]
        runs = [b"".join(text[p : p + 64] for p in spots[k : k + RUN]) for k in range(0, len(spots), RUN)]
        inner.append((first, runs))
        level += 1
    outer, at, index = [], 0, block
    while level >= DEPTH and width(level, n) > 1:
        own = [k for k in siblings(level, index, n) if k != index]
        left = index % RUN
        outer.append((b"".join(upper[at : at + left]), b"".join(upper[at + left : at + len(own)])))
        at, level, index = at + len(own), level + 1, index // RUN
    rest = outer + beyond
    for k in range(leaves):
        way, index = [], block * BLOCK + k
        for first, runs in inner:
            run, spot = runs[(index - first) // RUN], 64 * (index % RUN)
            way.append((run[:spot], run[spot + 64 :]))
            index //= RUN
        yield way + rest


def fold(node: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in way:
        node = digest([left, node, right])
    return node


def _with_upper(log: Log) -> DataFrame:
    return log.blocks.join(_upper(log), ["group_key", "block"], "left")


def proofs(log: Log) -> DataFrame:
    """group_key, order_key, index, leaf and siblings (left and right of its way, level by level) of every leaf."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for row in batch.to_pylist():
                ways = _ways(row["n"], row["block"], len(row["leaves"]), row["start"], row["segment"], [x.encode() for x in row["upper"] or []], [])
                rows = [(row["group_key"], x["order_key"], x["index"], x["leaf"], [{"left": a.decode(), "right": b.decode()} for a, b in way]) for x, way in zip(row["leaves"], ways, strict=True)]
                kind = batch.schema.field("leaves").type.value_type.field("order_key").type
                yield _table(rows, ["group_key", "order_key", "index", "leaf", "siblings"], [pa.string(), kind, pa.int64(), pa.string(), pair])

    kind = next(f for f in log.blocks.schema if f.name == "leaves").dataType.elementType["order_key"].dataType.simpleString()
    return _with_upper(log).mapInArrow(lean(extract), f"group_key string, order_key {kind}, index long, leaf string, siblings array<struct<left: string, right: string>>")


def manifest(rows: DataFrame, group: str, key: str, columns: list[str]) -> tuple[Log, Log]:
    """The logs of the trees of each group and of the tree over their roots; leaves are digests of `columns`, in that order.

    Groups are ordered by their UTF-8 bytes, null first; rows by `key`, null first, rows of one key by their leaves. `rows` may have a
    column `claimed`, a leaf that someone claims for the row: verified() folds that one. Other columns are left out.
    """
    group_key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    claimed = F.col("claimed") if "claimed" in rows.columns else F.lit(None).cast("string")
    log = append_log(rows.select(group_key.alias("group_key"), F.col(key).alias("order_key"), leaf(*(F.col(c) for c in columns)).alias("leaf"), claimed.alias("claimed")))
    top = append_log(log.roots.select(F.lit("").alias("group_key"), F.col("group_key").alias("order_key"), F.col("root").alias("leaf")))
    return log, top


def verified(log: Log, top: Log) -> DataFrame:
    """order_key, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf of `log`, whose roots are the leaves of `top`.

    The proof is what proofs() gives, over both trees; folded_root comes from the claimed leaf (where none is claimed, the own one) and
    the proof's siblings, and is verified if it is the root.
    """
    beyond = proofs(top).select(F.col("order_key").alias("group_key"), F.col("leaf").alias("subroot"), F.col("siblings").alias("beyond"))
    root = top.roots.first()
    root = root.root if root else ""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["order_key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            kind = batch.schema.field("leaves").type.value_type.field("order_key").type
            for row in batch.to_pylist():
                beyond = [(x["left"].encode(), x["right"].encode()) for x in row["beyond"]]
                ways = _ways(row["n"], row["block"], len(row["leaves"]), row["start"], row["segment"], [x.encode() for x in row["upper"] or []], beyond)
                rows = []
                for x, way in zip(row["leaves"], ways, strict=True):
                    folded = fold((x["claimed"] or x["leaf"]).encode(), way).decode()
                    rows.append((x["order_key"], x["leaf"], row["subroot"], root, digest([part for pair in way for part in pair]).decode(), folded, folded == root))
                yield _table(rows, names, [kind, *[pa.string()] * 5, pa.bool_()])

    kind = next(f for f in log.blocks.schema if f.name == "leaves").dataType.elementType["order_key"].dataType.simpleString()
    rows = _with_upper(log).join(beyond, "group_key")
    return rows.mapInArrow(lean(check), f"order_key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
