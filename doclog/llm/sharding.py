"""A uniform shuffle into shards of exact sizes: a communication matrix of hypergeometric counts between two local permutations.

Every partition permutes its rows. How many of them go to each shard is drawn exactly as a uniform permutation of all rows would have
it: the rows that a group of partitions sends to the shards are a multivariate hypergeometric draw, made group by group down a tree of
partitions, so no task holds more than one group's FAN partitions. The rows then move once and are permuted again where they arrive, in
buckets by a random key, whose sizes give each bucket the slots that it fills. All of it is DataFrame functions.

Nothing depends on keys or texts: equal texts, or a source with a third of the rows, spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Groups of partitions that a group of the tree has, rows of a bucket of a shard, and standard deviations around the mean that a draw
#: looks at: what lies beyond has a probability under 1e-30, less than a random double can tell from none.
FAN, BUCKET, REACH = 32, 1 << 16, 12


def uniform(*what: Column) -> Column:
    """A double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) * F.lit(2.0**-53)


def hypergeometric(u: Column, total: Column, good: Column, drawn: Column) -> Column:
    """How many of `drawn` rows, taken from `total` without putting back, are among the `good`: the inverse of the distribution at `u`.

    Weights follow from each other from the first count that can matter on: exact ratios, and no factorials.
    """
    n, k, m = (x.cast("double") for x in (total, good, drawn))
    mean = m * k / F.greatest(n, F.lit(1.0))
    reach = REACH * (1 + F.sqrt(mean * (n - k) / F.greatest(n, F.lit(1.0)) * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    low = F.greatest(F.lit(0).cast("long"), drawn + good - total, F.floor(mean - reach))
    high = F.greatest(low, F.least(drawn, good, F.ceil(mean + reach)))
    ratio = lambda x: (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))  # noqa: E731  from count x to x + 1
    counts = F.sequence(low, high)

    def add(s: Column, x: Column) -> Column:
        return F.struct((s.sum + s.weight).alias("sum"), (s.weight * ratio(x.cast("double"))).alias("weight"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("weight"))
    goal = u * F.aggregate(counts, start, add, lambda s: s.sum)

    def seek(s: Column, x: Column) -> Column:
        return F.struct((s.sum + s.weight).alias("sum"), (s.weight * ratio(x.cast("double"))).alias("weight"), F.when(s.sum + s.weight <= s.goal, x + 1).otherwise(s.found).alias("found"), s.goal.alias("goal"))

    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("weight"), low.alias("found"), goal.alias("goal"))
    return F.aggregate(counts, begin, seek, lambda s: F.least(s.found, high))


def dealt(sizes: Column, room: Column, key: Column) -> Column:
    """How many rows each part of `sizes` sends to each shard with `room`, for parts that fill all the room: an array of arrays."""

    def one_part(room: Column, size: Column, part: Column) -> Column:
        """Shard by shard: of the rows that this and later shards take, how many of the part's remaining rows are in this one."""

        def one_shard(s: Column, j: Column) -> Column:
            own = F.get(room, j)
            n = hypergeometric(uniform(key, part, j), s.total, own, s.left)
            return F.struct((s.total - own).alias("total"), (s.left - n).alias("left"), F.array_append(s.counts, n).alias("counts"))

        total = F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("total"), size.alias("left"), F.array().cast("array<bigint>").alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, one_shard, lambda s: s.counts)

    def step(s: Column, i: Column) -> Column:
        counts = one_part(s.room, F.get(sizes, i), i)
        # the counts are made once: of a struct, what is left of the room follows from them
        return F.aggregate(F.array(counts), s, lambda t, c: F.struct(F.zip_with(t.room, c, lambda a, b: a - b).alias("room"), F.array_append(t.out, c).alias("out")))

    start = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, step, lambda s: s.out)


def communication_matrix(sizes: DataFrame, room: list[int], seed: int) -> DataFrame:
    """(part, counts): the rows that each part (part from 0, size) sends to each shard; parts that are not there have none.

    Groups of FAN parts, groups of those and so on are added up to one group that holds all; from there the room is dealt downwards.
    """
    levels = [sizes.select(F.col("part").cast("long"), F.col("size").cast("long"))]
    top = levels[0].agg(F.max("part")).first()[0]
    while top is not None and (top > 0 or len(levels) == 1):
        below = levels[-1].groupBy(F.expr(f"part div {FAN}").alias("part")).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.col("part").alias("child"), F.col("size").alias("n")))).alias("children"))
        levels.append(stored(below, "sizes"))
        top //= FAN
    given = levels[-1].select("part", F.array(*(F.lit(n).cast("long") for n in room)).alias("counts"))
    for level in range(len(levels) - 1, 0, -1):
        key = F.xxhash64(F.lit(seed), F.lit(level), F.col("part"))
        split = levels[level].join(given, "part").withColumn("parts", dealt(F.transform("children", lambda c: c.n), F.col("counts"), key))
        given = split.select(F.explode(F.arrays_zip(F.col("children.child").alias("part"), F.col("parts").alias("counts"))).alias("x")).select("x.part", "x.counts")
    return given


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """`rows` with shard (from 0) and slot (from 0 in each shard, without a gap) in place of any columns of these two names.

    A uniform permutation of the rows, given the hash's randomness, cut into shards whose sizes differ by one row at most. Repeated rows
    count one by one; nulls are no matter; an empty table stays empty. The same rows in the same partitions and the same seed
    give the same result. Partitions of the input and the order in them are fixed in a table first: whatever an executor that is
    lost has to do again is read from there.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    # the first permutation: each partition in the order of a random key
    mixed = held.withColumn("at", F.monotonically_increasing_id()).withColumn("key", F.xxhash64(F.lit(seed), "at")).sortWithinPartitions("key", "at")
    placed = stored(mixed.withColumn("place", F.monotonically_increasing_id()).select("row", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place")), "permuted")
    sizes = stored(placed.groupBy("part").agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = stored(communication_matrix(sizes, room, seed).withColumn("ends", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("counts", F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x))).select("part", "ends"), "matrix")
    buckets = max(1, -(-total // (shards * BUCKET)))
    key = F.xxhash64(F.lit(seed + 1), "part", "place")
    sent = placed.join(matrix, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place")))).withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)))
    # the second permutation: by the random key in each bucket, after the slots of the buckets before it
    filled = stored(sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "buckets")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "part", "place"))
    return sent.withColumn("own", own).join(starts, ["shard", "bucket"]).select("row.*", "shard", (F.col("start") + F.col("own") - 1).cast("long").alias("slot"))
