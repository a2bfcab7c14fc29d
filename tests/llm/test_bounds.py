"""What the near-copy stage has in memory at once."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from doclog.llm import simhash


def test_blocks_stay_small_where_nothing_links(spark):
    """600 members of one key, none similar: every pair meets, and no block grows with their number."""
    n, run, seen = 600, 64, []

    def compare(rows):
        seen.append(rows)
        return spark.createDataFrame([], "a long, b long")

    members = spark.range(n).select(F.lit(5).cast("long").alias("key"), "id")
    assert simhash.in_blocks(members, spark.range(n), compare, run).count() == 0
    last = seen[1].distinct()
    assert last.groupBy("block").count().agg(F.max("count")).first()[0] <= 3 * run // 2
    met = last.alias("x").join(last.alias("y"), "block").filter("x.id < y.id").select("x.id", "y.id").distinct()
    assert met.count() == n * (n - 1) // 2


def test_links_outside_the_largest_component_are_found(spark):
    """Links of pairs far apart are found by blocks as by all pairs."""
    r, n = random.Random(3), 400
    group = [r.randrange(150) if k % 2 else 0 for k in range(n)]
    told = spark.createDataFrame([(k, g) for k, g in enumerate(group)], "id long, g int")

    def compare(rows):
        return rows.alias("x").join(rows.alias("y"), "block").filter("x.id < y.id and x.g = y.g").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    found = simhash.components(simhash.in_blocks(told.select(F.lit(1).cast("long").alias("key"), "id"), told, compare, 32))
    least = {g: min(k for k in range(n) if group[k] == g) for g in group}
    want = {k: least[g] for k, g in enumerate(group) if group.count(g) > 1}
    assert {x.node: x.component for x in found.collect()} == want


def test_long_sets_are_compared_by_ranges():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, 20_000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(len(base)) < p], r.integers(0, 2**64, 500, dtype=np.uint64)])) for p in [0.99, 0.8] * 150]
    sets += [np.empty(0, np.uint64), sets[0][:0], sets[0], np.array([0, 2**64 - 1], np.uint64), np.array([0, 2**64 - 1], np.uint64)]
    tracemalloc.start()
    i, j = simhash.similar(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    few = [*range(12), *range(300, 305)]
    inside = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a in few:
        for b in few:
            if a < b:
                same = len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b]))) >= 0.8
                assert ((a, b) in inside) == same
    assert len(inside) > 10_000
