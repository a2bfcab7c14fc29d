"""Sharding, manifest and runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from doclog.functions.text import ascii_lower
from doclog.llm import manifest, queries, runs, sharding
from helpers import docs, odd_texts, prose

# --- sharding


def test_hypergeometric_draws_have_their_probabilities(spark):
    long = lambda x: F.lit(x).cast("long")
    n = 40_000
    for total, good, drawn in ((50, 20, 15), (10, 3, 9), (5, 5, 2), (7, 0, 3), (1, 1, 1)):
        drew = spark.range(n).select(sharding.hypergeometric(sharding.uniform(F.lit(1), "id"), long(total), long(good), long(drawn)).alias("x"))
        got = {r.x: r["count"] for r in drew.groupBy("x").count().collect()}
        want = {x: comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn) for x in range(drawn + 1) if x <= good and drawn - x <= total - good}
        assert set(got) <= set(want)
        for x, p in want.items():
            assert abs(got.get(x, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_large_draws_stay_in_range_and_near_the_mean(spark):
    n, k, m = 10**12, 10**12 // 16, 10**9
    got = [r.x for r in spark.range(20).select(sharding.hypergeometric(sharding.uniform("id"), *(F.lit(x).cast("long") for x in (n, k, m))).alias("x")).collect()]
    sd = (m / 16 * 15 / 16) ** 0.5
    assert all(abs(x - m / 16) < 6 * sd for x in got) and len(set(got)) > 10


def test_a_matrix_is_drawn_as_a_whole(spark):
    """Two parts of 3 and 2 rows, shards of 2, 2 and 1: every matrix as often as among all orders of the rows."""
    sizes, room, n = [3, 2], [2, 2, 1], 30_000
    ones = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    got = Counter(tuple(map(tuple, r.m)) for r in spark.range(n).select(sharding.dealt(ones(sizes), ones(room), F.xxhash64("id")).alias("m")).collect())
    want = {}
    for a in range(3):
        for b in range(3):
            c = 3 - a - b
            if 0 <= c <= 1 and a + b <= 3:
                p = comb(2, a) * comb(2, b) * comb(1, c) / comb(5, 3)
                want[((a, b, c), (2 - a, 2 - b, 1 - c))] = p
    assert set(got) == set(want)
    for m, p in want.items():
        assert abs(got[m] / n - p) < 5 * (p * (1 - p) / n) ** 0.5


def test_the_tree_of_partitions_keeps_all_margins(spark):
    sizes = {k: (7 * k) % 23 for k in range(2 * sharding.FAN + 5) if k % 11}
    total = sum(sizes.values())
    room = [total // 16 + (j < total % 16) for j in range(16)]
    got = sharding.communication_matrix(spark.createDataFrame(list(sizes.items()), "part long, size long"), room, 3).collect()
    assert {r.part: sum(r.counts) for r in got} == sizes and min(min(r.counts) for r in got) >= 0
    assert [sum(r.counts[j] for r in got) for j in range(16)] == room


def held(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(shards)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by[j]) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return sizes


def test_shards_are_exact_whatever_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 16)
    table = docs(spark).withColumns({c: F.lit(1) for c in ("shard", "slot", "part", "place", "key", "row", "bucket")})
    table = table.union(table.filter("doc_id = 4")).union(table.filter("doc_id = 4")).repartition(5)
    got = sharding.shuffle_into_shards(table, 4, seed=7)
    rows = got.collect()
    assert set(got.columns) == set(table.columns) and sum(held(rows, 4)) == table.count()
    plain = [c for c in table.columns if c not in ("shard", "slot")]
    assert Counter(map(str, (tuple(r[c] for c in plain) for r in rows))) == Counter(map(str, (tuple(r) for r in table.select(plain).collect())))
    assert sharding.shuffle_into_shards(table.limit(0), 4).count() == 0
    few = sharding.shuffle_into_shards(spark.createDataFrame([(1,), (1,), (None,)], "a int"), 16).collect()
    assert sum(held(few, 16)) == 3


def test_positions_are_uniform(spark):
    """Where rows go has nothing to do with where they were: shards by tenths of the input."""
    n = 40_000
    got = sharding.shuffle_into_shards(spark.range(n, numPartitions=7), 16, seed=5)
    cells = Counter((r.id * 10 // n, r.shard, r.slot * 4 * 16 // n) for r in got.collect())
    mean = n / (10 * 16 * 4)
    square = sum((cells[a, b, c] - mean) ** 2 / mean for a in range(10) for b in range(16) for c in range(4))
    assert 440 < square < 760  # about 639 less the margins


# --- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def ways(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 273, 4095, 4096, 4097, 4113, 8192, 65537])
def test_addresses_are_the_order_of_completion(n):
    log, waiting = [], []
    for i in range(n):
        log.append((0, i))
        level, index = 0, i
        while (index + 1) % 16 == 0:
            level, index = level + 1, index // 16
            log.append((level, index))
    level = 0
    while manifest.width(level, n) > 1:
        level += 1
        last = manifest.width(level, n) - 1
        if (level, last) not in log[-20:]:
            waiting.append((level, last))
    log += waiting
    assert [manifest.address(h, k, n) for h, k in log] == list(range(len(log)))
    assert len(log) == sum(manifest.width(h, n) for h in range(level + 1))


def brute(rows):
    """doc_id, source, fields in order, and the fields that are claimed or None, to the contract's columns."""
    c = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for doc_id, source, fields, claimed in rows:
        groups[source].append((doc_id, H(*map(c, fields)), claimed and H(*map(c, claimed))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, claimed) in enumerate(groups[s]):
            way, node = ways(trees[s], i) + ways(top, k), claimed or leaf
            for left, right in way:
                node = H(*left, node, *right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(*(x for a, b in way for x in a + b)), node, node == top[-1][0]))
    return sorted(map(str, out))


def test_manifest_of_odd_rows(spark):
    rows = [(d, t, s, None if k % 4 else "en", k) for k, (d, t) in enumerate(odd_texts()) for s in ((None, "ä", "z", "")[k % 4],)]
    rows += [(5000 + k, "SHOUT" if k % 2 else "low", f"s{k % 40}", "fr", None) for k in range(200)] + [(7, "same", "z", "en", 1)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumns({c: F.lit(9) for c in ("leaf", "index", "group_key", "order_key", "n", "block")})
    low = lambda t: None if t is None else "".join(x.lower() if x < "\x80" else x for x in t)
    want = brute([(d, s, (d, s, la, n, t), (d, s, la, n, low(t)) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else None) for d, t, s, la, n in rows])
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in queries.DOCUMENT)))
    log, top = manifest.manifest(table.withColumn("claimed", changed), "source", "doc_id", queries.DOCUMENT)
    assert sorted(str(tuple(r)) for r in manifest.verified(log, top).collect()) == want
    assert any("False" in x for x in want) and any("True" in x for x in want)
    empty = manifest.manifest(table.limit(0), "source", "doc_id", queries.DOCUMENT)
    assert manifest.verified(*empty).count() == 0 and empty[0].nodes().count() == 0


def test_trees_over_many_blocks(spark):
    """One group of 70,000 leaves and groups at the edges of runs and blocks: spine, addresses and proofs."""
    sizes = {"hot": 70_000, "a": 4096, "b": 4097, "c": 257, "d": 1}
    rows = [(k, s, (k,), None) for s, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame([(k, s) for k, s, _, _ in rows], "doc_id long, source string").repartition(6)
    log, top = manifest.manifest(table, "source", "doc_id", ["doc_id"])
    assert sorted(str(tuple(r)) for r in manifest.verified(log, top).collect()) == brute(rows)
    nodes = log.nodes().collect()
    by = defaultdict(dict)
    for r in nodes:
        assert r.address not in by[r.group_key]
        by[r.group_key][r.address] = r.digest
    for s, n in sizes.items():
        levels = tree([H(f"{len(str(k))}:{k}") for k in range(n)])
        assert by["=" + s] == {manifest.address(h, k, n): x for h, level in enumerate(levels) for k, x in enumerate(level)}
    one = manifest.proofs(log).filter("group_key = '=hot' and index in (0, 4095, 69999)").collect()
    assert len(one) == 3
    for r in one:
        assert manifest.fold(r.leaf.encode(), [(x.left.encode(), x.right.encode()) for x in r.siblings]).decode() == tree([H(f"{len(str(k))}:{k}") for k in range(70_000)])[-1][0]


# --- runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        j = q
        while j < len(w):
            a = j
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, e = a - q, j - 1
            if j > a and e - s + 1 >= max(12, 2 * q) and not any(all(w[t] == w[t - p] for t in range(s + p, e + 1)) for p in range(1, q)):
                out.append((s, e - s + 1, q))
            j += j == a
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_runs_of_random_words(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    r, seen = random.Random(pairs), 0
    for _ in range(250):
        texts = []
        for _ in range(r.choice([1, 3])):
            w = [r.choice("abcdef"[: r.choice([1, 2, 3, 6])]) for _ in range(r.choice([0, 1, 12, 40, 130]))]
            for _ in range(r.randint(0, 3) if w else 0):
                a, o = r.randrange(len(w)), w[:]
                p = 1 + r.randrange(max(1, (len(w) - a) // 2))
                for i in range(a, min(len(w), a + r.randint(1, len(w)))):
                    w[i] = o[a + (i - a) % p]
            texts.append(w)
        got = runs.runs_of(texts)
        assert [[tuple(x) for x in g] for g in got] == [plain_runs(w) for w in texts]
        seen += sum(map(len, got))
    assert seen > 100


def test_long_texts_of_few_words_take_no_square_time():
    assert [tuple(x) for x in runs.runs_of([["a"] * 300_000])[0]] == [(0, 300_000, 1)]
    got = runs.runs_of([(["a"] * 1000 + ["b"]) * 20])[0]
    assert (0, 20 * 1001, 1001) in [tuple(x) for x in got] and len(got) == 21


def contract(doc_id, text):
    w = runs.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return str((doc_id, len(found), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))


def test_registered_runs_query(spark, tmp_path):
    rows = [(d, t) for d, t in odd_texts() if t is None or len(t) < 20_000] + [(k, prose(30 + k, k)) for k in range(1000, 1120)]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [got.schema[n].dataType.simpleString() for n in names] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(str(tuple(r)) for r in got.select(names).collect()) == sorted(contract(*r) for r in rows)
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path / "none")).count() == 0


def test_registered_sharding_query(spark):
    got = queries.QUERIES["op11_sharding"](spark, "/root/testdata/sf0.001")
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = got.collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    held(rows, 16)
