"""Streams, kept tables and what is built on the log's order, on hand-made logs."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclog.functions.address import hash_uris
from doclog.operators import analytics, filters, meta, sync, tags
from doclog.operators.catalog import Catalog
from doclog.sources import follow, writers
from doclog.streaming import ingest, tail

PLAIN, META = "text/plain", meta.META_TYPES[0]


def batches(spark, folder, schema, steps, make, mode="append"):
    """Feed a stream step by step, a run for each; the rows that it gave."""
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        tail.run_to_end(make(stream), f"{folder}/out", f"{folder}/checkpoint", mode)
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").drop("batch_id").collect()]


def test_tail_gives_each_file_once_at_its_first(spark, tmp_path):
    steps = [[(5, 1), (3, 1), (4, 2)], [(6, 1), (7, 3), (8, 3)], [(9, 3), (10, 2)], [(11, 4)]]
    got = batches(spark, tmp_path, "sort_id long, file_id long", steps, tail.tail, "update")
    assert sorted(got) == [(3, 1), (4, 2), (7, 3), (11, 4)]


def test_streams_run_without_python(spark):
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("sort_id"), F.col("value").alias("file_id"), F.lit(0).alias("clause"), F.lit(False).alias("negated"))
    for df in (tail.tail(stream), tail.tail_all_of(stream, 2)):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_all_of_as_they_come(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.randrange(12), r.randrange(3), r.random() < 0.15) for k in range(120)]
    steps = [rows[:40], rows[40:41], rows[41:90], rows[90:]]
    got = batches(spark, tmp_path, "sort_id long, file_id long, clause int, negated boolean", steps, lambda s: tail.tail_all_of(s, 3), "update")
    want = []
    for f in range(12):
        own = [x for x in rows if x[1] == f]
        first = [min((x[0] for x in own if x[2] == c and not x[3]), default=None) for c in range(3)]
        gone = min((x[0] for x in own if x[3]), default=10**9)
        if None not in first and gone > max(first):
            want.append((max(first), f))
    assert sorted(got) == sorted(want) and want


STEPS = "target_uri string, seq long, is_meta boolean, uri string, addresses array<string>"


def test_held_meta_files(spark, tmp_path):
    steps = [
        [("a", 1, True, "m1", None), ("b", 2, True, "m2", None)], [("a", 3, True, "m3", None), ("x", 4, False, "x", ["b", "x"]), ("b", 5, True, "m5", None), ("x", 6, True, "m6", None)],
        [("a", 7, False, "a", None), ("a", 8, True, "m8", None), ("a", 9, False, "a", None)], [("a", 10, True, "m10", None), ("c", 11, True, "m11", None)],
    ]
    got = batches(spark, tmp_path, STEPS, steps, tail.hold_until_target)
    assert sorted(got) == sorted([(1, "m1", "a", 0), (3, "m3", "a", 1), (8, "m8", "a", 2), (10, "m10", "a", 3), (2, "m2", "b", 0), (5, "m5", "b", 1), (6, "m6", "x", 0)])


def test_a_target_that_100_000_meta_files_wait_for(spark, tmp_path):
    """They come in five steps; a step appends its own to the list, and the file releases them one by one."""
    n, each = 100_000, 20_000
    for k in range(n // each):
        spark.range(k * each, (k + 1) * each).selectExpr("'hot' target_uri", "id seq", "true is_meta", "concat('m', id) uri", "cast(null as array<string>) addresses").write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([("hot", n, False, "f", None)], STEPS).write.parquet(f"{tmp_path}/in/last")
    paths = [str(k) for k in range(n // each)] + ["last"]
    for k, p in enumerate(paths):
        (tmp_path / "log").mkdir(exist_ok=True)
        for x in (tmp_path / "in" / p).glob("*.parquet"):
            x.rename(tmp_path / "log" / f"{k}-{x.name}")
        stream = spark.readStream.schema(STEPS).parquet(f"{tmp_path}/log")
        tail.run_to_end(tail.hold_until_target(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert tuple(out.agg(F.count("*"), F.count_distinct("seq"), F.min("position"), F.max("position"), F.count_if(F.col("seq") != F.col("position"))).first()) == (n, n, 0, n - 1, 0)


def uri(content: str) -> str:
    return "hash://sha256/" + hashlib.sha256(content.encode()).hexdigest()


LOG = "seq long, content string, type string, fulltext string"


def log_steps():
    first = f'{uri("one")}\n\n{{"a":"x"}}'
    return [
        [(1, "one", PLAIN, None), (2, "one", PLAIN, None), (3, "one", "text/markdown", None), (4, "", PLAIN, None), (5, first, META, "some words"), (6, uri("two") + '\n\n{"a":"early"}', META, None)],
        [(7, "two", PLAIN, None), (8, "one", PLAIN, None), (9, uri("one")[:38] + '\n\n{"b":{"p":{},"q":{}}}', META.upper(), "more"), (10, first, META, None), (11, uri(first) + '\n\n{"a":"y"}', META, None)],
        [(12, uri("two") + '\n\n{"a":1}', META, None), (13, uri("two") + '\n\n{"a":"b"', META, None), (14, '\n\n{"a":"b"}', META, None), (15, uri("two") + '\n\n{"a":"late"}', META, "words")],
    ]


def test_tables_kept_batch_by_batch(spark, tmp_path):
    log = ingest.LogTables(spark, f"file://{tmp_path}/log", 4)
    assert log.complete() == -1 and log.read("files").count() == 0
    for k, rows in enumerate(log_steps()):
        batch = spark.createDataFrame(rows, LOG)
        ingest.append_batch(log, batch, k)
        ingest.append_batch(log, batch, k)  # a batch that is run again
    read = lambda name, *c: sorted(tuple(r) for r in log.read(name).select(*c).collect())
    assert [x[0] for x in read("files", "file_id")] == [1, 3, 5, 6, 7, 9, 11, 12, 13, 14, 15]
    assert read("metafiles", "meta_file_id", "target_uri") == [(5, uri("one")), (9, uri("one")[:38]), (15, uri("two"))]
    assert read("rejects", "meta_file_id", "reason") == [(6, "412"), (11, "412"), (12, "kind"), (13, "json"), (14, "target")]
    assert read("metadata", "meta_file_id", "field", "value") == [(5, "a", "x"), (9, "b", "p"), (9, "b", "q"), (15, "a", "late")]
    assert read("postings", "meta_file_id", "term") == [(5, "some"), (5, "words"), (9, "more"), (15, "words")]
    # every address of every algorithm, sha512 too
    want = set()
    for file_id, content in ((1, "one"), (3, "one"), (7, "two")):
        for name in ("sha1", "sha256", "sha512"):
            h = hashlib.new(name, content.encode()).hexdigest()
            want |= {(f"hash://{name}/{h[:n]}", file_id) for n in (64, 48, 24) if n <= len(h)} | {(f"hash://{name}/{h}", file_id)}
    assert {x for x in read("uris", "uri", "file_id") if x[1] in (1, 3, 7)} == want
    again = ingest.LogTables(spark.newSession(), f"file://{tmp_path}/log", 4)
    assert again.complete() == 2 and again.read("files").count() == 11


def test_addresses_are_kept_short(spark, tmp_path):
    """A row for each algorithm, not for each address; targets of every form are found, and of no other."""
    log = ingest.LogTables(spark, f"file://{tmp_path}/log", 4)
    one = uri("one")
    rows = [(1, "one", PLAIN, None), (2, "two", PLAIN, None)] + [(10 + k, f'{t}\n\n{{"n":"{k}"}}', META, None) for k, t in enumerate([one, one[:38], one[:62], one[:39], one.upper(), "hash://sha256/", "x", uri("two")[:38] + "0"])]
    ingest.append_batch(log, spark.createDataFrame(rows, LOG), 0)
    assert log.before("uris", 1).count() == 3 * len(rows) and log.read("uris").count() == 9 * len(rows)
    later = [(30, f'{one[:38]}\n\n{{"n":"later"}}', META, None), (31, f'{one[:40]}\n\n{{"n":"later"}}', META, None)]
    ingest.append_batch(log, spark.createDataFrame(later, LOG), 1)
    assert sorted(r.meta_file_id for r in log.read("metafiles").collect()) == [10, 11, 12, 30]
    assert sorted(r.meta_file_id for r in log.read("rejects").filter("reason = '412'").collect()) == [13, 14, 15, 16, 17, 31]


def test_generations(spark, tmp_path):
    """Batches before the last are merged; the last may run again, and the next go on; the old generation stays as it was."""
    old = ingest.LogTables(spark, f"file://{tmp_path}/log", 2)
    plain = ingest.LogTables(spark, f"file://{tmp_path}/plain", 4)
    steps = [spark.createDataFrame(rows, LOG) for rows in log_steps()]
    for k in (0, 1):
        ingest.append_batch(old, steps[k], k)
    new = old.compact(3)
    assert (new.buckets, new.generation, new.complete()) == (3, 1, 1)
    ingest.append_batch(new, steps[1], 1)
    ingest.append_batch(new, steps[2], 2)
    for k, batch in enumerate(steps):
        ingest.append_batch(plain, batch, k)
    opened = ingest.LogTables(spark, f"file://{tmp_path}/log")
    assert (opened.buckets, opened.generation) == (3, 1)
    for name in ingest.TABLES:
        rows = lambda log: sorted(map(str, (tuple(r) for r in log.read(name).collect())))  # noqa: B023, E731
        assert rows(opened) == rows(plain) and len(rows(old)) <= len(rows(plain))
    assert [r.batch_id for r in spark.table(new.names["files"]).select("batch_id").distinct().orderBy("batch_id").collect()] == [0, 1, 2]
    empty = ingest.LogTables(spark, f"file://{tmp_path}/empty", 2).compact()
    assert empty.complete() == -1 and empty.read("uris").count() == 0


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    log = ingest.LogTables(spark, f"file://{tmp_path}/log", 4)
    steps = log_steps()
    ingest.append_batch(log, spark.createDataFrame(steps[0], LOG), 0)
    log.write("files", spark.createDataFrame([(99, "h", "t", 1)], "file_id long, hash string, type string, size long"), 1)
    assert log.read("files").filter("file_id = 99").count() == 0
    ingest.append_batch(log, spark.createDataFrame(steps[1], LOG), 1)
    assert log.read("files").filter("file_id = 99").count() == 0 and log.read("files").filter("file_id = 7").count() == 1


def test_files_without_a_type_or_content(spark, tmp_path):
    log = ingest.LogTables(spark, f"file://{tmp_path}/log", 2)
    ingest.append_batch(log, spark.createDataFrame([(1, "x", None, None), (2, "x", None, None), (3, None, PLAIN, None)], LOG), 0)
    ingest.append_batch(log, spark.createDataFrame([(4, "x", None, None), (5, uri("x") + '\n\n{"a":"b"}', META, None)], LOG), 1)
    ingest.append_batch(log, spark.createDataFrame([], LOG), 2)
    assert [r.file_id for r in log.read("files").orderBy("file_id").collect()] == [1, 5] and log.read("metadata").count() == 1 and log.complete() == 2


def test_history_is_not_shuffled(spark, tmp_path):
    """Two exchanges for the batch's keys (made distinct, dealt to buckets), none between the join and the table."""
    log = ingest.LogTables(spark, f"file://{tmp_path}/log", 4)
    ingest.append_batch(log, spark.createDataFrame(log_steps()[0], LOG), 0)
    staged = spark.createDataFrame([("h", "t")], "hash string, type string")
    for found in (ingest.known_files(log.before("files", 1), staged), ingest._found(log.before("uris", 1), staged.select(F.col("hash").alias("uri")).distinct(), "uri")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        join = plan.index("ShuffledHashJoin")
        scan = plan.index("FileScan parquet")
        assert "Bucketed: true" in plan and join < scan and "Exchange" not in plan[join:scan]


def test_algorithms_are_a_table(spark):
    own = {"md5": (16, F.md5), "sha1": (20, F.sha1)}
    got = spark.createDataFrame([("x",)], "c string").select(hash_uris(F.col("c").cast("binary"), own)).first()[0]
    md5, sha1 = hashlib.md5(b"x").hexdigest(), hashlib.sha1(b"x").hexdigest()
    assert sorted(got) == sorted([f"hash://md5/{md5[:24]}", f"hash://md5/{md5}", f"hash://sha1/{sha1[:24]}", f"hash://sha1/{sha1}"])


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src_file_id long, dst_file_id long")


def test_closure_ends_on_cycles_and_stops_at_what_is_held(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (5, 6), (7, 7), (7, None), (1, 2)])
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "file_id long")
    got = lambda wanted, held: sorted(tuple(r) for r in sync.sync_closure(e, ids(wanted), ids(held)).collect())
    assert got([1], [5]) == [(1, 0), (2, 1), (3, 2), (4, 2)]
    assert got([7, 7], []) == [(7, 0)] and got([1], [1]) == [] and got([], []) == []


def test_two_hops_with_hubs(spark):
    r = random.Random(1)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(300)] + [(k, 3) for k in range(100, 400)] + [(3, 8), (3, 9), (9, 9), (5, None)]
    got = Counter({(x.src_file_id, x.dst_file_id): x.ways for x in analytics.backlinks_two_hops(edges(spark, pairs), most=7).collect()})
    hops = {(a, b) for a, b in pairs if b is not None and a != b}
    want = Counter((a, d) for a, b in hops for c, d in hops if b == c)
    assert got == want and analytics.backlinks_two_hops(edges(spark, [])).count() == 0


def test_a_hub_of_100_000_links_is_split_over_tasks(spark):
    hub = spark.range(1, 100_001).select(F.col("id").alias("src_file_id"), F.lit(0).cast("long").alias("dst_file_id")).union(edges(spark, [(0, -1), (0, -2)]))
    got = analytics.backlinks_two_hops(hub, most=1000)
    assert got.count() == 200_000
    parts = hub.filter("dst_file_id = 0").select(F.pmod(F.hash("src_file_id"), F.lit(100)).alias("part")).groupBy("part").count().agg(F.max("count"), F.count("*")).first()
    assert parts[0] < 1500 and parts[1] == 100


def test_tags_come_and_go(spark):
    levels = [(1, "t", 0, 5), (1, "t", 1, 9), (1, "t", 2, 12), (2, "t", 0, 8), (2, "t", 1, 6), (2, "t", 2, 20), (3, "t", 1, 4), (4, "t", 0, 7), (4, "t", 2, 9), (5, "u", 0, 3)]
    spans = tags.tag_intervals(spark.createDataFrame(levels, "file_id long, tag string, level int, sort_id long"))
    # 2: taken back before it was set; 3: only taken back; 4: level 1 is missing
    assert sorted(map(str, (tuple(r) for r in spans.collect()))) == sorted(map(str, [(1, "t", 5, 9), (1, "t", 12, None), (2, "t", 20, None), (4, "t", 7, None), (5, "u", 3, None)]))
    asked = spark.createDataFrame([("t", k) for k in (4, 5, 8, 9, 12, 20)] + [("t", 20), ("none", 1)], "tag string, at long")
    got = sorted((r.at, r.file_id) for r in tags.tags_as_of(spans, asked).collect())
    assert got == [(5, 1), (8, 1), (8, 4), (9, 4), (12, 1), (12, 4), (20, 1), (20, 2), (20, 4)]
    values = spark.createDataFrame([("a~1",), ("a",), ("b~c",), ("a~0",), ("a~12",)], "v string").select(*tags.parsed(F.col("v"))).collect()
    assert [tuple(r) for r in values] == [("a", 1), ("a", 0), ("b~c", 0), ("a~0", 0), ("a", 12)]


@pytest.mark.parametrize(("words", "found"), [("to be", {1, 2}), ("be to", {2}), ("to to", {3}), ("to to to", set()), ("not", {2}), ("or not To-be", {2})])
def test_phrases_from_stored_positions(spark, words, found):
    texts = spark.createDataFrame([(11, "to be"), (12, "be to or not to be, not"), (13, "to to do")], "meta_file_id long, fulltext string")
    c = Catalog(*[spark.createDataFrame([], "file_id long, hash string, type string, size long"), spark.createDataFrame([(f"u{k}", k) for k in (1, 2, 3)], "uri string, file_id long"), spark.createDataFrame([(10 + k, f"u{k}") for k in (1, 2, 3)], "meta_file_id long, target_uri string")], None, None)
    assert {r.file_id for r in filters.phrase(c, meta.build_places(texts), words).collect()} == found


def test_the_first_converter_that_fits_is_used(spark):
    class Halves:
        def eval(self, kind, content):
            for k, part in enumerate((content or "").split("|")):
                yield f"half{k}", part

    own = writers.TableConverter(lambda t: t == "x/halves", Halves)
    late = writers.TableConverter(lambda t: t == "text/plain", Halves)
    files = spark.createDataFrame([("a", "x/halves", "l|r"), ("b", "text/plain", "see http://a.b/c|"), ("c", "other", "z"), ("d", None, "z"), ("e", "x/halves", None)], "uri string, type string, content string")
    got = sorted(tuple(r) for r in writers.converted(files, [own, *writers.CONVERTERS, late]).collect())
    assert got == [("a", "half0", "l"), ("a", "half1", "r"), ("b", "fulltext", "see http://a.b/c|"), ("b", "link", "http://a.b/c|"), ("e", "half0", "")]


def test_a_list_is_followed_by_positions(spark, tmp_path, monkeypatch):
    (tmp_path / "list").mkdir()
    first = tmp_path / "list" / "0"
    run = lambda: tail.run_to_end(follow.follow_list(spark, str(tmp_path / "list")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    seen = lambda: sorted((r.file, r.byte, r.uri) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first.write_bytes(b"# head\r\nu:1\r\n\nu:2\ru:3\nu:4 is not whole")
    run()
    assert [x[2] for x in seen()] == ["u:1", "u:2", "u:3"]
    first.write_bytes(first.read_bytes() + b" yet\r\nu:5\n")
    (tmp_path / "list" / "_SUCCESS").write_bytes(b"")
    run()
    (tmp_path / "list" / "1").mkdir()
    (tmp_path / "list" / "1" / "part").write_bytes(b"u:6\nu:7\n")
    run()
    run()
    raw = first.read_bytes()
    assert [x[2] for x in seen()] == ["u:1", "u:2", "u:3", "u:4 is not whole yet", "u:5", "u:6", "u:7"]
    assert all(raw[b:].startswith(u.encode()) for f, b, u in seen() if f == "0")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_ranges_of_a_list_part_its_lines(tmp_path, monkeypatch, size):
    monkeypatch.setattr(follow, "RANGE", size)
    monkeypatch.setattr(follow, "LOOK", 2)
    lines = [f"uri:{k}" * (k % 4) for k in range(40)]
    (tmp_path / "f").write_bytes("\n".join(lines).encode() + b"\ncut")
    reader = follow.UriLogReader(str(tmp_path))
    end = reader.latestOffset()
    got = [x for p in reader.partitions(reader.initialOffset(), end) for x in reader.read(p)]
    assert [x[2] for x in got] == [x for x in lines if x] and end["byte"] == len("\n".join(lines)) + 1


def test_addresses_that_nothing_waits_for_stay_out_of_python(spark):
    steps = spark.readStream.format("rate").load().selectExpr("'a' target_uri", "value seq", "false is_meta", "'u' uri", "array('x', 'y') addresses")
    plan = tail.hold_until_target(steps)._jdf.queryExecution().analyzed().toString()
    python = next(line for line in plan.splitlines() if "TransformWithState" in line)
    below = plan[plan.index(python) :]
    assert "Join Inner" in plan[: plan.index(python)] and "explode" not in below[: below.index("Deduplicate")]


def test_edges_of_a_closure_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    src = F.udf(lambda k: seen.add(1) or k, "long").asNondeterministic()
    edges = spark.range(0, 30, 1, 2).select(src("id").alias("src_file_id"), (F.col("id") + 1).alias("dst_file_id"))
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "file_id long")
    assert sorted(tuple(r) for r in sync.sync_closure(edges, ids(20), ids(25)).collect()) == [(20 + k, k) for k in range(5)] and seen.value == 30
