from pyspark.sql import functions as F

from doclog.sources import readers, writers


def test_tree_and_lists(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    for name, data in (("a10.txt", b"ten"), ("a9.md", b"# nine"), ("sub/x.bin", b"\xff\x00")):
        (tmp_path / "t" / name).write_bytes(data)
    rows = readers.read_tree(spark, str(tmp_path / "t")).collect()
    assert [r.title for r in rows] == ["a9.md", "a10.txt", "x.bin"]
    assert [r.type for r in rows][:2] == ["text/markdown", "text/plain"] and rows[0].fulltext == "a9.md\n# nine" and rows[2].fulltext == "x.bin"
    (tmp_path / "list").write_bytes(b"# no\r\nhash://a/1\rhash://a/2 -> hash://b/1\n\n  \nbad line\nhash://a/3")
    assert readers.read_uri_list(spark, str(tmp_path / "list")).count() == 4
    good, bad = readers.read_meta_list(spark, str(tmp_path / "list"))
    assert [tuple(r) for r in good.collect()] == [("hash://a/2", "hash://b/1")] and bad.count() == 3


def test_written_lists_keep_their_order(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("sort_id"), "id").select("sort_id", F.col("id").alias("file_id"), F.concat(F.lit("u"), F.lpad("sort_id", 3, "0")).alias("uri"))
    writers.write_uri_list(df, str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw.decode().split("\r\n")[:-1] == sorted(f"u{k:03}" for k in range(100))


def test_hash_tree(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab/abcd12").write_bytes(b"x")
    (tmp_path / "ab/cd12").write_bytes(b"x")
    assert [r.uri for r in readers.hash_tree(spark, str(tmp_path)).collect()] == ["hash://sha256/abcd12"]


def test_numbered_uri_list(spark, tmp_path):
    rows = spark.range(500).selectExpr("cast(pmod(id * 37, 500) as long) sort_id", "id file_id", "concat('hash://a/', pmod(id * 37, 500)) uri").repartition(7)
    writers.write_uri_list(rows, str(tmp_path / "many"))
    got = readers.read_numbered_uri_list(spark, str(tmp_path / "many")).collect()
    assert sorted((r.line, r.uri) for r in got) == [(k + 1, f"hash://a/{k}") for k in range(500)]


def test_a_written_tree_is_read_back(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.col("id").cast("string"), F.lit("/x/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    assert writers.write_tree(rows, str(tmp_path / "t")) == 50 and writers.write_tree(rows.limit(3), str(tmp_path / "t")) == 3
    got = readers.tree_meta(readers.read_tree(spark, str(tmp_path / "t")), ("title", "content")).collect()
    assert sorted((r.title, bytes(r.content)) for r in got) == sorted((f"{k}.txt", b"%d" % k) for k in range(50))
    assert all(r.title == r.fields[0].value for r in got)
