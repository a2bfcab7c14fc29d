"""Trees are listed by tasks, and read as Spark's reader of binary files reads them."""

from pyspark.sql import functions as F

from doclog.sources import readers


def test_a_tree_is_what_sparks_reader_finds(spark, tmp_path):
    root = tmp_path / "a tree"
    for name in ("x9.txt", "x10.txt", "é b/c/d.md", "é b/c/2", "é b/.hid/y", "_no/y", "_k=1/y", "_z", ".z", "w._COPYING_", "empty"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty" else name.encode() * 3)
    (root / "nothing").mkdir()
    for path in (str(root), f"file://{root}".replace(" ", "%20").replace("é", "%C3%A9")):
        tree = readers.read_tree(spark, path)
        theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "content", F.col("modificationTime").alias("modified"))
        got, want = (sorted(map(tuple, t.select("path", "content", "modified").collect())) for t in (tree, theirs))
        assert got == want and len(got) == 5
        names = [r.title for r in tree.collect()]
        assert names.index("x9.txt") < names.index("x10.txt")
    assert readers.read_tree(spark, str(root / "nothing")).count() == 0


def test_the_driver_lists_no_files(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 7}/{k}.txt").write_bytes(b"%d" % k)
    tree = readers.read_tree(spark, str(tmp_path))
    assert not tree.inputFiles() or all(".txt" not in f for f in tree.inputFiles())
    assert [int(r.content) for r in tree.collect()] == sorted(range(300), key=lambda k: (k % 7, k))
