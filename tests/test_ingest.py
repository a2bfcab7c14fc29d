"""What the ingest of the fixture log keeps, and what its lookups shuffle."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from doclog.operators import filters, results
from doclog.plans import fixtures
from doclog.sources.writers import load_catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables, whose events come twice, and a log of them."""
    path = str(tmp_path_factory.mktemp("tables"))
    for p in os.listdir(DIR):
        shutil.copy(f"{DIR}/{p}", f"{path}/{p}")
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.union(events.withColumn("event_id", F.col("event_id") + 100_000)).write.parquet(f"{path}/twice")
    os.rename(f"{path}/twice", f"{path}/events.parquet.d")
    os.remove(f"{path}/events.parquet")
    os.rename(f"{path}/events.parquet.d", f"{path}/events.parquet")
    root = str(tmp_path_factory.mktemp("log"))
    fixtures.build(spark, path, root)
    return path, root


@pytest.fixture()
def no_automatic_broadcasts(spark):
    """As where tables are too large for one."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_log_keeps_contents_and_what_was_asked_for(spark, odd):
    assert sorted(os.listdir(odd[1])) == ["blobs", "metadata", "metas", "targets"]
    assert not {"hash", "digests", "fulltext"} & set(spark.read.parquet(f"{odd[1]}/metas").columns)


def test_of_equal_metas_the_oldest_is_kept_with_its_text(spark, odd):
    c = load_catalog(spark, odd[1])
    come = fixtures.staged_metas(spark, odd[0])
    want = {(r.seq, r.hash) for r in come.groupBy("content").agg(F.min("seq").alias("seq")).select("seq", F.sha2("content", 256).alias("hash")).collect()}
    got = {(r.file_id, r.hash) for r in c.files.filter("type = 'application/vnd.doclog.meta'").collect()}
    assert got == want and len(got) < come.count()
    texted = spark.read.parquet(f"{odd[1]}/metas").filter("texted").select("file_id")
    own = come.filter("texted").groupBy("content").agg(F.min("seq").alias("seq"))
    assert {r.file_id for r in texted.collect()} == {r.seq for r in own.collect()}
    sides = [sorted(map(tuple, x.collect())) for x in (c.metas(), c.metafiles.join(c.files, F.col("file_id") == F.col("meta_file_id")).select("meta_file_id", "target_uri", "hash"))]
    assert sides[0] == sides[1] and sides[0]


def test_a_small_result_shuffles_no_files(spark, odd, no_automatic_broadcasts):
    c = load_catalog(spark, odd[1])
    found = results.with_uri(filters.metadata(c, "lang", "fr"), c.files)
    assert "BroadcastHashJoin" in plan(found) and "Exchange hashpartitioning" not in plan(found)
    asked = c.standing_for(found.select("uri"))
    assert "BroadcastHashJoin" in plan(asked) and "Exchange hashpartitioning" not in plan(asked)
    assert "Join" not in plan(filters.visible(c))
