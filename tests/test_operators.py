"""Hand-made logs for the traps of the query semantics."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from doclog.functions import address, text
from doclog.operators import audit, filters, meta, results, sync
from doclog.operators.catalog import Catalog, dedup_files, dedup_rows, ingest, lookup, resolve, synonyms, uri_index, verify_known, written_out


def make(spark, files, metas, fields, words=()):
    """files: (file_id, hash, type); metas: (meta_file_id, target); fields: (meta_file_id, field, value)."""
    f = spark.createDataFrame([(i, h, t, 10) for i, h, t in files], "file_id long, hash string, type string, size long")
    uris = f.select(F.explode(F.array(F.concat(F.lit("hash://sha256/"), "hash"), F.concat(F.lit("hash://sha256/"), F.substring("hash", 1, 4)))).alias("uri"), "file_id")
    return Catalog(
        f, uris, spark.createDataFrame(list(metas), "meta_file_id long, target_uri string"),
        spark.createDataFrame(list(fields), "meta_file_id long, field string, value string"), spark.createDataFrame(list(words), "term string, meta_file_id long"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("sort_id", "file_id").collect())


URI = "hash://sha256/"


def test_a_file_with_many_metas_comes_once_at_its_first(spark):
    c = make(spark, [(1, "aaaaaa", "t")], [(5, URI + "aaaaaa"), (7, URI + "aaaa"), (9, URI + "aaaaaa")], [(k, "x", "1") for k in (5, 7, 9)])
    assert rows(filters.metadata(c, "x", "1")) == [(5, 1)] and rows(filters.visible(c)) == [(5, 1)]
    assert rows(filters.metadata(c, "X", "1")) == [] and rows(filters.metadata(c, "X", "1", ignore_case=True)) == [(5, 1)]


def test_or_binds_tighter_than_and_and_ages_combine(spark):
    files = [(k, f"{k}{k}{k}{k}{k}{k}", "t") for k in (1, 2, 3)]
    metas = [(10 + n, URI + f"{k}" * 6) for n, k in enumerate((1, 1, 2, 3, 3))]
    c = make(spark, files, metas, [(10, "a", "1"), (11, "b", "1"), (12, "a", "1"), (13, "c", "1"), (14, "a", "1")])
    a, b, cc = (filters.metadata(c, f, "1") for f in "abc")
    assert rows(filters.all_of(a, filters.any_of(b, cc))) == [(11, 1), (14, 3)]
    assert rows(filters.any_of(a, b)) == [(10, 1), (12, 2), (14, 3)] and filters.all_of(a) is a


@pytest.mark.parametrize(("gone", "kept"), [(4, False), (5, False), (6, True)])
def test_negation_looks_back_only(spark, gone, kept):
    plus, minus = (spark.createDataFrame([(s, 1)], "sort_id long, file_id long") for s in (5, gone))
    assert bool(rows(filters.without(plus, minus))) == kept


def test_collisions_anchors_and_pages(spark):
    c = make(spark, [(1, "aaaaaa", "t"), (2, "aaaaaa", "u"), (3, "bbbbbb", "t"), (4, "cccccc", "t")], [(10 + k, URI + h) for k, h in enumerate(["aaaaaa", "bbbbbb", "cccccc"])], [])
    assert rows(filters.by_uri(c, URI + "aaaaaa")) == [(1, 1), (2, 2)]
    wanted = spark.createDataFrame([(URI + "aaaa",)], "uri string")
    assert resolve(c.uris, wanted).first().file_id == 1
    assert {r.synonym for r in synonyms(c.uris, spark.createDataFrame([(URI + "aaaa",), ("other",)], "uri string")).collect()} == {URI + "aaaa", URI + "aaaaaa", "other"}
    seen = filters.visible(c)
    for bad in (URI + "aaaaaa", "unknown"):
        with pytest.raises(results.AnchorError):
            results.page(c, seen, bad)
    full, at, paged = rows(seen), None, []
    for _ in range(2):
        part = results.page(c, seen, at, 2).orderBy("at").collect()
        paged += [(r.sort_id, r.file_id) for r in part]
        at = URI + "bbbbbb" if part[-1].file_id == 3 else None
        if at is None:
            break
    assert paged[:2] == full[:2]
    assert [r.file_id for r in results.page(c, seen, "-" + URI + "cccccc", 1).collect()] == [3]
    assert [r.file_id for r in results.page(c, seen, "-", 1).collect()] == [4]


def test_links_use_synonyms(spark):
    c = make(spark, [(1, "aaaaaa", "t"), (2, "bbbbbb", "t")], [(5, URI + "bbbbbb")], [(5, "link", URI + "aaaa")])
    assert rows(filters.links_to(c, URI + "aaaaaa")) == [(5, 2)] and rows(filters.metadata(c, "link", URI + "aaaaaa")) == []
    assert rows(filters.linked_from(c, URI + "bbbbbb")) == [(5, 1)]


def test_fulltext_takes_the_first_token(spark):
    c = make(spark, [(1, "aaaaaa", "t")], [(5, URI + "aaaaaa")], [], [("foo", 5)])
    assert rows(filters.fulltext(c, '"Foo-bar"')) == [(5, 1)] and rows(filters.fulltext(c, "bar foo")) == []
    with pytest.raises(ValueError):
        filters.fulltext(c, "-- !")


def test_fulltext_by_stems(spark):
    c = make(spark, [(1, "aaaaaa", "t"), (2, "bbbbbb", "t")], [(5, URI + "aaaaaa"), (6, URI + "bbbbbb")], [], [("run", 5), ("running", 6)])
    assert rows(filters.fulltext(c, "running")) == [(6, 2)]
    assert rows(filters.fulltext(replace(c, stems=meta.stemmed(c.postings)), "Runs-fast")) == [(5, 1), (6, 2)]


def test_many_queries_of_every_shape(spark):
    """Against the combinators, over drawn queries."""
    r = random.Random(3)
    files = [(k, f"{k:06}", "t") for k in range(1, 31)]
    metas = [(100 + n, URI + f"{r.randint(1, 30):06}") for n in range(200)]
    fields = [(m, f, str(r.randint(0, 2))) for m, _ in metas for f in "ab" if r.random() < 0.6]
    c = make(spark, files, metas, fields, [(r.choice(["foo", "bar", "baz"]), m) for m, _ in metas])
    clauses, want = [], []
    for q in range(25):
        plus, minus = [], []
        for g in range(r.randint(1, 4)):
            negated, parts = r.random() < 0.3, []
            for _ in range(r.randint(1, 3)):
                kind, field, value = r.choice([("metadata", "a", str(r.randint(0, 3))), ("metadata", "b", "1"), ("fulltext", "", r.choice(["foo x", "bar", "none"]))])
                clauses.append((q, g, kind, field, value, negated))
                parts.append(filters.fulltext(c, value) if kind == "fulltext" else filters.metadata(c, field, value))
            (minus if negated else plus).append(filters.any_of(*parts))
        if plus and q < 12:
            found = filters.all_of(*plus)
            for m in minus:
                found = filters.without(found, m)
            want += [(q, *x) for x in rows(found)]
    df = spark.createDataFrame(clauses, "query_id int, group_id int, kind string, field string, value string, negated boolean")
    assert sorted(tuple(x) for x in filters.many_queries(c, df).filter("query_id < 12").collect()) == sorted(want)


def test_visibility(spark):
    table = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    bodies = [("u1", "Notes\n\nx"), ("u2", "x #open y"), ("u3", "x"), ("u4", "Notes\n\ncall 1-234-567-8901"), ("u5", "x #open #private"), ("u6", "#open\nKeywords: alpha, private"), ("u7", "#open"), ("u8", None), ("u8", "plain")]
    df = spark.createDataFrame(bodies, "uri string, body string")
    got = text.classify_visibility(df, table("topic", "Notes"), table("tag", "open", "open"), table("uri", "u3"), table("uri", "u7"))
    assert sorted((r.uri, r.public) for r in got.collect()) == [("u1", True), ("u2", True), ("u3", True), ("u4", False), ("u5", False), ("u6", False), ("u7", False), ("u8", False), ("u8", False)]


def test_many_queries(spark):
    c = make(spark, [(1, "aaaaaa", "t"), (2, "bbbbbb", "t")], [(5, URI + "aaaaaa"), (6, URI + "bbbbbb"), (7, URI + "bbbbbb")], [(5, "a", "1"), (6, "a", "1"), (7, "z", "1")], [("foo", 5), ("foo", 7)])
    q = [(1, 0, "metadata", "a", "1", False), (1, 1, "fulltext", "", "foo bar", False), (2, 0, "metadata", "a", "1", False), (2, 1, "metadata", "z", "1", True), (3, 0, "metadata", "a", "1", True), (4, 0, "metadata", "a", "1", False), (4, 1, "metadata", "none", "1", False)]
    df = spark.createDataFrame(q, "query_id int, group_id int, kind string, field string, value string, negated boolean")
    assert sorted(tuple(r) for r in filters.many_queries(c, df).collect()) == [(1, 5, 1), (1, 7, 2), (2, 5, 1), (2, 6, 2)]


def test_ingest_and_addresses(spark):
    df = spark.createDataFrame([(1, "x", "t"), (2, "x", "t"), (3, "x", "u"), (4, "", "t")], "seq long, content string, type string")
    found = ingest(df)
    assert sorted(r.file_id for r in dedup_files(found).collect()) == [1, 3]
    per = uri_index(found).groupBy("file_id").count().collect()
    assert {r["count"] for r in per} == {9}
    known = df.withColumn("known_uri", F.when(F.col("seq") == 1, "hash://sha256/bad"))
    assert [r.accepted for r in verify_known(known).orderBy("seq").collect()] == [False, True, True, True]


@pytest.mark.parametrize(("uri", "want"), [("hash://sha256/ab?type=x#f", ("sha256", "ab", "type=x", "f")), ("hash://sha1/ab/", ("sha1", "ab", None, None)), ("http://x/y", None), ("hash://a/" + "b" * 600, None)])
def test_parse_hash_uri(spark, uri, want):
    got = spark.createDataFrame([(uri,)], "u string").select(address.parse_hash_uri(F.col("u"))).first()[0]
    assert (tuple(got) if got else None) == want


BODIES = [
    ('{"a":"x","b":{"y":{},"z":{}}}', {("a", "x"), ("b", "y"), ("b", "z")}), ('{"a":{"b":{"c":{}}}}', {("a", "b")}), ("{}", set()),
    ('{"from":"http://h:8080/x","at":"12:30","said":"see: true story, [1] {x}"}', {("from", "http://h:8080/x"), ("at", "12:30"), ("said", "see: true story, [1] {x}")}),
    ('{"ARRAY":"x","BIGINT":{"NULL":{}}}', {("ARRAY", "x"), ("BIGINT", "NULL")}), ('{"k":"1","k":"2","k":{"3":{},"4":{}}}', {("k", "1"), ("k", "2"), ("k", "3"), ("k", "4")}),
    (r'{"a":"say \"hi\"","b":"{\"n\":1}","c":{"d\\":{}}}', {("a", 'say "hi"'), ("b", '{"n":1}'), ("c", "d\\")}), ('{"a":{}}', set()), (' { "a" :\n{ "b" : "c" } } ', {("a", "b")}),
    ('{"a":"x"} {"b":"y"}', None), ('{"a":"x"},"b":{"c":"d"}', None), ("{'a':'x'}", None), ('{"a":"x",}', None), ('{"a":{"b":[]}}', None), ("", None), ("{", None), ('{"a"}', None),
    ('{"a":1}', None), ('{"a":[]}', None), ('{"a":null}', None), ('{"a":true}', None), ('{"a":{"b":{"c":5}}}', None), ('{"a":"x"', None), ("[]", None),
]


@pytest.mark.parametrize(("body", "want"), BODIES)
def test_flatten_meta(spark, body, want):
    df = meta.split_target(spark.createDataFrame([(URI + "ab\r\n\r\n" + body,)], "content string"))
    r = meta.flatten_meta(df).first()
    assert r.target_uri == URI + "ab" and (None if r.fields is None else {tuple(f) for f in r.fields}) == want


def test_meta_over_the_limit_is_cut(spark):
    body = '{"a":"x","b":{"y":{}},"fulltext":"' + "w " * (1 << 20)
    r = meta.flatten_meta(meta.split_target(spark.createDataFrame([(URI + "ab\n\n" + body,)], "content string"))).first()
    assert {tuple(f) for f in r.fields} == {("a", "x"), ("b", "y")}


def test_targets_must_be_older_files(spark):
    uris = spark.createDataFrame([("u1", 1), ("u5", 5), ("m", 3)], "uri string, file_id long")
    metas = spark.createDataFrame([(3, "u1"), (4, "u5"), (6, "u5"), (7, "m"), (8, "none")], "meta_file_id long, target_uri string")
    got = meta.validate_target(metas, uris, spark.createDataFrame([(3,)], "meta_file_id long"))
    assert sorted(r.meta_file_id for r in got.collect()) == [3, 6]


def test_first_value_and_merge(spark):
    metafiles = spark.createDataFrame([(3, "u"), (4, "u"), (5, "short")], "meta_file_id long, target_uri string")
    fields = spark.createDataFrame([(4, "t", "a"), (3, "t", "c"), (3, "t", "b"), (5, "t", "z"), (3, "fulltext", "w")], "meta_file_id long, field string, value string")
    assert {tuple(r) for r in meta.first_value(metafiles, fields, "t").collect()} == {("u", "b"), ("short", "z")}
    assert {r.target_uri: r.fields for r in meta.merge_meta(metafiles, fields).collect()} == {"u": {"t": ["a", "b", "c"]}, "short": {"t": ["z"]}}


#: Pairs printed in the paper of 1980.
STEMS = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor hopping hop falling fall filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper hopefulness hope electrical electr replacement replac adoption adopt effective effect rate rate controll control roll roll"


def test_porter(spark):
    pairs = STEMS.split()
    assert [text.porter_stem(w) for w in pairs[::2]] == pairs[1::2]
    found = meta.stemmed(spark.createDataFrame([("cats", 1), ("cat", 1), ("hopping", 2)], "term string, meta_file_id long"))
    assert {tuple(r) for r in found.collect()} == {("cat", 1), ("hop", 2)}


@pytest.mark.parametrize(
    ("of", "body", "want"),
    [
        (text.hashtags, "#one x #123 (#two) a#no #ab", ["one", "two"]), (text.keywords, "x\nKeywords: alpha, be, gamma\n", ["alpha", " gamma"]),
        (text.topic, "A topic\n\nbody", "A topic"), (text.topic, "Ends.\n\nbody", None), (text.topic, "Notes 2020-01-02 x\n\nbody", "Notes"), (text.topic, "a:b\n\nx", None),
        (text.dates, "on 2024--02-03 3:05 PM and 2024-13-01", ["2024-02-03T15:05:00Z"]), (text.phones, "1-234-567-8901 or (234) 567-8901", ["1-234-567-8901", "(234) 567-8901"]),
        (text.links_in_text, "see http://a.b/c(d). and (www.x.org/y)", ["http://a.b/c(d)", "www.x.org/y"]), (text.links_in_text, "x" * (1 << 20) + " http://a.b/", None),
        (text.links_in_markdown, "[a](http://x.y/z) ![i](pic.png) <http://q.r/>", ["http://x.y/z", "http://q.r/"]), (text.embeds_in_markdown, "![i](pic.png) [a](b)", ["pic.png"]),
        (text.links_in_text, "http://a.b/" + "x" * 9000 + ".", ["http://a.b/" + "x" * 9000]), (text.links_in_markdown, f"[a [b](http://x.y/{'z' * 5000}_(1) 'title')", [f"http://x.y/{'z' * 5000}_(1)"]),
        (text.links_in_markdown, "[![i](pic.png)](http://x.y/z)\n\n[r]: <http://r.s/t> (note)", ["http://x.y/z", "http://r.s/t"]), (text.embeds_in_markdown, f"![i](data:image/png;base64,{'A' * 70_000})", [f"data:image/png;base64,{'A' * 70_000}"]),
        (text.links_in_markdown, "[](" * 200_000, []), (text.links_in_markdown, "[" * 300_000, []), (text.links_in_text, "http://a.b/c" + "()" * 300_000, ["http://a.b/c" + "()" * 300_000]),
        (text.render_plain, "<hash://sha256/ab>", '<pre>&lt;<a href="?q=hash%3A%2F%2Fsha256%2Fab">hash://sha256/ab</a><sup>[<a href="hash://sha256/ab" title="hash address">#</a>]</sup>&gt;</pre>'),
        (text.render_plain, "it's (http://a.b/c?d=1&e.) www.x.org", '<pre>it&apos;s (<a href="http://a.b/c?d=1&amp;e">http://a.b/c?d=1&amp;e</a>.) <a href="www.x.org">www.x.org</a></pre>'), (text.render_plain, "a < b", "<pre>a &lt; b</pre>"), (text.cdata, "a]]>b", "<![CDATA[a]]]]><![CDATA[>b]]>"),
        (text.natural_key, "a10b", "a" + "10".zfill(20) + "b"),
    ],
)
def test_text(spark, of, body, want):
    got = spark.createDataFrame([(body,)], "b string").select(of(F.col("b"))).first()[0]
    assert (sorted(got) if isinstance(got, list) else got) == (sorted(want) if isinstance(want, list) else want)


def test_tag_edits(spark):
    df = spark.createDataFrame([("hash://sha256/ab\n+ #one\n- #two\n+ #three\n",), ("hash://sha256/ab\ntext",)], "b string")
    got = [r[0] for r in df.select(text.tag_edits(F.col("b"))).collect()]
    assert got[0].target == URI + "ab" and got[0].tags == ["one", "three"] and got[1] is None


@pytest.mark.parametrize(("size", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1 << 20, "1.0 MB"), (1 << 55, "32768.0 TB")])
def test_human_size(spark, size, want):
    assert spark.createDataFrame([(size,)], "n long").select(text.human_size(F.col("n"))).first()[0] == want


def test_audit_and_sync(spark):
    df = spark.createDataFrame([("x",)], "content string").select("content", F.concat(F.lit("hash://sha1/"), F.sha1("content")).alias("uri"), F.lit(1).alias("size"))
    both = df.union(df.withColumn("content", F.lit("y"))).union(df.withColumn("size", F.lit(2)))
    assert tuple(audit.verify_summary(audit.verify_content(both)).first()) == (2, 3)
    files = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("r", 1, "a")], "source_id string, position long, uri string")
    metas = spark.createDataFrame([("s", 9, "m1", "a"), ("s", 3, "m2", "a"), ("r", 4, "m3", "b")], "source_id string, hint_id long, uri string, target_uri string")
    plan = sync.sync_meta_plan(metas, files, spark.createDataFrame([("zz",)], "uri string"))
    assert [(r.source_id, r.uri) for r in sync.sync_order(files, plan).collect()] == [("r", "a"), ("s", "a"), ("s", "m2"), ("s", "m1"), ("s", "b")]


def test_tags(spark):
    got = meta.add_tags(spark.createDataFrame([(URI + "ab",)], "uri string"), ["x", "y"]).first()
    assert json.loads(got.content.split("\n\n")[1]) == {"tag": {"x": {}, "y": {}}}


def test_lookups_by_digests_are_those_by_addresses(spark):
    """Every form of every address, and what is none: a start of another length, another name, a file of another type."""
    held = spark.range(60).select((F.col("id") + 1).alias("seq"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("content"), F.when(F.col("id") % 3 == 0, "t").otherwise("u").alias("type"))
    rows = dedup_rows(ingest(held, {**address.ALGORITHMS, "crc32": (4, lambda c: F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0"))})).select("file_id", "digests")
    uris = written_out(rows)
    cut = uris.select(F.expr("substring(uri, 1, length(uri) - 1)").alias("uri"))
    wanted = uris.select("uri").union(cut).union(uris.select(F.upper("uri"))).union(spark.sql("select explode(array(null, '', 'http://x/y', 'hash://sha256/')) uri"))
    got = lookup(rows, wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, uris.select("uri", "file_id").collect())) and got.count() == 10 * rows.count()


def test_a_lookup_shuffles_digests_and_no_addresses(spark):
    log = Catalog(*[None] * 5, digests=spark.range(10).select(F.col("id").alias("file_id"), address.digests(F.col("id").cast("string").cast("binary")).alias("digests")), resolved=spark.range(3).selectExpr("id meta_file_id", "id file_id"))
    plan = log.standing_for(log.digests.select(F.lit("hash://sha1/ab").alias("uri")))._jdf.queryExecution().executedPlan().toString()
    assert "hash://sha512/" not in plan and log.targets() is log.resolved
