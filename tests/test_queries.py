"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from doclog.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SOME = ["hash_uris", "uri_synonyms", "meta_flatten", "select_meta", "cap_meta", "visibility", "links_text", "links_markdown", "tag_edits", "fulltext_meta", "render_plain", "f_fulltext", "meta_list", "page_forward", "maintained_tables", "meta_validate", "f_and", "f_not", "many_queries", "page_backward", "preview", "tail_and", "hold_until_target", "dump_and_load", "rejected_metas", "sync_closure", "pull_sets", "backlinks_two_hops", "tags_as_of", "tail_tags", "tail_not", "tail_metadata", "f_phrase", "term_places", "converted_custom", "resume_from_list", "hash_plugin", "read_tree", "export_paths", "provenance", "page_anchors"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in os.listdir(DIR):
        c.execute(f"create view {p.split('.')[0]} as select * from read_parquet('{DIR}/{p}')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 10 and set(entry.oracle_sql()) <= set(entry.queries())
