"""Every registered query of this subpackage: names and types of its columns, and what its contract says of rows."""

import zlib

import pytest

from doclog.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_sentencepiece": "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_sha256 string",
    "op5_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_ppm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}
HELD = {"op6_toxicity": (5, 0, 0.5), "op7_quality": (4, 2, 0.7), "op10_ppm_scores": (7, 2, None)}


def test_all_are_listed():
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, DIR)
    want = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {f.name: f.dataType.simpleString() for f in got.schema if f.name in want} == want
    rows = got.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    if name == "op1_best_fit_packing":
        at, of = {}, {}
        for r in rows:
            at.setdefault(r.sequence_id, []).append((r.offset, r.length))
            of.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        for spans in at.values():
            spans.sort()
            assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 4096
        for pieces in of.values():
            pieces.sort()
            assert [(p, s) for p, s, _ in pieces] == [(k, 4096 * k) for k in range(len(pieces))] and all(n == 4096 for _, _, n in pieces[:-1])
        assert set(of) == set(docs)
    elif "doc_id" in want:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name in HELD:
        mod, rest, cut = HELD[name]
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
            if cut is not None:
                assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
            else:
                assert r.score < 0 and 0 <= r.n_known <= r.n_tokens and r.train_tokens == rows[0].train_tokens
