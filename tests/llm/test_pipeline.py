import corpus_pipeline
import pytest
from test_classifiers import corpus, labels
from test_near_copies import jaccard
from test_packing_topk_simhash import brute_components, valid
from test_suffixes import brute

from doclog.llm import quality, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = corpus(200)
    shared = " ".join(f"passage{k}" for k in range(60))
    texts = [(i, t if i not in (11, 22) else t + " " + shared) for i, t, _, _ in rows] + [(700, rows[1][1]), (701, None), (702, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    df.write.parquet(f"{root}/documents.parquet")
    labels(spark, rows).select("doc_id", "quality", "toxic").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_each_stage_against_brute_force(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        seen.append(name)
        if name != "packing":
            assert out.columns == docs.columns
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        if name == "quality":
            scores = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, s in scores.items() if s >= 0.7}
        elif name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.toxic_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, s in scores.items() if s < 0.5}
        elif name == "simhash":
            near = brute_components(sorted(before), lambda a, b: jaccard(before[a], before[b]) >= 0.8)
            assert {r.doc_id for r in out.collect()} == set(near.values())
        elif name == "suffixes":
            ids = sorted(before)
            data = [before[i].encode() for i in ids]
            want = {i: b"".join(t[a:b] for a, b in zip([0, *(e for _, e in s)], [*(x for x, _ in s), len(t)])).decode(errors="ignore") for i, t, s in zip(ids, data, brute(data, 400))}
            assert {r.doc_id: r.text for r in out.collect()} == want and any(len(want[i]) < len(before[i]) for i in ids)
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
            valid(out.collect(), 4096)
        docs = out
    assert seen == ["quality", "toxicity", "simhash", "suffixes", "packing"]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns[:2] == ["doc_id", "piece"]
