import random
import zlib

import numpy as np
import pytest

from doclog.llm import quality, toxicity
from helpers import docs, odd_texts, prose


def corpus(n=400):
    """(doc_id, text, toxic, quality): insults make a text toxic, noise makes it bad."""
    r, rows = random.Random(6), []
    for k in range(n):
        words = prose(r.randint(30, 120), 9000 + k).split()
        toxic, bad = k % 6 == 0, k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zornik", "wugga", "plenk"]))
        if bad:
            words = [w + r.choice(["%%%", "$$$", "&&&"]) for w in words]
        rows.append((k, " ".join(words), int(toxic), int(not bad)))
    return rows


def labels(spark, rows):
    known = [(i, q, t) for i, _, t, q in rows if i % 10 < 8]
    return spark.createDataFrame([*known, (None, 1, 1), (3, None, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "1 text", "2 p")


@pytest.mark.parametrize(("of", "folds", "fold", "cut", "column"), [(toxicity.toxic_scores, 5, 0, 0.5, 2), (quality.quality_scores, 4, 2, 0.7, 3)])
def test_held_out_accuracy(spark, of, folds, fold, cut, column):
    rows = corpus()
    got = of(docs(spark, [r[:2] for r in rows]), labels(spark, rows)).collect()
    assert len(got) == len(rows)
    truth, right, n = {r[0]: r[column] for r in rows}, 0, 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        n += r.held_out
        right += r.held_out and r.predicted == truth[r.doc_id]
    assert right >= 0.93 * n


@pytest.mark.parametrize("of", [toxicity.toxic_scores, quality.quality_scores])
def test_odd_texts_and_no_labels(spark, of):
    rows = corpus(200)
    scored = of(docs(spark, odd_texts() + [r[:2] for r in rows]), labels(spark, rows)).collect()
    assert len(scored) == len(odd_texts()) + 200 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out for r in scored if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(of(docs(spark), none).collect()) == len(odd_texts())
    assert of(docs(spark, []), none).collect() == []


def test_risk_is_non_negative_in_effect():
    # with few positives and flexible words, the corrected estimator must not push unlabelled rows below the prior's share
    r = np.random.default_rng(0)
    p = [np.array([0])] * 20
    u = [np.array([0]) if k < 25 else r.choice(np.arange(1, 50), 5, replace=False) for k in range(200)]
    w = toxicity.fit(p, u, 50, 0.125)
    score = lambda row: 1 / (1 + np.exp(-(w[row].sum() + w[50])))
    assert score(np.array([0])) > 0.5 > max(score(x) for x in u[25:])


def test_training_ignores_the_held_out_fold(spark):
    rows = corpus(200)
    flipped = [(i, x, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, x, t, q in rows]
    frame = docs(spark, [r[:2] for r in rows])
    for of in (toxicity.toxic_scores, quality.quality_scores):
        a, b = ({r.doc_id: round(r.score, 9) for r in of(frame, labels(spark, x)).collect()} for x in (rows, flipped))
        assert a == b
