import random

import corpus_pipeline
import pytest

from doclog.llm import common, simhash
from helpers import prose


def jaccard(a, b):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows):
    """doc_id of the least row of each group, by all pairs."""
    root = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(None if none else i for none, i in least.values())


def edited(seed):
    """Texts and copies with some words changed: similarities on both sides of 0.8."""
    r, rows = random.Random(seed), []
    for k in range(40):
        words = prose(r.randint(60, 200), seed + k).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            changed = list(words)
            for at in r.sample(range(len(words)), r.randint(1, max(1, len(words) // 30))):
                changed[at] = f"new{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(changed)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two")]


@pytest.mark.parametrize("run", [simhash.RUN, 2])
def test_the_stage_keeps_what_brute_force_keeps(spark, run):
    rows = edited(7)
    sims = [jaccard(rows[4 * k][1], rows[4 * k + j][1]) for k in range(40) for j in (1, 2, 3)]
    assert sum(0.8 <= s < 0.9 for s in sims) > 20 and sum(0.7 < s < 0.8 for s in sims) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.no_near_copies(spark, docs, "") if run == simhash.RUN else simhash.keep_one(docs, run=run)
    assert sorted(r.doc_id for r in out.collect()) == kept_by_brute_force(rows)


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    a, b, c, d = (prose(120, 300 + k) for k in range(4))
    near = a + " tail"
    rows = [(5, a), (5, a), (9, near), (None, a), (None, b), (None, b), (None, b + " end"), (6, c), (6, d), (7, d), (8, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.no_near_copies(spark, docs, "")
    got = sorted(((r.doc_id is None, r.doc_id, r.text) for r in out.collect()), key=repr)
    unnamed = [t for none, _, t in got if none]
    assert len(unnamed) == 1 and unnamed[0] in (b, b + " end")
    assert [g[1:] for g in got if not g[0]] == sorted([(5, a), (6, c), (6, d), (8, None)], key=repr)
    whole = corpus_pipeline.no_repeated_passages(spark, out, "")  # nothing is left that repeats
    assert sorted((repr(r.doc_id), r.text) for r in whole.collect()) == sorted((repr(r.doc_id), r.text or "") for r in out.collect())


@pytest.mark.parametrize("one_task", [0, 3, 1 << 20])
def test_components_in_one_task_or_in_rounds(spark, one_task):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2100)] + [(5, None), (None, None), (7, 7)]
    rows = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    root = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for _ in range(400):
        for a, b in pairs:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in common.components(rows, one_task=one_task).collect()}
    assert got == root
    assert common.components(rows.limit(0), one_task=one_task).count() == 0
