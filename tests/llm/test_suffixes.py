import random

import numpy as np
import pytest

from doclog.llm import common, suffixes
from helpers import docs, odd_texts, prose


def brute(texts, length):
    """Removed [start, end) runs of each text."""
    seen, out = {}, []
    for n, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], set()).add((n, s))
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for s in range(len(t) - length + 1):
            if len(seen[t[s : s + length]]) > 1:
                gone[s : s + length] = 1
        edge = np.diff(np.r_[np.int8(0), gone])
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
    return out


def passages(seed):
    r = random.Random(seed)
    shared = [prose(r.randint(10, 60), 1000 + k) for k in range(6)]
    rows = []
    for k in range(150):
        text = prose(r.randint(0, 60), 5000 + k)
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            i = r.randint(0, len(p) // 3)
            text += p[i : len(p) - r.randint(0, len(p) // 3)] + prose(r.randint(0, 20), r.randint(0, 10**6))
        rows.append((k, text))
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (202, "é" * 150), (203, "ab" * 200), (204, "x" * 99 + "é" * 60)]


@pytest.mark.parametrize("shard", [2048, 4])
@pytest.mark.parametrize(("length", "gram"), [(100, 50), (60, 20)])
def test_removed_spans(spark, length, gram, shard):
    rows = passages(length) + [(None, prose(40, 5003)), (None, None)]
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((i if i is not None else -1, len(t), tuple(s), t) for (i, _), t, s in zip(rows, texts, brute(texts, length)))
    got = suffixes.dedup(docs(spark, rows), length, gram, shard).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, tuple((s.start, s.end) for s in r.spans)) for r in got)
    assert found == [w[:3] for w in want]
    kept = sorted(r.kept for r in got)
    assert kept == sorted(b"".join(t[i:j] for i, j in zip([0, *(e for _, e in s)], [*(b for b, _ in s), len(t)])) for _, _, s, t in want)


def test_odd_texts(spark):
    rows = odd_texts()
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((i or -1, len(t), sum(b - a for a, b in s), len(s)) for (i, _), t, s in zip(rows, texts, brute(texts, 400)))
    got = suffixes.dedup(docs(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans)) for r in got) == want


def test_empty(spark):
    assert suffixes.dedup(docs(spark, [])).collect() == []


def test_sides_and_their_order():
    r = random.Random(4)
    left, right = ([bytes(r.choice(b"\0\1ab") for _ in range(r.randint(0, 30))) for _ in range(400)] for _ in range(2))
    group = np.array([r.randint(0, 3) for _ in left])
    sides = [suffixes.Sides(x, 30) for x in (left, right)]
    assert [suffixes.ordered(x) for x in sorted(left)] == sorted(map(suffixes.ordered, left))
    got = suffixes.anchored_order(group, sides[0], sides[1]).tolist()
    want = sorted((g, x, y) for g, x, y in zip(group.tolist(), left, right))
    assert [(group[k], left[k], right[k]) for k in got] == want
    a, b = np.array(got[:-1]), np.array(got[1:])
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert sides[0].shared(a, b).tolist() == [common(left[i], left[j]) for i, j in zip(a.tolist(), b.tolist())]


def test_aligned_bounds_hold_every_repeated_window():
    r, need = random.Random(6), 12
    left, right = ([bytes(r.choice(b"aab") for _ in range(need)) for _ in range(300)] for _ in range(2))
    group = np.array([r.randint(0, 4) for _ in left])
    again, most_left, most_right, open_ = suffixes.aligned(group, left, right, need)
    for o in range(need + 1):
        seen = {}
        for g, x, y in zip(group.tolist(), left, right):
            seen[g, x[:o], y[: need - o]] = seen.get((g, x[:o], y[: need - o]), 0) + 1
        for k, (g, x, y) in enumerate(zip(group.tolist(), left, right)):
            true = seen[g, x[:o], y[: need - o]] > 1
            assert true or not again[k, o]
            assert not true or (need - most_right[k] <= o <= most_left[k])
            assert again[k, o] == true or open_[k]


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for n in (1, 2, 9, 300):
        data = bytes(r.choice(b"ab") for _ in range(n))
        order, words, shared = suffixes.suffix_array(np.frombuffer(data, np.uint8), 1 << 10)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        before = np.full(n, -1)
        before[order[1:]] = order[:-1]
        got = suffixes.common_prefixes(words, order, shared, np.array([0]), np.array([n]), 20)
        for i in range(n):
            j = before[i]
            if j >= 0 and max(i, j) + 20 < n:
                k = 0
                while k < 20 and data[i + k] == data[j + k]:
                    k += 1
                assert got[i] == k or got[i] <= k < 20


@pytest.mark.parametrize("key", [None, 7])
def test_texts_of_one_id_share_a_passage_at_one_place(spark, key):
    header, longer = prose(120, 1)[:450], prose(300, 2)[:900]
    texts = [header + prose(60, 3), header + prose(60, 4), longer + prose(60, 5), longer + prose(60, 6), longer + prose(60, 6), prose(80, 7)]
    df = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")
    want = [s for s in brute([t.encode() for t in texts], 400)]
    assert want[0] and want[2]
    got = [[(s.start, s.end) for s in r.spans] for r in suffixes.dedup(df).collect()]
    assert sorted(got) == sorted(want)


def test_passages_of_over_fifty_short_words_go(spark):
    # 51 words, at most 254 bytes: one passage that repeats, one of 50 words, one that differs in its 26th word, one spaced otherwise
    short = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    changed = short("c", 51).replace(" c25 ", " other ")
    texts = ["one " + short("a", 51) + " two", "three\n" + short("a", 51).replace(" ", "\t") + "\nfour", "five " + short("b", 50) + " six", "seven " + short("b", 50) + " eight"]
    texts += ["nine " + short("c", 51) + " ten", "eleven " + changed + " twelve", short("d", 60) + " x " + short("d", 60), short("e", 30), None, prose(200, 1)]
    want, seen = [], {}
    split = [(t or "").split() for t in texts]
    for n, w in enumerate(split):
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), set()).add((n, k))
    for n, w in enumerate(split):
        gone = {j for k in range(len(w) - 50) if len(seen[tuple(w[k : k + 51])]) > 1 for j in range(k, k + 51)}
        want.append([x for j, x in enumerate(w) if j not in gone])
    assert want[0] == ["one", "two"] and want[1] == ["three", "four"] and want[6] == ["x"] and want[2:6] == split[2:6]
    df = docs(spark, list(enumerate(texts)))
    assert {r.doc_id: r.text.split() for r in suffixes.dedup_texts(df, words=51).collect()} == dict(enumerate(want))
    whole = {r.doc_id: r.text.split() for r in suffixes.dedup_texts(df).collect()}
    assert whole[0] == split[0] and whole[1] == split[1]


def test_bitmap_stops_hashes_that_are_all_small(spark):
    # the least of 201 hashes each, as anchors have them
    least = np.random.default_rng(3).integers(0, 2**64, (10_000, 201), np.uint64, endpoint=False).min(axis=1)
    own, other = least[:5000], least[5000:]
    bits = common.bitmap(spark.createDataFrame([(x,) for x in own.view(np.int64).tolist()], "h long"))
    assert common.in_bitmap(bits, own).all()
    assert common.in_bitmap(bits, other).mean() < 0.02


def test_words_are_coded_in_the_step_that_reads_them(spark):
    # one Python worker a task: each further step of a stage holds a worker of its own
    df = docs(spark, [(1, prose(60, 1)), (2, prose(60, 1))]).selectExpr("cast(text as binary) text")
    found = suffixes.occurrences(df, 8 * 51, 8 * 26, suffixes.Words(51))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert found.count() > 0
