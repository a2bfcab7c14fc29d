import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from doclog.llm import ppm
from helpers import docs, odd_texts


class Brute:
    """PPM by its definition, symbol by symbol over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            stream = [ppm.START] * order + [*t, ppm.END]
            for k in range(order, len(stream)):
                for m in range(order + 1):
                    self.seen[tuple(stream[k - m : k])][stream[k]] += 1

    def score(self, text):
        stream, out = [ppm.START] * self.order + [*text, ppm.END], 0.0
        for k in range(self.order, len(stream)):
            excluded = set()
            for m in range(self.order, -1, -1):
                left = {s: n for s, n in self.seen.get(tuple(stream[k - m : k]), {}).items() if s not in excluded}
                total = sum(left.values()) + len(left)
                if stream[k] in left:
                    out += log10(left[stream[k]] / total)
                    break
                if left:
                    out += log10(len(left) / total)
                excluded |= set(left)
            else:
                out -= log10(257 - len(excluded))
        return out


def fold(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize(("order", "frequent"), [(4, 200_000), (2, 5)])
def test_scores(spark, order, frequent):
    rows = [(i, (t or "").encode()) for i, t in odd_texts() if i != 13] + [(99, b"UPPER lower upper")]
    learn = [t for i, t in rows if not fold(i)]
    words = Counter(w for t in learn for w in [*t.lower().split(), " "])
    n, v, brute = sum(words.values()), len(words), Brute(learn, order)
    want = []
    for i, t in rows:
        own = [*t.lower().split(), " "]
        base = sum(log10((words[w] + 1) / (n + v + 1)) for w in own)
        want.append((i or -1, fold(i), len(own), sum(words[w] > 0 for w in own), n, round(base, 6), round(brute.score(t), 6)))
    df = docs(spark, [(i, t.decode()) for i, t in rows])
    got = ppm.score(df, order, frequent=frequent).collect()
    found = [(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for g, w in zip(sorted(found), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-4)


def test_a_pruned_trie_still_sums_to_one():
    texts = [b"abracadabra", b"abab", b"zebra"] * 3
    keys, counts = np.unique(ppm.strings(texts, 2), return_counts=True)
    levels = []
    for m in range(3):
        k, at = np.unique(keys & ((1 << 9 * (m + 1)) - 1), return_inverse=True)
        n = np.bincount(at, counts)
        levels.append((k[n >= 4], n[n >= 4]))
    trie = ppm.Trie(levels)
    for context in (b"ab", b"zz", b"ra"):
        full = np.array([(context[0] << 18) | (context[1] << 9) | s for s in range(257)])
        assert 10 ** trie.code_lengths(full) @ np.ones(257) == pytest.approx(1)


def test_empty_and_untrained(spark):
    assert ppm.score(docs(spark, [])).collect() == []
    only = next(i for i in range(100) if fold(i))
    r = ppm.score(docs(spark, [(only, "ab")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0) and r.score == pytest.approx(-3 * log10(257))


def test_the_table_of_costs_changes_nothing():
    trie = ppm.Trie([np.unique(ppm.strings([b"some text, some more"], 4) & ((1 << 9 * (m + 1)) - 1), return_counts=True) for m in range(5)])
    texts = [b"some", b"text or other", b"", b"some more"]
    small, large = ppm.Scorer(trie, 4, slots=2), ppm.Scorer(trie, 4)
    for _ in range(3):
        assert np.allclose(small(texts), large(texts)) and np.allclose(small(texts), [trie.code_lengths(ppm.strings([t], 4)).sum() for t in texts])


def test_no_string_is_cut_from_the_model(spark):
    rows = [(i, (t or "").encode()) for i, t in odd_texts() if i != 13] + [(i, b"abracadabra %d" % (i % 7)) for i in range(200, 240)]
    brute = Brute([t for i, t in rows if not fold(i)], 4)
    want = sorted((i or -1, round(brute.score(t), 6)) for i, t in rows)
    df = docs(spark, [(i, t.decode()) for i, t in rows])
    for nodes in (0, 20):
        got = sorted((r.doc_id or -1, r.score) for r in ppm.score(df, nodes=nodes).collect())
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)


def test_strings_are_dealt_in_whole_groups(spark):
    texts = [bytes(np.random.default_rng(k).choice(list(b"abc "), 300).tolist()) for k in range(6)]
    counts = ppm.string_counts(spark.createDataFrame([(t, False) for t in texts[:4]] + [(t, True) for t in texts[4:]], "text binary, held_out boolean"))
    keys, n = np.unique(ppm.strings(texts[:4], 4), return_counts=True)
    trie = ppm.Trie([ppm.summed([(keys & ((1 << 9 * (m + 1)) - 1), n)]) for m in range(5)])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    try:
        found = ppm.costs(counts, chunk=1).toPandas()
    finally:
        spark.conf.set(size, before)
    assert len(found) == len(np.unique(ppm.strings(texts, 4))) and found.seen.sum() == 6 * 301
    assert np.allclose(found.cost, trie.code_lengths(found.s.to_numpy()))
