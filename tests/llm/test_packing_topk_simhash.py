import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from doclog.llm import packing, simhash, topk
from helpers import docs, odd_texts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_the_tokenizers_ids(spark):
    tokenizer, want = Tokenizer.from_file(TOKENIZER), []
    for doc_id, text in odd_texts():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want.append((doc_id or -1, n, at, len(part) // 4, zlib.crc32(part)))
    got = packing.token_pieces(docs(spark), TOKENIZER).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == sorted(want)


def valid(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_in_one_and_in_many_buckets(spark):
    pieces = packing.token_pieces(docs(spark), TOKENIZER)
    total = sum(r.length for r in pieces.collect())
    whole = packing.pack(pieces.drop("ids")).collect()
    assert len(whole) == pieces.count() and valid(whole, 4096) <= math.ceil(total / 4096) + 1
    many = packing.pack(pieces.drop("ids"), bucket_tokens=8192).collect()
    assert len(many) == len(whole)
    valid(many, 4096)
    texts = packing.packed_sequences(pieces, packing.pack(pieces.filter("doc_id between 20 and 40").drop("ids"))).collect()
    assert sum(len(r.ids) // 4 for r in texts) == sum(r.length for r in pieces.filter("doc_id between 20 and 40").collect())


def test_pack_empty(spark):
    assert packing.pack(packing.token_pieces(docs(spark, []), TOKENIZER)).collect() == []


def test_local_search_takes_every_kind_of_step():
    # three bins of 10, where two hold all: {5, 3, 2} and {4, 3, 3}
    lengths = np.array([5, 4, 3, 3, 3, 2])
    bins = packing.local_search(lengths, np.array([0, 0, 1, 1, 2, 2]), 10)
    assert len(set(bins.tolist())) == 2 and np.bincount(bins, lengths).max() <= 10
    random.seed(5)
    for _ in range(20):
        lengths = np.array([random.randint(1, 60) for _ in range(200)])
        start = packing.best_fit(lengths, 100)
        end = packing.local_search(lengths, start, 100)
        assert np.bincount(end, lengths).max() <= 100
        assert len(np.unique(end)) <= len(np.unique(start))


def brute_top(rows, k):
    usable = sorted({(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        best = sorted({(-sum(a * b for a, b in zip(t, u)), i, u) for qi, t in usable if qi == q for i, u in usable if i != q})[:k]
        out += [(q, n, i, -s) for n, (s, i, _) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("blocks", [(512, 4096), (2, 7)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, 0.11]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (220, [float("nan")] * 6), (240, [float("inf")] * 6), (260, []), (280, [0.5, 0.5]), (None, [1.0] * 6), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 q", "2 c", "3 terms", "4 score")
    held = topk.quantised(df)
    got = [tuple(x) for x in topk.top_k(held.filter("vec_id % 20 = 0"), held, 20).collect()]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(got) == brute_top(rows, 20)


def test_top_k_few_and_none(spark):
    df = topk.quantised(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(df.filter("vec_id = 0"), df).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.filter("vec_id > 5"), df.filter("vec_id > 5")).collect() == []


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_golay_keys_meet():
    golay, r = simhash.Golay(), random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        fps = np.array([a, b], np.uint64).view(np.int64)
        keys, at = simhash.golay_keys(fps, golay)
        assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())
        assert np.bincount(at).max() <= 3 * 36


@pytest.mark.parametrize("run", [2048, 4])
def test_simhash(spark, run):
    rows = odd_texts()
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted((i or -1, p, least.get(root[p]) or -1) for (i, _), p in zip(rows, prints))
    got = simhash.near_duplicates(docs(spark), run).collect()
    assert sorted((r.doc_id or -1, r.fp % 2**64, r.component_id or -1) for r in got) == want


@pytest.mark.parametrize("run", [2048, 8])
def test_links_over_many_fingerprints(spark, run):
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(50)]
    for _ in range(400):
        x = r.choice(fps)
        for bit in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << bit
        fps.append(x)
    signed = sorted({int(np.uint64(x).view(np.int64)) for x in fps})
    want = brute_components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), run).collect()
    edges = {frozenset((e.a, e.b)) for e in links}
    assert brute_components(signed, lambda a, b: frozenset((a, b)) in edges) == want


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
