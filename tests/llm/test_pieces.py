import random

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from doclog.llm import pieces
from helpers import docs, odd_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
MATCHER = pieces.Matcher(MODEL)
MORE = ["  two  spaces ", "\n\n\t x", "aaa aaaaaaa bbb", " ", "é" * 100, "😀😀 emoji", "a\r\nb\x00c", "<s> </s> <0x0A> <unk>", "unbelievably antidisestablishmentarianism"]


def test_ids_and_round_trip_over_a_table(spark):
    rows = odd_texts() + [(500 + k, t) for k, t in enumerate(MORE)]
    found = pieces.decode(pieces.encode(docs(spark, rows), MODEL), MODEL).collect()
    want = [(i or -1, np.array(LIBRARY.encode(t or ""), "<u4").tobytes(), t or "") for i, t in rows]
    assert sorted((r.doc_id or -1, r.ids, r.text) for r in found) == sorted(want)


def test_empty(spark):
    assert pieces.encode(docs(spark, []), MODEL).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdehinorstu  .,'\nABéß日1"), max_size=60), min_size=1, max_size=8))
def test_ids_equal_the_librarys(texts):
    assert MATCHER.encode(texts) == [np.array(LIBRARY.encode(t), "<u4").tobytes() for t in texts]


def test_every_occurrence_is_found():
    text = "the other then 12 thé the"
    start, piece = MATCHER.edges(np.array([ord(c) for c in text], np.uint64))
    names = {i: MATCHER.names[i] for i in MATCHER.piece_ids.tolist()}
    want = {(s, p) for p in names.values() for s in range(len(text)) if text.startswith(p, s)}
    assert {(s, names[MATCHER.piece_ids[p]]) for s, p in zip(start.tolist(), piece.tolist())} == want


def test_long_words_go_through_the_matcher():
    r = random.Random(5)
    long = ["x" * 50_000, "ab" * 25_000, "".join(r.choice("abcdehinorstuéß日1") for _ in range(50_000)), "日本語" * 3_000, "a" * 63, "b" * 64, "the" * 22, "\0\0 nul\0"]
    alone = pieces.Matcher(MODEL)
    alone.library = None  # nothing may be left to it
    assert alone.encode(long) == [np.array(LIBRARY.encode(t), "<u4").tobytes() for t in long]
    assert [alone.decode(x) for x in alone.encode(long)] == long
