"""Small tables with the cases that every operator has to take."""

import random

WORDS = [a + b for a in ("ba", "ko", "ti", "re", "lu", "san", "mo", "ne") for b in ("n", "ra", "st", "le", "dor", "ki")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, white space, repeats, copies, near copies, other scripts, one long text."""
    base = prose(300, 1)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (10, 150, 151)]
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, base), (5, base), (6, near[0]), (7, near[1]), (8, near[2]), (9, "a"), (10, "a b c"), (11, "A B c d e")]
    rows += [(12, "日本語 テキスト Σίσυφος ΟΔΟΣ it's <|endoftext|> x"), (13, prose(30_000, 2)), (13, "the same id again"), (None, "no id"), (None, None), (14, "x" * 50_000), (15, "ab " * 2000), (16, "tag #1  it's DON'T\r\n end")]
    return rows + [(20 + k, prose(40 + 3 * k, 100 + k)) for k in range(30)]


def docs(spark, rows=None, extra: bool = True):
    rows = odd_texts() if rows is None else rows
    out = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use inside
        out = out.selectExpr("doc_id", "text", "'en' lang", "null source", "cast(length(text) as long) n_chars", "1 fp", "2 key", "3 length", "4 label", "5 component")
    return out
