"""Scoring texts by prediction by partial matching (PPM), and by a unigram baseline over words.

The model is a trie of byte contexts of up to ORDER bytes, pretrained on all training texts: counts of the ORDER + 1 symbols
ending at each place (the text's end is a symbol, its start fills the first contexts), summed by Spark, and their marginals for
the shorter contexts. Escape estimation is method C: a context with total T and u distinct symbols escapes with u / (T + u);
symbols that a longer context has seen are excluded below it. Contexts of the same counts nest, so what is excluded on escape
depends on the context alone, and a symbol's code length on the ORDER + 1 symbols alone; workers remember it per such string.

Nothing is cut from the model: the code length of every string in any text is worked out once, from counts over all training
texts, where Spark has brought together the strings of equal last two context symbols (all that longer contexts need; contexts
below are at most 257 * 258 strings, which are broadcast). Code lengths of at most NODES strings, those that occur most often, are
broadcast; all others are joined to their texts. So are words: the counts of the FREQUENT most frequent ones are broadcast.

Null texts are empty: one end token, one end symbol. Null doc_ids are scored and count as held out. Rows that repeat are texts of
their own. Other columns are ignored. Without training texts, N and V are 0 and the model is uniform.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, text_bytes
from .toxicity import held_out

ORDER = 4
NODES = 1 << 20
FREQUENT = 200_000
FOLDS, FOLD = 7, 2
END, START, SYMBOLS, BITS = 256, 257, 257, 9
#: A token no text can hold: words have no spaces.
END_TOKEN = b" end"


def strings(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The order + 1 symbols ending at each place, the last one lowest, of each text and its end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    stream = np.full(int(sizes.sum()) + order * len(texts), START, np.int64)
    firsts = np.cumsum(sizes + order) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)
    body = np.full(int(sizes.sum()), END, np.int64)
    inside = np.ones(len(body), bool)
    inside[np.cumsum(sizes) - 1] = False
    body[inside] = np.frombuffer(b"".join(texts), np.uint8)
    stream[at] = body
    out = np.zeros(len(body), np.int64)
    for k in range(order, -1, -1):
        out = (out << BITS) | stream[at - k]
    return out


def starts(texts: list[bytes]) -> np.ndarray:
    """Where each text's strings start."""
    return np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])


def slices(texts: list[bytes], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """Texts in parts of about `size` bytes."""
    low, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield texts[low : k + 1]
            low, held = k + 1, 0
    if low < len(texts):
        yield texts[low:]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def string_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """s (order + 1 symbols), n and seen: how often in those of `texts` (a binary column, then whether it is held out) to learn from, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = np.unique(np.concatenate([p[0][0] for p in parts if p]))
            counts = np.zeros((2, len(keys)), np.int64)
            for fold, p in enumerate(parts):
                if p:
                    own, n = p.pop()
                    counts[fold, np.searchsorted(keys, own)] = n
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, counts[0], counts[0] + counts[1])], ["s", "n", "seen"])

        parts: tuple[list, list] = [], []
        for batch in batches:
            for fold, p in enumerate(parts):
                for part in slices(batch.column(0).filter(pc.equal(batch.column(1), bool(fold))).to_pylist()):
                    p.append(np.unique(strings(part, order), return_counts=True))
                    if len(p) == 16:
                        p[:] = [summed(p)]
                if p and len(p[0][0]) > 1 << 21:
                    for q in parts:
                        q[:] = [summed(q)] if q else []
                    yield out()
        for p in parts:
            p[:] = [summed(p)] if p else []
        if any(parts):
            yield out()

    return texts.mapInArrow(lean(run), "s long, n long, seen long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


class Trie:
    """Counts of the strings of each order, sorted, with totals and exclusions of their contexts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels, self.contexts = [], []
        for m, (keys, counts) in enumerate(levels):
            by = np.argsort(keys)
            keys, counts = keys[by], counts[by].astype(np.float64)
            self.levels.append((keys, counts))
            if not len(keys):
                self.contexts.append((keys, counts, counts, counts))
                continue
            heads = np.flatnonzero(np.r_[True, (keys[1:] >> BITS) != (keys[:-1] >> BITS)])
            below = self.count(m - 1, keys) if m else np.zeros(len(keys))
            self.contexts.append((keys[heads] >> BITS, np.add.reduceat(counts, heads), np.diff(np.r_[heads, len(keys)]).astype(np.float64), np.add.reduceat(below, heads)))

    def count(self, m: int, full: np.ndarray) -> np.ndarray:
        keys, counts = self.levels[m]
        want = full & ((1 << BITS * (m + 1)) - 1)
        at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        return np.where(keys[at] == want, counts[at], 0.0) if len(keys) else np.zeros(len(full))

    def code_lengths(self, full: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each string."""
        out, alive = np.zeros(len(full)), np.ones(len(full), bool)
        gone, distinct = np.zeros(len(full)), np.zeros(len(full))
        for m in range(len(self.levels) - 1, -1, -1):
            keys, totals, kinds, below = self.contexts[m]
            if not len(keys):
                continue
            want = (full >> BITS) & ((1 << BITS * m) - 1)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            known = keys[at] == want
            escape = np.where(known, kinds[at] - distinct, 0.0)
            whole = np.where(known, totals[at] - gone, 0.0) + escape
            own = np.where(known, self.count(m, full), 0.0)
            hit = alive & (own > 0)
            out[hit] += np.log10(own[hit] / whole[hit])
            alive &= ~hit
            fall = alive & known & (escape > 0)
            out[fall] += np.log10(escape[fall] / whole[fall])
            gone, distinct = np.where(known, below[at], gone), np.where(known, kinds[at], distinct)
        out[alive] -= np.log10(SYMBOLS - distinct[alive])
        return out


def costs(counts: DataFrame, order: int = ORDER, chunk: int = 1 << 18) -> DataFrame:
    """s, seen and cost (log10 probability of the last symbol) of each row of string_counts()."""
    learnt = counts.filter("n > 0")
    low = []
    for m in range(min(2, order + 1)):  # at most 257 and 257 * 258 rows
        found = learnt.groupBy(F.col("s").bitwiseAND((1 << BITS * (m + 1)) - 1).alias("s")).agg(F.sum("n").alias("n")).toArrow()
        low.append((found.column("s").to_numpy(), found.column("n").to_numpy()))
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(x.num_rows for x in held) >= chunk:
                keys = batch.column(0).to_numpy()
                same = int(np.searchsorted(keys, held[-1].column(0)[-1].as_py(), "right"))
                if same < len(keys):
                    yield solve([*held, batch.slice(0, same)])
                    held, batch = [], batch.slice(same)
            held.append(batch)
        if held:
            yield solve(held)

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        s, n, seen = (np.concatenate([x.column(k).to_numpy() for x in parts]) for k in (1, 2, 3))
        own, levels = (s[n > 0], n[n > 0]), list(shared.value)
        for m in range(2, order + 1):
            levels.append(summed([(own[0] & ((1 << BITS * (m + 1)) - 1), own[1])]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (s, seen, Trie(levels).code_lengths(s))], ["s", "seen", "cost"])

    key = F.shiftright("s", BITS).bitwiseAND((1 << 2 * BITS) - 1).alias("key")
    dealt = counts.select(key, "s", "n", "seen").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(run), "s long, seen long, cost double")


class Frequent:
    """Code lengths of the strings of `found` that are seen most often, `nodes` at most; NaN for all others."""

    def __init__(self, found: DataFrame, nodes: int) -> None:
        # a row for each count below 2^16, and for each power of two from there on
        size = F.when(F.col("seen") < 1 << 16, F.col("seen")).otherwise(F.pow(F.lit(2), F.floor(F.log2("seen"))).cast("long"))
        least, held = 1, 0
        for n, strings_of in found.groupBy(size.alias("n")).count().orderBy(F.desc("n")).collect():
            held += strings_of
            if held > nodes:
                least = n + 1 if n < 1 << 16 else 2 * n
                break
        kept = found.filter(F.col("seen") >= least).select("s", "cost").toArrow()
        keys = kept.column("s").to_numpy()
        by = np.argsort(keys)
        self.keys, self.costs = keys[by], kept.column("cost").to_numpy()[by]

    def code_lengths(self, full: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(full), np.nan)
        at = np.minimum(np.searchsorted(self.keys, full), len(self.keys) - 1)
        return np.where(self.keys[at] == full, self.costs[at], np.nan)


class Scorer:
    """Code lengths of texts; what a string costs is worked out once and kept in a table of fixed size."""

    def __init__(self, trie: Trie | Frequent, order: int, slots: int = 20) -> None:
        self.trie, self.order, self.shift = trie, order, np.uint64(64 - slots)
        self.keys, self.costs = np.full(1 << slots, -1, np.int64), np.zeros(1 << slots)

    def each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all texts and what they cost."""
        full = strings(texts, self.order)
        slot = (full.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        costs, missing = self.costs[slot], self.keys[slot] != full
        if missing.any():
            new, at = np.unique(full[missing], return_inverse=True)
            found = self.trie.code_lengths(new)
            costs[missing] = found[at]
            to = (new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
            free = self.keys[to] == -1
            self.keys[to[free]], self.costs[to[free]] = new[free], found[free]  # of two for one slot the later stays, in both arrays
        return full, costs

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return np.add.reduceat(self.each(texts)[1], starts(texts))

    def known(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Code lengths of texts without the strings of no known cost, and these: (text, string, times)."""
        full, costs = self.each(texts)
        at, first = np.flatnonzero(np.isnan(costs)), starts(texts)
        costs[at] = 0
        text = np.searchsorted(first, at, "right") - 1
        by = np.lexsort((full[at], text))
        text, rest = text[by], full[at][by]
        heads = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (rest[1:] != rest[:-1])][: len(at)])
        return np.add.reduceat(costs, first), list(zip(text[heads].tolist(), rest[heads].tolist(), np.diff(np.r_[heads, len(at)]).tolist(), strict=True))


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c over all `texts` (one binary column), the end token with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().lower().split())
                seen[END_TOKEN] += 1
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, order: int = ORDER, nodes: int = NODES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    base = docs.select(F.col("doc_id").cast("long"), held_out(FOLDS, FOLD).alias("held_out"), text_bytes().alias("text"))
    learn = base.filter("not held_out").select("text")
    counts = stored(word_counts(learn), "words")
    tokens, kinds = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    context = docs.sparkSession.sparkContext
    common = counts.orderBy(F.desc("c"), "word").limit(frequent).toArrow()  # at most `frequent` rows
    known = context.broadcast(dict(zip(common.column("word").to_pylist(), common.column("c").to_pylist(), strict=True)))
    lengths = stored(costs(stored(string_counts(base.select("text", "held_out"), order), "strings"), order), "costs")
    often = context.broadcast(Frequent(lengths, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer, logs = Scorer(often.value, order), {w: log10(c + 1) for w, c in known.value.items()}
        row = TaskContext.get().partitionId() << 40
        names = ["row", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            low = 0
            for part in slices(batch.column(2).to_pylist()):
                out: list[tuple] = []
                ids, folds = batch.column(0).slice(low, len(part)).to_pylist(), batch.column(1).slice(low, len(part)).to_pylist()
                low += len(part)
                cost_of, rest = scorer.known(part)
                for k, s, times in rest:
                    out.append((row + k, b"  %d" % s, times, None, None, None, None, None, None))
                for text, doc_id, fold, cost in zip(part, ids, folds, cost_of.tolist(), strict=True):
                    words = Counter(text.lower().split())
                    words[END_TOKEN] += 1
                    own, total, found = 0.0, 0, 0
                    for word, times in words.items():
                        total += times
                        if (x := logs.get(word)) is not None:
                            own += times * x
                            found += times
                        else:
                            out.append((row, word, times, None, None, None, None, None, None))
                    # a row for the text, under a word that none has
                    out.append((row, b" %d" % row, None, doc_id, fold, total, found, own, cost))
                    row += 1
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = base.mapInArrow(lean(run), "row long, word binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    # strings under words that no text has
    told = counts.select("word", "c", F.lit(None).cast("double").alias("cost")).union(lengths.select(F.concat(F.lit("  "), F.col("s").cast("string")).cast("binary"), F.lit(None).cast("long"), "cost"))
    rare = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    each = rows.join(told, "word", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("logs") + F.coalesce(F.sum(rare), F.lit(0.0))).alias("logs"),
        (F.max("score") + F.coalesce(F.sum(F.col("times") * F.col("cost")), F.lit(0.0))).alias("score"),
    )
    size = log10(tokens + kinds + 1)
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * size).alias("base_score"), "score")
