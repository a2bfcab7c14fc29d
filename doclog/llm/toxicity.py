"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

A linear numpy classifier over the words of whole texts is fitted from confirmed toxic documents (P) and documents of unknown
label (U, toxic ones among them). Its risk is  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with the logistic loss; pi is the
share of toxic documents among the labelled rows that may be learned from. Negative labels serve for pi alone.

Bounds of the fit: about P_ROWS and U_ROWS documents (chosen by a hash of doc_id, all of them where there are fewer) and the
WORDS words that tell P from U best. Every document is scored over its whole text.

Null and empty texts get the score of a text without any known word. Without a toxic or an unlabelled document to learn from
every score is 0. Null doc_ids are scored, never learned from, and count as held out. Rows repeat as given; other columns are
ignored. Of several labels of a document, null ones apart, the highest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean

P_ROWS, U_ROWS, WORDS = 4_000, 8_000, 2_000
STEM = 4
FOLDS, HELD_OUT = 5, (0,)
WORD = re.compile(r"\w+")


def held_out(folds: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))


def by_hash(rows: int, of: int):
    """About `rows` of `of` documents, the same ones whatever the partitions."""
    share = 1.0 if of <= rows else rows / of
    return F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))


def words_of(text: str | None) -> set[str]:
    """The lower-cased words of a text, and the stem (STEM letters and a dash) of each longer one, for inflected forms."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM}


def sample(docs: DataFrame, labels: DataFrame, p_rows: int = P_ROWS, u_rows: int = U_ROWS) -> tuple[DataFrame, float]:
    """(p, words) of the documents to learn from, and the class prior. Both id lists are bounded, so they are broadcast."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(FOLDS, HELD_OUT[0])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return docs.sparkSession.createDataFrame([], "p boolean, words array<string>"), 0.0
    positive = known.filter((F.col("toxic") == 1) & by_hash(p_rows, toxic)).select("doc_id", F.lit(True).alias("p"))
    learn = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null").filter(~held_out(FOLDS, HELD_OUT[0]))
    unlabelled = learn.filter(by_hash(u_rows, learn.count())).withColumn("p", F.lit(False))
    rows = learn.join(F.broadcast(positive), "doc_id").select("p", "text").union(unlabelled.select("p", "text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(words_of(t)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], ["p", "words"])

    return checkpoint(rows.mapInArrow(lean(split), "p boolean, words array<string>")), toxic / n


def telling_words(rows: DataFrame, most: int = WORDS) -> list[str]:
    """The words whose share of the toxic documents exceeds their share of the others most clearly, by a normal test at least."""
    n_p, n_u = rows.agg(F.count_if("p"), F.count_if(~F.col("p"))).first()
    if not n_p or not n_u:
        return []
    each = rows.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("p").alias("a"), F.count_if(~F.col("p")).alias("b"))
    p, u = (F.col("a") + 0.5) / (n_p + 1), (F.col("b") + 0.5) / (n_u + 1)
    gain = F.col("a") * F.log(p / u)
    clear = (F.col("a") >= max(3, n_p // 250)) & (p > 1.5 * u) & (p - u > 4 * F.sqrt(u / n_p))
    return [r.word for r in each.filter(clear).orderBy(gain.desc(), "word").limit(most).collect()]


def fit(p: list[np.ndarray], u: list[np.ndarray], size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of `size` words and a bias by full-batch Adam on the non-negative risk; rows are arrays of word numbers."""

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.empty(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (ip, rp), (iu, ru) = flat(p), flat(u)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp = np.bincount(rp, w[ip], len(p)) + w[size]
        zu = np.bincount(ru, w[iu], len(u)) + w[size]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sigmoid(zp) - 1) / len(p), np.zeros(len(u))
        sign = 1.0 if negative >= 0 else 0.0  # below zero the estimate only overfits: leave that part out
        gp -= sign * prior * sigmoid(zp) / len(p)
        gu += sign * sigmoid(zu) / len(u)
        g = np.bincount(ip, gp[rp], size + 1) + np.bincount(iu, gu[ru], size + 1) + decay * w
        g[size] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, p_rows: int = P_ROWS, u_rows: int = U_ROWS) -> tuple[dict[str, float], float] | None:
    """Weight of each telling word and the bias."""
    rows, prior = sample(docs, labels, p_rows, u_rows)
    words = telling_words(rows)
    if not words:
        return None
    at = {w: k for k, w in enumerate(words)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[at[w] for w in row if w in at] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["p", "at"])

    table = rows.mapInArrow(lean(numbers), "p boolean, at array<int>").toArrow()  # bounded by p_rows, u_rows and WORDS
    flags = table.column("p").to_numpy()
    found = [np.asarray(x.values.to_numpy(), np.int64) for x in table.column("at")]
    w = fit([x for x, f in zip(found, flags, strict=True) if f], [x for x, f in zip(found, flags, strict=True) if not f], len(words), prior)
    return dict(zip(words, w.tolist(), strict=False)), float(w[-1])


def scored(model: tuple[dict[str, float], float] | None, text: str = "text") -> Column:
    """The score (0 to 1) of a whole text, as a column: of a row only its text goes to Python, and only the score comes back."""
    if model is None:
        return F.lit(0.0)
    weights, bias = model

    @F.arrow_udf("double")
    @lean
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            z = np.array([bias + sum(sorted(weights[w] for w in words_of(t.as_py()) & weights.keys())) for t in texts])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return run(text)


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None) -> DataFrame:
    """`docs` with a column toxicity (0 to 1), in place of one of that name; other columns pass through."""
    return docs.withColumn("toxicity", scored(model))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT[0]).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
