"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Every unit (a frequent token, or else the token's shape) has a sparse random index vector, drawn from its hash. A unit's word
vector is the sum of its neighbours' index vectors within WINDOW tokens, gathered by Spark over the sampled texts, then scaled
to length one. A document's input is the count-weighted mean and spread of its tokens' vectors, and four plain figures of its
token counts (length, share of distinct tokens, share of the most frequent token, mean token length).

Bound of the fit, vectors included: about ROWS labelled documents outside the held-out fold, chosen by a hash of doc_id, and
UNITS units. Every document is scored over its whole text.

Null and empty texts are scored as texts without tokens. Without labels of both kinds every score is the share of good labels
(0.5 without any). Null doc_ids are scored, never learned from, and count as held out. Rows repeat as given; other columns are
ignored. Of several labels of a document, null ones apart, the lowest counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean
from .toxicity import by_hash, held_out

ROWS, UNITS, SIZE, WINDOW, HIDDEN = 6_000, 4_000, 64, 2, 32
FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    """What stands for a token that is no unit of its own: letter case or kind, and length up to 12."""
    kind = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "9" if token.isdigit() else "%" if not token[0].isalnum() else "aA"
    return f"\t{kind}{min(len(token), 12)}"


def index_vector(unit: str, size: int = SIZE) -> np.ndarray:
    """Eight entries of +1 or -1, by the unit's hash."""
    out, seed = np.zeros(size), zlib.crc32(unit.encode())
    for k in range(8):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        out[(seed >> 33) % size] += 1 - 2 * (k & 1)
    return out


class Pooler:
    """Inputs of the network for texts."""

    def __init__(self, units: list[str], vectors: np.ndarray) -> None:
        self.at = {u: k for k, u in enumerate(units)}
        self.vectors = np.vstack([vectors, np.zeros(vectors.shape[1])])
        self.squares = self.vectors**2
        self.shapes: dict[str, int] = {}

    def place(self, token: str) -> int:
        found = self.at.get(token)
        return self.at.get(shape(token), len(self.at)) if found is None else found

    def pool(self, text: str | None) -> np.ndarray:
        counts = Counter(TOKEN.findall(text)) if text else Counter()
        if not counts:
            return np.zeros(2 * self.vectors.shape[1] + 4)
        many = np.fromiter(counts.values(), float, len(counts))
        weights = np.bincount(np.fromiter(map(self.place, counts), np.int64, len(counts)), many, len(self.vectors))
        used, n = np.flatnonzero(weights), many.sum()
        share = weights[used] / n
        mean = share @ self.vectors[used]
        spread = np.sqrt(np.maximum(0, share @ self.squares[used] - mean**2))
        plain = [np.log1p(n) / 10, len(many) / n, many.max() / n, float(np.dot(many, np.fromiter(map(len, counts), float, len(many))) / n / 10)]
        return np.concatenate([mean, spread, plain])


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """good and tokens of the documents to learn from; the id list is bounded, so it is broadcast."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(FOLDS, FOLD)).groupBy("doc_id").agg(F.min("quality").alias("good"))
    chosen = known.filter(by_hash(rows, known.count())).withColumn("doc_id", F.col("doc_id").cast("long"))
    return checkpoint(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("good", F.coalesce("text", F.lit("")).alias("text")))


def word_vectors(texts: DataFrame, units: int = UNITS, size: int = SIZE, window: int = WINDOW) -> tuple[list[str], np.ndarray]:
    """Units (tokens in at least five of the texts, the most frequent first, and shapes) and their vectors."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(set(TOKEN.findall(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counts = texts.select("text").mapInArrow(lean(tokens), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    names = [r.token for r in counts.filter("n >= 5").orderBy(F.desc("n"), "token").limit(units).collect()]
    names += sorted(f"\t{kind}{n}" for kind in ("a", "A", "Aa", "9", "%", "aA") for n in range(1, 13))
    at = {u: k for k, u in enumerate(names)}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = np.array([index_vector(u, size) for u in names]), np.zeros((len(names), size))
        for batch in batches:
            for text in batch.column(0):
                stream = np.array([k if (k := at.get(t)) is not None else at[shape(t)] for t in TOKEN.findall(text.as_py())], np.int64)
                for gap in range(1, window + 1):
                    pairs, n = np.unique(stream[:-gap] * len(names) + stream[gap:], return_counts=True)
                    a, b = pairs // len(names), pairs % len(names)
                    np.add.at(total, a, n[:, None] * index[b])
                    np.add.at(total, b, n[:, None] * index[a])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], ["unit", "v"])

    parts = texts.select("text").mapInArrow(lean(neighbours), "unit long, v array<double>")
    sums = parts.groupBy("unit").agg(*(F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(size))).collect()  # bounded by units
    vectors = np.zeros((len(names), size))
    for row in sums:
        vectors[row[0]] = row[1:]
    return names, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class Network:
    """Two layers, standardised inputs, logistic output, one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 600, rate: float = 0.01, decay: float = 1e-4) -> None:
        random = np.random.default_rng(7)
        fit = np.arange(len(y)) % 5 != 4
        if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
            fit[:] = True
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        d = x.shape[1]
        p = [random.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), random.normal(0, np.sqrt(2 / hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        z, t = self.scaled(x[fit]), y[fit]
        for step in range(1, steps + 1):
            at = random.integers(0, len(t), min(512, len(t)))
            h = np.maximum(0, z[at] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - t[at]) / len(at)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [z[at].T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        held = ~fit if (~fit).any() else fit
        logits, t = self.logits(x[held]), y[held]
        loss = lambda k: np.mean(np.logaddexp(0, logits / k) - t * logits / k)
        self.temperature = min(np.geomspace(0.25, 10, 60), key=loss)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, o, c = self.layers
        return np.maximum(0, self.scaled(x) @ w + b) @ o + c[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[Pooler, Network] | float:
    """What score() needs; a plain number where there are no labels of both kinds."""
    chosen = sample(docs, labels, rows)
    n, good = chosen.agg(F.count("*"), F.sum("good")).first()
    if not n or not 0 < good < n:
        return good / n if n else 0.5
    pooler = Pooler(*word_vectors(chosen))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pooler.pool(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["good", "x"])

    found = chosen.select(F.col("good").cast("int"), "text").mapInArrow(lean(pool), "good int, x array<double>").toArrow()  # bounded by rows
    order = sorted(range(found.num_rows), key=lambda k: zlib.crc32(repr(found.column("x")[k].as_py()[:8]).encode()))
    x, y = np.array(found.column("x").to_pylist()), np.array(found.column("good").to_pylist(), float)
    return pooler, Network(x[order], y[order])


def scored(model: tuple[Pooler, Network] | float, text: str = "text") -> Column:
    """The score (0 to 1) of a whole text, as a column: of a row only its text goes to Python, and only the score comes back."""
    if isinstance(model, float):
        return F.lit(model)
    pooler, network = model

    @F.arrow_udf("double")
    @lean
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [network(np.array([pooler.pool(t.as_py()) for t in texts.slice(low, 512)])) for low in range(0, len(texts), 512)]
            yield pa.array(np.concatenate([np.empty(0), *found]))

    return run(text)


def score(docs: DataFrame, model: tuple[Pooler, Network] | float) -> DataFrame:
    """`docs` with a column quality_score (0 to 1), in place of one of that name; other columns pass through."""
    return docs.withColumn("quality_score", scored(model))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
