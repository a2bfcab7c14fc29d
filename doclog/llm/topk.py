"""Exact top-k by inner product over quantised vectors: exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks by id. Every (query block, candidate block) pair is one task group: for each term
(component) the candidates' postings are scattered, weighted by the queries' values, into dense score arrays; each query keeps
the k best of the block by partition selection, and the blocks' winners are merged per query.

Vectors that are null or hold null, NaN or infinite components take no part. Vectors of different length are compared over
the components that both have. A query is never its own candidate (by id); ties go to
the smaller id. Equal rows count once; an id with several vectors asks with all of them. Rows with a null id are left out: they can neither be asked for nor named. Scores past 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Queries and candidates whose scores are accumulated together: a tile that stays in a core's cache.
TILE = (64, 4096)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of each usable vector, as longs."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.filter("vec_id is not null and embedding is not null").filter(finite)
    return usable.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("terms")).distinct()


def postings(lists: pa.ChunkedArray) -> tuple[int, list[tuple[np.ndarray | None, np.ndarray]]]:
    """Rows, and for each term the rows that hold it with their weights; None where most do: then there is a weight for each row."""
    flat = lists.combine_chunks()
    counts = flat.value_lengths().to_numpy(zero_copy_only=False)
    values, rows = flat.flatten().to_numpy(), np.repeat(np.arange(len(counts)), counts)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(terms, kind="stable")
    cuts = np.searchsorted(terms[order], np.arange(1, counts.max(initial=0)))
    out = []
    for part in np.split(order, cuts) if len(values) else []:
        part = part[values[part] != 0]
        if 2 * len(part) > len(counts):
            whole = np.zeros(len(counts), values.dtype)
            whole[rows[part]] = values[part]
            out.append((None, whole))
        else:
            out.append((rows[part], values[part]))
    return len(counts), out


Held = tuple[int, list[tuple[np.ndarray | None, np.ndarray]]]


def score_kind(asked: Held, held: Held) -> type:
    """The type that holds every score."""
    most = [max((float(np.abs(w).max()) for _, w in terms if len(w)), default=0.0) for _, terms in (asked, held)]
    top = most[0] * most[1] * max(1, len(held[1]))
    if top >= 2.0**63:
        raise OverflowError("scores do not fit 64 bits")
    return np.int32 if top < 2.0**31 else np.int64


def accumulate(asked: Held, held: Held, kind: type) -> np.ndarray:
    """Scores [query, candidate], term at a time; terms that a query lacks cost nothing."""
    (n, asked_terms), (m, held_terms) = asked, held
    scores, step = np.zeros((n, m), kind), np.empty((n, m), kind)
    for (rows, weights), (at, values) in zip(asked_terms, held_terms, strict=False):
        if not len(weights) or not len(values):
            continue
        weights, values = weights.astype(kind)[:, None], values.astype(kind)
        if rows is None and at is None:
            np.multiply(weights, values, out=step)
            scores += step
        elif at is None:
            scores[rows] += weights * values
        elif rows is None:
            scores[:, at] += weights * values
        else:
            scores[np.ix_(rows, at)] += weights * values
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores among other ids, ties to the smaller id."""
    other = ids[None, :] != own[:, None]
    if scores.shape[1] > k:
        line = np.where(other, scores, np.iinfo(scores.dtype).min)
        edge = np.partition(line, line.shape[1] - k, axis=1)[:, line.shape[1] - k]
        other &= line >= edge[:, None]
    rows, columns = np.nonzero(other)
    order = np.lexsort((ids[columns], -scores[rows, columns].astype(np.int64), rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as quantised() gives them."""
    blocks = lambda df, size: max(1, -(-df.count() // size))
    asked, held = blocks(queries, QUERY_BLOCK), blocks(candidates, CANDIDATE_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", block(asked)).withColumn("c", each(held))
    right = candidates.withColumn("c", block(held)).withColumn("q", each(asked))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, held_ids = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        high, wide = TILE
        held_tiles = [postings(c.column("terms").slice(at, wide)) for at in range(0, len(held_ids), wide)]
        found: list[list[np.ndarray]] = [[], [], []]
        for low in range(0, len(ids) if len(held_ids) else 0, high):
            tile = postings(q.column("terms").slice(low, high))
            kind = max((score_kind(tile, x) for x in held_tiles), key=lambda x: np.dtype(x).itemsize)
            scores = np.concatenate([accumulate(tile, x, kind) for x in held_tiles], axis=1)
            rows, columns = best(scores, held_ids, ids[low : low + high], k)
            for to, x in zip(found, (ids[low + rows], held_ids[columns], scores[rows, columns].astype(np.int64)), strict=True):
                to.append(x)
        return pa.table({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
