"""Embedding near-duplicates: hierarchical navigable small-world (HNSW) graphs per shard, every shard queried.

Equal vectors are one class with a count, so copies cost nothing. Classes are dealt by hash into shards of about SHARD vectors; a
task builds each shard's graph (numpy, in batches: nodes of a batch search the graph so far and are linked to a diverse choice
of what they find, both ways). Then each shard's vectors, as one block, query every shard of their dimension: down the upper
layers, a beam over the bottom layer, and on from every near vector to all its near neighbours, however many there are. Each
pair of blocks audits its beam by PLANTED links of just the least cosine and by the true links of AUDIT queries, and doubles it until
RECALL is met; all links come from the graphs, and recalls, that of nearest vectors too, are logged. A task searches two shards both ways. What either way found is verified by cosine in double precision, counted for both ends,
and gives a spanning forest.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of different length. Rows
that repeat, ids included, are vectors of their own. Rows with a null id link with nothing. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forest, lean

LOG = logging.getLogger(__name__)
SHARD, LEAST_SHARDS = 16_384, 8
LINKS, MOST_LINKS, BEAM, BATCH = 16, 48, 32, 256
#: Queries and planted links of an audit; the recall of links that it asks for.
AUDIT, PLANTED, RECALL = 48, 128, 0.99


class Graph:
    """An HNSW graph over unit vectors (float32)."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, n = x, len(x)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # upper ones, top first: nodes, neighbours (as numbers in nodes)
        order = np.random.default_rng(11).permutation(n)
        size = n // 16
        while size >= 8:
            nodes = order[:size]
            self.layers.insert(0, (nodes, self.choose(x[nodes], np.arange(size), *self.nearest(x[nodes], x[nodes], np.arange(size)), LINKS)))
            size //= 16
        self.bottom = np.full((n, MOST_LINKS), -1, np.int32)
        self.degree = np.zeros(n, np.int64)
        self.present = np.zeros(n, bool)
        for low in range(0, n, BATCH):
            new = order[low : low + BATCH]
            near, sims = self.nearest(x[new], x[new], np.arange(len(new)))
            near = np.where(near >= 0, new[near], -1)
            if low:
                old, old_sims = self.beam(x[new], BEAM)[:2]
                near, sims = np.concatenate([near, old], axis=1), np.concatenate([sims, old_sims], axis=1)
                by = np.argsort(-sims, axis=1, kind="stable")
                near, sims = np.take_along_axis(near, by, 1), np.take_along_axis(sims, by, 1)
            self.link(new, self.choose(x, new, near, sims, LINKS))
            self.present[new] = True

    @staticmethod
    def nearest(x: np.ndarray, among: np.ndarray, own: np.ndarray, k: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of `among` for each row of x, without itself; -1 where there are fewer."""
        ids, sims = [], []
        for low in range(0, len(x), 512):
            s = x[low : low + 512] @ among.T
            s[np.arange(len(s)), own[low : low + 512]] = -2
            by = np.argsort(-s, axis=1)[:, :k]
            s = np.take_along_axis(s, by, 1)
            ids.append(np.where(s > -2, by, -1))
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    @staticmethod
    def choose(x: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` neighbours for each row, nearest first, skipping those nearer to a chosen one, then filled up."""
        n, width = near.shape
        out, filled = np.full((n, most), -1, np.int64), np.zeros(n, np.int64)
        cover = np.full((n, width), -3.0, np.float32)  # similarity of each candidate to the nearest chosen one
        rows = np.arange(n)
        left = (near >= 0) & (near != own[:, None])
        vectors = x[np.maximum(near, 0)]
        for diverse in (True, False):
            quota = 3 * most // 4 if diverse else most
            while True:
                good = left & (sims > cover) if diverse else left
                pick = good.argmax(axis=1)
                live = good[rows, pick] & (filled < quota)
                if not live.any():
                    break
                r, p = rows[live], pick[live]
                out[r, filled[r]] = near[r, p]
                filled[r] += 1
                left[r, p] = False
                left[r] &= near[r] != near[r, p][:, None]
                if diverse:
                    cover[r] = np.maximum(cover[r], np.einsum("rcd,rd->rc", vectors[r], vectors[r, p]))
        return out

    def link(self, nodes: np.ndarray, chosen: np.ndarray) -> None:
        a = np.repeat(nodes, chosen.shape[1])
        b = chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        pairs = np.unique(a.astype(np.int64) * len(self.x) + b)
        a, b = pairs // len(self.x), pairs % len(self.x)
        first = np.r_[True, a[1:] != a[:-1]]
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) + self.degree[a]
        full = place >= MOST_LINKS
        place[full] = (b[full] * 2654435761 + a[full]) % MOST_LINKS  # a full node trades some link for a new one
        self.bottom[a, place] = b
        np.add.at(self.degree, a[~full], 1)

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The `width` best nodes found for each query, their similarities, and which nodes were looked at."""
        start = np.zeros((len(q), 1), np.int64)
        for nodes, links in self.layers:  # each layer starts with the nodes of the one above, so numbers carry over
            start = np.maximum(self.walk(q, start, self.x[nodes], links, 8)[0][:, :4], 0)
        present = np.flatnonzero(self.present)[0]
        start = self.layers[-1][0][start] if self.layers else np.full_like(start, present)
        return self.walk(q, np.where(self.present[start], start, present), self.x, self.bottom, width)

    @staticmethod
    def walk(q: np.ndarray, start: np.ndarray, x: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, len(x)), bool)
        ids, sims, done = np.full((n, width), -1, np.int64), np.full((n, width), -2, np.float32), np.ones((n, width), bool)
        for k in range(min(start.shape[1], width)):
            new = ~seen[rows, start[:, k]]
            ids[new, k], done[new, k] = start[new, k], False
            sims[new, k] = np.einsum("qd,qd->q", q[new], x[start[new, k]])
            seen[rows, start[:, k]] = True
        while True:
            open_ = np.where(done, -3, sims)
            pick = open_.argmax(axis=1)
            live = np.flatnonzero(open_[rows, pick] > -3)
            if not len(live):
                return ids, sims, seen
            done[live, pick[live]] = True
            near = links[ids[live, pick[live]]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            found = np.full(near.shape, -2, np.float32)
            found[r, c] = np.einsum("pd,pd->p", q[live[r]], x[near[r, c]])
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], found], axis=1)
            all_done = np.concatenate([done[live], found <= -2], axis=1)
            by = np.argsort(-all_sims, axis=1)[:, :width]
            ids[live], sims[live], done[live] = (np.take_along_axis(v, by, 1) for v in (all_ids, all_sims, all_done))

    def near(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a similarity of `least` or more that a beam of `width` leads to."""
        if width >= len(self.x):
            return np.nonzero(q @ self.x.T >= least)
        ids, sims, _ = self.beam(q, width)
        r, c = np.nonzero(sims >= least)
        new = np.unique(r * len(self.x) + ids[r, c])
        seen, out = np.zeros(len(q) * len(self.x), bool), [new]
        seen[new] = True
        while len(new):  # on from every near node to its near neighbours
            r, node = new // len(self.x), new % len(self.x)
            at = self.bottom[node].astype(np.int64)
            to = np.where(at >= 0, r[:, None] * len(self.x) + at, -1).ravel()
            to = np.unique(to[to >= 0])
            to = to[~seen[to]]
            seen[to] = True
            r, node = to // len(self.x), to % len(self.x)
            good = np.empty(len(to), bool)
            for low in range(0, len(to), 1 << 15):
                part = slice(low, low + (1 << 15))
                good[part] = np.einsum("pd,pd->p", q[r[part]], self.x[node[part]]) >= least
            new = to[good]
            out.append(new)
        found = np.concatenate(out)
        return found // len(self.x), found % len(self.x)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """rep (smallest id), n and embedding (doubles) of each distinct usable vector."""
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    usable = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), doubles.alias("embedding"))
    usable = usable.filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0))
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


class Audit:
    """What a beam has to find. Links may be rare, so links are planted: vectors of the graph, turned away to just the least cosine.

    Besides, a sample of the block's queries has its true links and its nearest vectors from brute force.
    """

    def __init__(self, block: np.ndarray, graph: Graph, same: bool, least: float) -> None:
        r = np.random.default_rng(5)
        self.graph, self.least = graph, least - 1e-5
        self.at = r.permutation(len(graph.x))[:PLANTED]
        own = graph.x[self.at]
        away = r.normal(size=own.shape).astype(np.float32)
        away -= np.einsum("pd,pd->p", away, own)[:, None] * own
        size = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.where(size > 1e-6, away / np.maximum(size, 1e-6), 0)  # in one dimension there is no way to turn
        self.planted = np.where(size > 1e-6, least * own + np.float32((1 - least**2) ** 0.5) * away, own).astype(np.float32)
        sample = r.permutation(len(block))[:AUDIT]
        self.queries = block[sample]
        s = self.queries @ graph.x.T
        if same:
            s[np.arange(len(s)), sample] = -2
        q, c = np.nonzero(s >= self.least)
        self.links, self.nearest = q * len(graph.x) + c, s.argmax(axis=1)

    def _held(self, queries: np.ndarray, want: np.ndarray, width: int) -> float:
        r, c = self.graph.near(queries, self.least, width)
        return float(np.isin(want, r * len(self.graph.x) + c).mean()) if len(want) else 1.0

    def recall(self, width: int) -> float:
        """The share of links that a beam of `width` finds: of planted ones or of true ones, whichever is less."""
        planted = np.arange(len(self.at)) * len(self.graph.x) + self.at
        return min(self._held(self.planted, planted, width), self._held(self.queries, self.links, width))

    def near_recall(self, width: int) -> float:
        """The share of nearest vectors that such a beam finds."""
        if width >= len(self.graph.x):
            return 1.0
        return float((self.graph.beam(self.queries, width)[0] == self.nearest[:, None]).any(axis=1).mean())


def search(x: np.ndarray, block: np.ndarray, graph: Graph, y: np.ndarray, same: bool, least: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray, tuple[int, float, float]]:
    """(row of x, row of y) with a cosine of `least` or more in double precision, and the beam with its recall of nearest vectors and of links.

    `block` and the graph hold the unit vectors. Brute force sees the audit's sample only; links come from the graph, whose beam is
    doubled until the audit passes. A beam as wide as the graph sees all of it.
    """
    audit = Audit(block, graph, same, least)
    while (linked := audit.recall(beam)) < recall:
        beam *= 2
    parts = [(low, *graph.near(block[low : low + BATCH], least - 1e-5, beam)) for low in range(0, len(block), BATCH)]
    r, c = verified(x, y, np.concatenate([low + r for low, r, _ in parts]), np.concatenate([c for _, _, c in parts]), least)
    return r, c, (beam, audit.near_recall(beam), linked)


def verified(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    exact = np.concatenate([np.einsum("pd,pd->p", x[r[k : k + (1 << 15)]], y[c[k : k + (1 << 15)]]) for k in range(0, max(1, len(r)), 1 << 15)])
    return r[exact >= least], c[exact >= least]


def both_ways(x: np.ndarray, one: Graph, y: np.ndarray, two: Graph, same: bool, least: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float, float]]]:
    """Distinct links (row of x, row of y) that a search from either side finds, and the searches' beams and recalls; within one shard each link stands both ways."""
    r, c, told = search(x, one.x, two, y, same, least, beam, recall)
    more, back, also = (r, c, told) if same else search(y, two.x, one, x, same, least, beam, recall)
    found = np.unique(np.concatenate([r * len(y) + c, back * len(y) + more]))
    r, c = found // len(y), found % len(y)
    return *((r[r != c], c[r != c]) if same else (r, c)), [told] if same else [told, also]


def found_links(held: DataFrame, least: float, shard: int, beam: int, recall: float) -> DataFrame:
    """Rows (a, b, n): links of a forest, with b null the number of vectors that a's class links to in a shard; with a null a search's beam (n) and recalls (nearest, linked)."""
    total = held.count()
    shards = max(LEAST_SHARDS, -(-total // shard))
    dealt = held.withColumn("d", F.size("embedding")).withColumn("shard", F.col("d") * F.lit(shards).cast("long") + F.pmod(F.xxhash64("rep"), F.lit(shards)))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        graph = Graph(unit(x).astype(np.float32))
        uppers = [v for nodes, links in graph.layers for v in (nodes.astype(np.int32).tobytes(), links.astype(np.int32).tobytes())]
        row = {"shard": [group.column("shard")[0].as_py()], "d": [x.shape[1]], "ids": [group.column("rep").to_numpy().tobytes()], "counts": [group.column("n").to_numpy().tobytes()], "x": [x.tobytes()], "bottom": [graph.bottom.tobytes()], "uppers": [uppers]}
        return pa.table(row, schema=pa.schema({"shard": pa.int64(), "d": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "x": pa.binary(), "bottom": pa.binary(), "uppers": pa.list_(pa.binary())}))

    graphs = checkpoint(dealt.groupBy("shard").applyInArrow(build, "shard long, d int, ids binary, counts binary, x binary, bottom binary, uppers array<binary>"))
    last = (F.col("d") + 1) * F.lit(shards).cast("long") - 1
    asking = graphs.select(*(F.col(n).alias(f"q_{n}") for n in graphs.columns), F.explode(F.sequence("shard", last)).alias("shard"))

    def held_graph(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        ids, counts = (np.frombuffer(row[prefix + n], np.int64) for n in ("ids", "counts"))
        x, graph = unit(np.frombuffer(row[prefix + "x"]).reshape(-1, row["d"])), Graph.__new__(Graph)
        graph.x, graph.bottom, graph.present = x.astype(np.float32), np.frombuffer(row[prefix + "bottom"], np.int32).reshape(len(x), -1), np.ones(len(x), bool)
        u = [np.frombuffer(v, np.int32) for v in row[prefix + "uppers"]]
        graph.layers = [(nodes.astype(np.int64), links.reshape(len(nodes), -1)) for nodes, links in zip(u[::2], u[1::2], strict=True)]
        return ids, counts, x, graph

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                (ids, counts, x, one), (others, more, y, two) = (held_graph(row, prefix) for prefix in ("q_", ""))
                same = row["q_shard"] == row["shard"]
                r, c, told = both_ways(x, one, y, two, same, least, beam, recall)
                ends = [(ids, np.bincount(r, more[c], len(ids)))] + ([] if same else [(others, np.bincount(c, counts[r], len(others)))])
                some = np.concatenate([i[n > 0] for i, n in ends])
                n = np.concatenate([n[n > 0] for _, n in ends]).astype(np.int64)
                a, b = forest(ids[r], others[c])
                nones = lambda k: [None] * k
                yield pa.RecordBatch.from_arrays([
                    pa.array([*some.tolist(), *a.tolist(), *nones(len(told))], pa.int64()), pa.array([*nones(len(some)), *b.tolist(), *nones(len(told))], pa.int64()),
                    pa.array([*n.tolist(), *nones(len(a)), *(w for w, _, _ in told)], pa.int64()), *(pa.array([*nones(len(some) + len(a)), *(t[k] for t in told)], pa.float64()) for k in (1, 2)),
                ], ["a", "b", "n", "nearest", "linked"])

    pairs = asking.repartition("q_shard", "shard").join(graphs, "shard")
    return checkpoint(pairs.mapInArrow(lean(ask), "a long, b long, n long, nearest double, linked double"))


def near_duplicates(vectors: DataFrame, least: float = 0.9, shard: int = SHARD, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    held = checkpoint(classes(vectors))
    found = found_links(held, least, shard, beam, recall)
    told = found.filter("a is null").agg(F.count("*"), F.min("nearest"), F.avg("nearest"), F.min("linked"), F.max("n")).first()
    LOG.info("%s searches of graphs: recall of nearest vectors %s at least, %s on average, of links %s at least; widest beam %s", *told)
    links = found.filter("a is not null and b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    parts = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = held.join(links, "rep", "left").join(parts, "rep", "left").select("embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), doubles.alias("embedding"))
    known = rows.filter("vec_id is not null").join(checkpoint(named), "embedding").select("vec_id", "n_links", "component_id")
    usable = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
