"""SentencePiece encoding and decoding of whole texts by suffix-array matching, for BPE models with byte fallback.

No piece holds a space mark after another character, so texts part into chunks before each run of marks, and equal chunks of a
batch are encoded once. The distinct chunks are concatenated and their suffixes sorted; every piece finds its range of
occurrences by binary search; the occurrences are edges, sorted by end, and relaxed from left to right: of the edges that end at
a place the one is kept that may follow the last piece kept at its start. Two pieces may follow each other if merging their
joined text gives the same two; that is told from their own merges (the published pair test for BPE), so each place has
one such edge. Chunks of equal place are relaxed side by side; what is left of a chunk after STEPS places is relaxed by itself, from
the same edges and by the same test, so a chunk may have any length. Chunks where a place has no edge or several are left to the
sentencepiece library, so ids are always the model's.

Decoding gives the text back, but for mark characters in it, which become spaces, as in the library.

Null texts are empty (no ids). Null doc_ids, repeated rows and ids are kept as they are. Other columns are ignored. A text is a
string of one row however long; batches are cut by their characters, so only one very long text is held at a time.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, lean
from .packing import groups

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Places of chunks that are relaxed side by side, and how many chunks a worker remembers.
STEPS, REMEMBERED = 64, 250_000
#: Stands between chunks in the text that is indexed; no character.
BREAK = (1 << 21) - 2
#: Characters of new chunks that are indexed at once.
LEARNED = 1 << 18


class Matcher:
    """Encoder and decoder of one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.normal = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)) for i in range(n)]
        self.bytes_of = {i: int(names[i][1:-1], 16) for i in range(n) if self.model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.names = names
        ids = {names[i]: i for i in range(n) if self.normal[i]}
        assert not any(MARK in p.lstrip(MARK) for p in ids), "a piece holds a mark after another character"
        scores = np.array([self.model.get_score(i) for i in range(n)])
        by_score = np.empty(n, np.int64)
        by_score[np.argsort(-scores, kind="stable")] = np.arange(n)
        rank = np.r_[by_score, -1]
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        for p, i in ids.items():
            if len(p) > 1:  # the last merge of the piece's own text
                parts = [ids.get(c, n) for c in p]
                while len(parts) > 2:
                    found = [(rank[pairs[a, b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in pairs]
                    if not found:
                        break
                    k = min(found)[1]
                    parts[k : k + 2] = [pairs[parts[k], parts[k + 1]]]
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
        rank[:n][self.left[:n] < 0] = -1  # characters are there from the start
        self.size, self.rank = n, rank
        keys = np.array(sorted(a * (n + 1) + b for a, b in pairs), np.int64)
        self.pair_keys = keys
        self.pair_rank = by_score[[pairs[divmod(int(k), n + 1)] for k in keys]]
        listed = [(p, i) for p, i in ids.items()]
        self.piece_ids = np.array([i for _, i in listed], np.int64)
        self.lengths = np.array([len(p) for p, _ in listed], np.int64)
        self.longest = int(self.lengths.max())
        self.letters = np.zeros((len(listed), -(-self.longest // 3) * 3), np.uint64)
        for k, (p, _) in enumerate(listed):
            self.letters[k, : len(p)] = [ord(c) for c in p]
        self.known: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}
        self.texts = [bytes([self.bytes_of[i]]) if i in self.bytes_of else names[i].replace(MARK, " ").encode() if self.normal[i] else b"" for i in range(n)]

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], 1 << 40)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of each pair of pieces gives the pair again; `size` stands for an unknown character."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(live):
            bad = self.merge_rank(a, b) < limit
            ok[live[bad]] = False
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            first = self.rank[a] > self.rank[b]  # undo the later merge
            limit = np.where(first, self.rank[a], self.rank[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece number) of every occurrence of every piece."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(3 * self.letters.shape[1], np.uint64)])
        triples = (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]
        rank, order, depth = None, np.argsort(triples[:n], kind="stable"), 3
        while True:  # doubled prefixes, until as long as the longest piece
            if rank is None:
                s = triples[order]
                new = np.r_[True, s[1:] != s[:-1]]
            else:
                key = (rank[:n] << 32) + rank[np.minimum(np.arange(n) + depth, n)] + 1
                order = np.argsort(key, kind="stable")
                new = np.r_[True, key[order][1:] != key[order][:-1]]
                depth *= 2
            rank = np.full(n + 1, -1, np.int64)
            rank[order] = np.cumsum(new) - 1
            if depth >= self.longest or new.all():
                break
        low, high = np.zeros(len(self.letters), np.int64), np.full(len(self.letters), n)
        for k in range(0, self.letters.shape[1], 3):
            live = np.flatnonzero((self.lengths > k) & (low < high))
            part = self.letters[live, k : k + 3]
            most = np.where(np.arange(k, k + 3)[None, :] < self.lengths[live, None], part, np.uint64((1 << 21) - 1))
            least, most = ((x[:, 0] << np.uint64(42)) | (x[:, 1] << np.uint64(21)) | x[:, 2] for x in (part, most))
            bounds = []
            for want, strict in ((least, False), (most, True)):
                a, b = low[live].copy(), high[live].copy()
                while (a < b).any():
                    mid = (a + b) // 2
                    have = triples[order[np.minimum(mid, n - 1)] + k]
                    up = (a < b) & ((have <= want) if strict else (have < want))
                    a, b = np.where(up, mid + 1, a), np.where(up | (a >= b), b, mid)
                bounds.append(a)
            low[live], high[live] = bounds
        counts = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(counts)), counts)
        place = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return order[place], piece

    def relax_alone(self, begin: int, stop: int, starts: list[int], ends: list[int], ids: list[int], last: np.ndarray, back: np.ndarray) -> bool:
        """Relax the edges (sorted by end) of one chunk; False where a place has several."""
        base, follows = self.size + 1, self.follows
        at, came = last[begin : stop + 1].tolist(), back[begin : stop + 1].tolist()
        sure, done = True, -1
        for start, end, piece in zip(starts, ends, ids, strict=True):
            if start > begin:
                before = at[start - begin]
                if before < 0:
                    continue
                key = before * base + piece
                ok = follows.get(key)
                if ok is None:
                    ok = follows[key] = bool(self.may_follow(np.array([before]), np.array([piece]))[0])
                if not ok:
                    continue
            sure &= end != done
            done = end
            at[end - begin], came[end - begin] = piece, start
        last[begin : stop + 1], back[begin : stop + 1] = at, came
        return sure

    def learn(self, chunks: list[str]) -> None:
        """Encode distinct chunks and remember them."""
        sizes = np.array([len(c) + 1 for c in chunks])
        text = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes) - 1
        text[ends] = BREAK
        begins = ends + 1 - sizes
        owner = np.repeat(np.arange(len(chunks)), sizes)
        start, piece = self.edges(text)
        end, ids = start + self.lengths[piece], self.piece_ids[piece]
        single = np.ones(len(text), bool)  # characters that are no piece stand for themselves
        single[ends] = False
        single[start[self.lengths[piece] == 1]] = False
        lone = np.flatnonzero(single)
        start, end, ids = np.r_[start, lone], np.r_[end, lone + 1], np.r_[ids, np.full(len(lone), self.size)]
        level = end - begins[owner[start]]
        by = np.argsort(np.minimum(level, STEPS + 1).astype(np.int16), kind="stable")
        cuts = np.searchsorted(level[by[: int((level <= STEPS).sum())]], np.arange(1, STEPS + 2))
        last, back, sure = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1), np.ones(len(chunks), bool)
        for low, high in zip(cuts[:-1], cuts[1:]):
            e = by[low:high]
            if not len(e):
                continue
            first = start[e] == begins[owner[start[e]]]
            e = e[first | (last[start[e]] >= 0)]
            first = start[e] == begins[owner[start[e]]]
            ok = first.copy()
            if (~first).any():
                a, b = last[start[e[~first]]], ids[e[~first]]
                key, at = np.unique(a * (self.size + 1) + b, return_inverse=True)
                ok[~first] = self.may_follow(key // (self.size + 1), key % (self.size + 1))[at]
            e = e[ok]
            spots, times = np.unique(end[e], return_counts=True)
            sure[owner[spots[times > 1] - 1]] = False
            last[end[e]], back[end[e]] = ids[e], start[e]
        late = by[cuts[-1] :]
        if len(late):
            late = late[np.argsort(end[late], kind="stable")]
            mine = owner[start[late]]
            edges = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1], True])
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                e, k = late[low:high], int(mine[low])
                sure[k] &= self.relax_alone(int(begins[k]), int(ends[k]), start[e].tolist(), end[e].tolist(), ids[e].tolist(), last, back)
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
        at, rows, found = ends.copy(), np.arange(len(chunks)), []
        sure &= last[ends] >= 0
        rows = rows[sure]
        while len(rows):
            if len(rows) < 16:  # a few long chunks: plain steps cost less than arrays
                for k in rows.tolist():
                    path, place, begin = [], int(at[k]), int(begins[k])
                    while place > begin:
                        path.append(place)
                        place = int(back[place])
                    found.append((np.full(len(path), k), last[path], np.array(path, np.int64)))
                break
            found.append((rows, last[at[rows]], at[rows]))
            at[rows] = back[at[rows]]
            rows = rows[at[rows] > begins[rows]]
        if found:
            r, t, where = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((where, r))
            r, t, where = r[by], t[by], where[by]
            heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            plain = t.astype("<u4").tobytes()
            odd = set(r[t == self.size].tolist())
            for k, (i, j) in zip(r[heads].tolist(), zip(heads.tolist(), [*heads[1:].tolist(), len(r)])):
                if k in odd:
                    ids_of = [x for p, w in zip(t[i:j].tolist(), where[i:j].tolist()) for x in ([p] if p < self.size else [self.byte_ids[b] for b in chr(int(text[w - 1])).encode()])]
                    self.known[chunks[k]] = np.array(ids_of, "<u4").tobytes()
                else:
                    self.known[chunks[k]] = plain[4 * i : 4 * j]
        self.known.update((chunks[k], self.library(chunks[k])) for k in np.flatnonzero(~sure).tolist())

    def library(self, chunk: str) -> bytes:
        """Ids of a chunk by the library: a line break before it keeps the model from adding a mark of its own."""
        ids = self.model.encode("\n" + chunk.replace(MARK, " "))
        lead = self.model.encode("\n")
        return np.array(ids[len(lead) :], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*split) - self.known.keys())
        held, low = 0, 0
        for k, chunk in enumerate(new):
            held += len(chunk)
            if held > LEARNED or k + 1 == len(new):
                self.learn(new[low : k + 1])
                held, low = 0, k + 1
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace").removeprefix(" ")


@functools.lru_cache(maxsize=1)
def matcher(path: str) -> Matcher:
    """The matcher of a worker, which its later tasks take over with all it knows."""
    return Matcher(path)


KEPT["pieces"] = matcher.cache_clear


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = matcher(model)
        for batch in batches:
            for low, high in groups(batch.column(1)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.encode(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run, "pieces"), "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = matcher(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([decoder.decode(x.as_py()) for x in part.column(1)], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run, "pieces"), "doc_id long, ids binary, text string")
