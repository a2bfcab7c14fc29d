"""Best-fit packing of token pieces into sequences by swap-based local search.

Only lengths travel: a text is cut into tokens and pieces inside the scan, ids stay a binary column that callers may drop.
Pieces are dealt evenly over buckets of bounded size; each bucket is packed by itself (best fit over decreasing lengths, then
exchanges), and what lies in bins less than half full meets again in a second, far smaller round.

Null or empty text: one piece holding only the end token. Repeated rows and equal doc_ids are packed row by row. A null doc_id
stays null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, checkpoint, lean

CAPACITY = 4096
END_TOKEN = 1
#: Tokens that one bucket holds on average; its lengths and bins are all that a task keeps.
BUCKET_TOKENS = 1 << 22
#: Chunks of text between white space whose ids a worker remembers.
CACHE_CHUNKS = 600_000
#: Characters of text that are encoded together; a longer text is a group by itself.
GROUP_CHARACTERS = 1 << 22
#: A character outside those for which the pre-tokenizer's pattern is applied here; a text with one is encoded as a whole.
ODD = "[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]"
#: Fixed value: the pre-tokenizer's pattern, from the tokenizer file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit numbers; equal chunks are encoded by the tokenizer once.

    No match of the pattern holds white space, so the chunks between white space are encoded independently of each other.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd, self.words = re.compile(ODD).search, regex.compile(WORD).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most = CACHE_CHUNKS

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, many words at a time."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 2_000):
            part = words[k : k + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * stops).tolist()
                out.update(zip(part, (raw[i:j] for i, j in zip([0, *cuts], cuts)), strict=False))
            else:
                out.update((w, self.whole(w)) for w in part)
        return out

    def split(self, chunk: str) -> list[str]:
        """The pattern's matches in a lower-cased chunk; letters, and letters with one mark behind them, need no pattern."""
        if chunk.isalpha():
            return [chunk]
        head, mark = chunk[:-1], chunk[-1:]
        return [head, mark] if mark in (".", ",") and head.isalpha() else self.words(chunk)

    def learn(self, chunks: list[str]) -> None:
        split = [self.split(c.lower()) for c in chunks]
        self.known |= self.encoded(list(set().union(*split) - self.known.keys()))  # a word is a chunk too
        get = self.known.__getitem__
        self.known.update(zip(chunks, [get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for w in split], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [k for k, t in enumerate(texts) if "<|" in t or self.odd(t)]
        plain = list(texts)
        for k in odd:
            plain[k] = ""
        lists = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        found = lists.flatten().dictionary_encode()
        chunks = found.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.known.clear()
        self.learn([c for c in chunks if c not in self.known])
        ids = [self.known[c] for c in chunks]
        # each chunk's ids lie at starts .. starts + sizes of `flat`; they are gathered in the order of the texts
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, found.indices.to_numpy()
        sizes = sizes[at]
        ends = np.r_[0, np.cumsum(sizes)]
        places = np.repeat((starts[at] - ends[:-1]).astype(np.int32), sizes)
        places += np.arange(ends[-1], dtype=np.int32)
        raw = flat[places].tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
        out = [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        for k in odd:
            out[k] = self.whole(texts[k])
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of a worker, which its later tasks take over with all it knows."""
    return WordEncoder(path)


KEPT["packing"] = encoder.cache_clear


def groups(texts: pa.Array, most: int = GROUP_CHARACTERS) -> Iterator[tuple[int, int]]:
    """Ranges of at most 1,000 rows and about `most` characters, or one row."""
    sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(sizes):
        before = sizes[low - 1] if low else 0
        high = min(low + 1000, max(low + 1, int(np.searchsorted(sizes, before + most, "right"))))
        yield low, high
        low = high


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, chunks: int = CACHE_CHUNKS, characters: int = GROUP_CHARACTERS) -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit) of each piece of each row.

    `chunks` that a worker remembers and `characters` that it encodes at once bound its memory; ids don't depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([END_TOKEN], "<u4").tobytes()
        words.most = chunks
        for batch in batches:
            for low, high in groups(batch.column(1), characters):
                part = batch.slice(low, high - low)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, n, at // 4, len(cut) // 4, cut))
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run, "packing"), "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length: longest first, each into the fullest bin that still takes it."""
    out, free, mask, bins = np.empty(len(lengths), np.int64), {}, 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, k = capacity, bins
            bins += 1
        out[at] = k
        if left := room - need:
            free.setdefault(left, []).append(k)
            mask |= 1 << left
    return out


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, steps: int = 1_000) -> np.ndarray:
    """Moves, one-for-one and two-for-one exchanges out of the emptiest bins, each of which raises the squared fill.

    It ends at the fewest bins that the total allows, when no step helps, or after `steps` steps.
    """
    bins, fewest = bins.copy(), -(-int(lengths.sum()) // capacity)
    fill = np.bincount(bins, lengths).astype(np.int64)
    stuck: set[int] = set()
    for _ in range(steps):
        if (fill > 0).sum() <= fewest:
            break
        order = [k for k in np.argsort(np.where(fill > 0, fill, capacity + 1), kind="stable")[:8].tolist() if fill[k] and k not in stuck]
        if not order:
            break
        low = order[0]
        own = np.flatnonzero(bins == low)
        own = own[np.argsort(-lengths[own], kind="stable")][:16]
        room = np.where((fill > 0) & (np.arange(len(fill)) != low), capacity - fill, -1)
        step: tuple | None = None
        for x in own.tolist():  # a move
            fits = np.where(room >= lengths[x], room, capacity + 1)
            if fits[k := int(fits.argmin())] <= capacity and fill[k] + lengths[x] > fill[low] - lengths[x]:
                step = ([x], None, k)
                break
        if step is None:
            gain, room_of = 0, room[bins]
            sets = [[x] for x in own.tolist()] + [[x, z] for i, x in enumerate(own.tolist()) for z in own.tolist()[i + 1 :]]
            for group in sets:
                more = int(lengths[group].sum()) - lengths
                good = np.where((more > 0) & (more <= room_of) & (fill[bins] + more > fill[low]), more, 0)
                if good[y := int(good.argmax())] > gain:
                    gain, step = int(good[y]), (group, y, int(bins[y]))
        if step is None:
            stuck.add(low)
            continue
        group, y, k = step
        bins[group] = k
        moved = int(lengths[group].sum())
        if y is not None:
            bins[y] = low
            moved -= int(lengths[y])
        fill[k] += moved
        fill[low] -= moved
        stuck.clear()
    return bins


def pack_bucket(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and fill of the bin for each length."""
    bins = np.unique(local_search(lengths, best_fit(lengths, capacity), capacity), return_inverse=True)[1]
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(lengths)]))
    return bins, offset, np.bincount(bins, lengths).astype(np.int64)[bins]


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """`pieces` (with a long `length` from 1 to capacity) and where each goes: sequence_id, offset.

    `pieces` is checkpointed: its rows are dealt by their place in that table, so no id can crowd a bucket.
    """
    pieces = checkpoint(pieces)
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(half: bool):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            lengths = group.column("length").to_numpy()
            bins, offset, fill = pack_bucket(lengths, capacity)
            loose = (fill <= capacity // 2) & half
            ids = (key[0].as_py() << 32) + 2 * bins + (not half)
            return group.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))

        return run

    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    buckets = max(1, -(-tokens // bucket_tokens))
    out = f"{schema}, sequence_id long, offset long, loose boolean"
    dealt = pieces.withColumn("bucket", F.monotonically_increasing_id() % buckets)
    first = dealt.groupBy("bucket").applyInArrow(place(half=True), out)
    if buckets == 1:
        return first.drop("loose")
    first = checkpoint(first)
    loose = first.filter("loose").select(*names, (F.shiftright("sequence_id", 32) % -(-buckets // 1024)).alias("bucket"))
    second = loose.groupBy("bucket").applyInArrow(place(half=False), out)
    return first.filter("not loose").union(second).drop("loose")


def packed_sequences(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id and its ids as one binary; `pieces` with ids, `plan` from pack()."""
    joined = plan.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, X'', (s, p) -> concat(s, p.ids))").alias("ids"))
