"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts anywhere else.

1. Anchors. In each window of LENGTH bytes the gram of GRAM bytes with the least hash is an anchor (all of them, on ties), so
   equal windows have equal anchors at equal places. A gram that occurs once can be in no repeated window. Grams are counted over
   all texts; a bitmap keeps the single ones out of the shuffles that follow.
2. Contexts. The bytes around an anchor that its windows reach are hashed. Occurrences with equal gram and equal context hash (128
   bits together) are copies: all their windows repeat. They are counted with map-side sums, so hot passages cost a row a task.
3. Shards. One representative of each context whose gram has several contexts goes to the gram's shard. There two suffix arrays are
   built by Larsson-Sadakane refinement over 7-byte words: one of the sides right of the anchors (left sides behind them) and one
   of the left sides, read away from the anchor. A window repeats if another context of its gram shares enough on both sides; the
   longest common prefixes are those with neighbours, and what neighbours share settles nearly all windows: the rest of
   a gram's windows go through a suffix array over their bytes and Kasai's common prefixes.
4. Merging. A gram with over SHARD contexts has no shard of its own. Its contexts are dealt over sorted ranges by binary search among
   sampled bounds (Spark's range partitioning), in both orders, so the shards put one after another are the merged array. Neighbours
   are compared within them and over their borders. Windows that neighbours don't settle are counted by 128-bit hashes.
5. Ranges go back to all occurrences, are joined to the texts by 128 bits of their SHA-256, and cut.

dedup_texts() also removes runs of words that stand anywhere else, where it is given their least number: the same steps over texts
whose words are written as 8 bytes each. Two runs that start inside such a word meet by chance only (64 bits).

Null texts are empty. Texts are UTF-8 bytes; matches never cross them. Rows that repeat, ids included, are texts of their own
and so repeat each other. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, bitmap, checkpoint, in_bitmap, lean, stored, text_bytes

LENGTH, GRAM = 400, 200
#: Words of a repeated passage, however short they are: over 50.
WORDS = 51
#: Contexts in a shard, at most twice this many.
SHARD = 4096
#: Bytes of texts that are hashed at once.
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Rolling hash of the gram at each place; equal grams have equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding(x: np.ndarray, width: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f (minimum or maximum) over each window of `width` values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead, behind = f.accumulate(blocks, axis=1).ravel(), f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of texts: for each the text's number, its place and its gram's hash."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.up, self.down = powers(1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        total = int(sizes.sum())
        if not (sizes >= self.length).any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(self.up) < total:
            self.up, self.down = powers(max(total, 2 * CHUNK))
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
        starts = ends - sizes
        h = gram_hashes(data, self.gram, self.up, self.down)
        least = sliding(h, self.width, np.minimum, 2**64 - 1)
        whole, step = sizes >= self.length, np.zeros(total + 1, np.int64)
        np.add.at(step, starts[whole], 1)
        np.add.at(step, ends[whole] - self.length + 1, -1)
        least[np.cumsum(step)[: len(least)] == 0] = 0  # windows that cross texts
        edge = np.zeros(self.width - 1, np.uint64)
        most = sliding(np.concatenate([edge, least, edge]), self.width, np.maximum, 0)
        at = np.flatnonzero((most == h) & (h > 0))
        text = np.searchsorted(ends, at, "right")
        return text, at - starts[text], h[at]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) in parts of about `size` bytes."""
    low, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield low, texts[low : k + 1]
            low, held = k + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a text."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    steps = np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)])
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


class Words:
    """The words of a text as 8 bytes each, hashes of them; nothing for fewer than `least`."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.up, self.down = powers(1)

    def __call__(self, text: bytes) -> bytes:
        data = np.frombuffer(text, np.uint8)
        starts, ends = word_places(data)
        if len(starts) < self.least:
            return b""
        if len(self.up) < len(data):
            self.up, self.down = powers(max(2 * len(data), CHUNK))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))).tobytes()


def suffix_order(words: np.ndarray, h: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: places of the suffixes in order of `depth` places at least, from words that stand for h places each.

    Only groups that are still unsorted are refined, by the rank h places on. Also gives how many places each suffix in order
    surely shares with the one before it: the depth that their group was split at.
    """
    n, most = len(words), 2 * depth
    order = np.argsort(words).astype(np.int32)
    shared = np.full(n, most, np.int32)
    ordered = words[order]
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    shared[head] = 0
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    at = np.arange(n, dtype=np.int32)
    while h < depth:
        head = shared[at] < most
        one = head.copy()
        one[:-1] &= head[1:]
        at = at[~one]  # places in unsorted groups
        if not len(at):
            break
        i = order[at]
        key = (rank[i].astype(np.int64) << 32) + rank[np.minimum(i + h, n)] + 1
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[at] = i
        new = np.empty(len(at), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[i] = np.maximum.accumulate(np.where(new, at, 0))
        fresh = at[new]
        shared[fresh] = np.minimum(shared[fresh], h)
        h *= 2
    shared[shared == most] = h
    return order, shared


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of bytes in order of `depth` bytes at least, the 8-byte words at all places, and what suffix_order() says is shared."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
    order, shared = suffix_order(words, 8, depth)
    return order, words, shared


def common_prefixes(words: np.ndarray, order: np.ndarray, shared: np.ndarray, rows: np.ndarray, counts: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: common prefix (up to `cap`) of each place in `order` with the place before it, if it may reach `cap`.

    Row k stands for `counts[k]` places from `rows[k]` on; all rows step together, each from one less than its last prefix (if
    its last partner's next place comes before it too; places that tie to the depth of the order may not) or from what the order
    says is shared. Pairs that were split before half of `cap` keep that figure: they can't reach `cap`.
    """
    n = len(words)
    before, number, known = np.full(n, -1), np.full(n + 1, n), np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    number[order] = np.arange(len(order))
    known[order] = shared
    out = np.minimum(known, cap)
    last, partner = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
    ahead, wide = 8 * np.arange(8), np.concatenate([words, np.zeros(cap + 128, np.uint64)])
    for p in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > p)
        i = rows[live] + p
        j, size = before[i], out[i]
        todo = np.flatnonzero((j >= 0) & (size < cap) & (2 * size >= cap))
        if len(todo):
            follows = (partner[live[todo]] >= 0) & (number[partner[live[todo]] + 1] < number[i[todo]])
            size[todo] = np.maximum(size[todo], np.where(follows, last[live[todo]] - 1, 0))
        while len(todo):
            a, b = i[todo] + size[todo], j[todo] + size[todo]
            x = wide[a[:, None] + ahead] ^ wide[b[:, None] + ahead]
            differs = x != 0
            first = differs.argmax(axis=1)
            same = ~differs[np.arange(len(x)), first]
            x = x[np.arange(len(x)), first]
            size[todo] += np.where(same, 64, 8 * first + sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8)))
            todo = todo[same & (np.maximum(a, b) < n) & (size[todo] < cap)]
        size = np.minimum(size, cap)
        out[i] = size
        last[live], partner[live] = size, j
    return out


def repeated_windows(contexts: list[bytes], many: np.ndarray, text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) runs of window starts that repeat: in another place (text, start), or in a context with copies.

    `start` is where the context starts in its text; `many` tells contexts with copies elsewhere.
    """
    if not contexts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(c) for c in contexts], np.int64)
    rows = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    order, words, shared = suffix_array(np.frombuffer(b"".join(contexts), np.uint8), length)
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes)
    window = np.arange(len(words)) - rows[owner] < counts[owner]
    at = np.flatnonzero(window[order])
    if not len(at):
        return at, at, at
    order = order[at]  # of windows only; two of them share what all between them share
    shared = np.r_[np.int32(0), np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1)] if len(at) > 1 else np.zeros(1, np.int32)
    prefix = common_prefixes(words, order, shared, rows, counts, length)
    group = np.cumsum(prefix[order] < length)
    k = owner[order]
    place = (text[k] << 32) + start[k] + order - rows[k]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    again = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
    again |= np.maximum.reduceat(many[k].astype(np.int8), heads) > 0
    flags = np.zeros(len(words) + 1, np.int8)
    flags[order] = np.repeat(again, np.diff(np.r_[heads, len(order)]))
    # a run ends with its context's windows: after them comes a zero, as a context is longer than its windows
    steps = np.diff(np.r_[np.int8(0), flags])
    first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) - 1
    k = owner[first]
    return k, first - rows[k], last - rows[k]


class Sides:
    """One side of each context, read away from the anchor, as words of seven 9-bit symbols (0: the text has ended)."""

    def __init__(self, parts: list[bytes], width: int) -> None:
        self.sizes, across = np.array([len(p) for p in parts], np.int64), -(-width // 7)
        data = np.frombuffer(b"".join(p.ljust(7 * across, b"\0") for p in parts), np.uint8).reshape(len(parts), -1)
        symbols = np.where(np.arange(7 * across) < self.sizes[:, None], data.astype(np.uint16) + np.uint16(1), np.uint16(0)).reshape(len(parts), across, 7)
        self.words = np.zeros((len(parts), across), np.uint64)
        for k in range(7):
            self.words |= symbols[:, :, k].astype(np.uint64) << np.uint64(9 * (6 - k))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the sides of contexts a and b have in common."""
        x = np.column_stack([self.words[a] ^ self.words[b], np.full(len(a), 1, np.uint64)])
        k = (x != 0).argmax(axis=1)
        x = x[np.arange(len(a)), k]
        inside = sum((x < np.uint64(1 << (9 * (7 - j)))).astype(np.int64) for j in range(1, 7))
        return np.minimum(np.where(k == self.words.shape[1], 7 * k, 7 * k + inside), np.minimum(self.sizes[a], self.sizes[b]))


def anchored_order(group: np.ndarray, near: Sides, far: Sides) -> np.ndarray:
    """Contexts in order of their group, one side, then the other: a suffix array over the contexts' words.

    Each context is the string of its group's number and its words. Suffixes that start at a number come first in the array.
    """
    number = group.astype(np.uint64)[:, None]  # below every word but 0, as a word's first symbol is its highest
    rows = np.concatenate([number + np.uint64(1), near.words + np.uint64(1 << 62), far.words + np.uint64(1 << 62)], axis=1)
    width = rows.shape[1]
    order = suffix_order(rows.ravel(), 1, width)[0]
    return order[order % width == 0].astype(np.int64) // width


def aligned(group: np.ndarray, left: list[bytes], right: list[bytes], need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What neighbours in both orders share: flags [context, bytes left of the anchor] of windows that repeat, the most that
    any other context of the group shares on the left and on the right, and whether windows between these bounds are open.

    A window with `o` bytes left of the anchor needs `need` - o bytes right of the gram.
    """
    n, sides = len(group), (Sides(left, need), Sides(right, need))
    steps, most = np.zeros((n, need + 2), np.int16), np.zeros((2, n), np.int64)
    for k in range(2):
        order = anchored_order(group, sides[k], sides[1 - k])
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        shared = [side.shared(a, b) for side in sides]
        for ends in (a, b):
            np.maximum.at(most[k], ends, shared[k])
        enough = shared[0] + shared[1] >= need
        for ends in (a[enough], b[enough]):
            np.add.at(steps, (ends, need - shared[1][enough]), 1)
            np.add.at(steps, (ends, shared[0][enough] + 1), -1)
    again = np.cumsum(steps, axis=1)[:, : need + 1] > 0
    o = np.arange(need + 1)
    may = (o >= need - most[1][:, None]) & (o <= most[0][:, None])
    return again, most[0], most[1], (may & ~again).any(axis=1)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    n, width = flags.shape
    wide = np.zeros((n, width + 1), np.int8)
    wide[:, :width] = flags
    steps = np.diff(np.concatenate([np.zeros(1, np.int8), wide.ravel()]))
    first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) - 1
    return first // (width + 1), first % (width + 1), last % (width + 1)


#: 128 bits of its SHA-256 stand for a text: all rows with the same bytes have the same ranges.
DIGEST = ["d", "e"]


def own_digest() -> list:
    """The same as digest(), as columns."""
    return [F.conv(F.substring(F.sha2("text", 256), at, 16), 16, -10).cast("long").alias(name) for at, name in zip((1, 17), DIGEST, strict=True)]


def digest(text: bytes) -> tuple[int, int]:
    raw = hashlib.sha256(text).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:16], "big", signed=True)


def occurrences(docs: DataFrame, length: int, gram: int, words: Words | None = None) -> DataFrame:
    """h, c, d, e, pos: gram hash, context hash, text digest and place of each anchor whose gram may repeat.

    With `words`, anchors are those of its codes, made where they are read: a Python step of their own would be one more worker a task.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(list(map(words, part)) if words else part)[2].view(np.int64))], ["h"])

    counted = docs.select("text").mapInArrow(lean(hashes), "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(counted.select("h")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        anchors, context = Anchors(length, gram), xxhash.xxh3_64_intdigest
        for batch in batches:
            reach = length - gram
            for _, whole in chunks(batch.column(0).to_pylist()):
                part = list(map(words, whole)) if words else whole
                text, pos, h = anchors(part)
                kept = in_bitmap(bits.value, h)
                text, pos, h = text[kept], pos[kept], h[kept]
                c = np.array([context(part[t][max(0, p - reach) : p + length], min(p, reach)) for t, p in zip(text.tolist(), pos.tolist(), strict=True)], np.uint64)
                d = {t: digest(whole[t]) for t in np.unique(text).tolist()}
                marks = np.array([d[t] for t in text.tolist()], np.int64).reshape(-1, 2)
                columns = (h.view(np.int64), c.view(np.int64), marks[:, 0], marks[:, 1], pos.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "d", "e", "pos"])

    return docs.select("text").mapInArrow(lean(rows), "h long, c long, d long, e long, pos int")


def cut_contexts(needs: DataFrame, docs: DataFrame, length: int, gram: int, words: Words | None = None) -> DataFrame:
    """`needs` (h, c, n, d, e, pos) with `left` bytes before the anchor, in `bytes`; only texts that are needed cross the network."""
    reach, names = length - gram, ["h", "c", "many", "d", "start", "reach", "bytes"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slow in range(0, batch.num_rows, 100):
                part, out = batch.slice(slow, 100), []
                for d, text, wanted in zip(*(part.column(n).to_pylist() for n in range(3)), strict=True):
                    text = words(text) if words else text
                    for x in wanted:
                        low = max(0, x["pos"] - reach)
                        out.append((x["h"], x["c"], x["n"] > 1, d, low, x["pos"] - low, text[low : x["pos"] + length]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    wanted = stored(needs.groupBy(*DIGEST).agg(F.collect_list(F.struct("h", "c", "n", "pos")).alias("wanted")), "wanted")
    texts = docs.select(*own_digest(), "text").withColumn("first", among(wanted.select("d"), *DIGEST, once=True)).filter("first")
    return texts.join(wanted, DIGEST).select("d", "text", "wanted").mapInArrow(lean(cut), "h long, c long, many boolean, d long, start long, reach int, bytes binary")


def shard_ranges(mixed: DataFrame, docs: DataFrame, length: int, gram: int, shard: int, words: Words | None = None) -> DataFrame:
    """h, c, low, high: bytes, counted from the anchor, that repeated windows of each context cover; for grams with a shard."""
    need = length - gram

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for low in range(0, batch.num_rows, shard):
                part = batch.slice(low, shard)
                keys = part.column(0).to_numpy()
                if held and sum(x.num_rows for x in held) >= shard // 2:
                    same = int(np.searchsorted(keys, held[-1].column(0)[-1].as_py(), "right"))
                    if same < len(keys):
                        yield from solve([*held, part.slice(0, same)])
                        held, part = [], part.slice(same)
                held.append(part)
        if held:
            yield from solve(held)

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        h, c, many, d, start, left = (t.column(n).to_numpy() for n in ("h", "c", "many", "d", "start", "reach"))
        _, first = np.unique(np.stack([h, c]), axis=1, return_index=True)  # copies of a text gave theirs as well
        h, c, many, d, start, left = (x[first] for x in (h, c, many, d, start, left))
        found = t.column("bytes").take(pa.array(first)).to_pylist()
        group = np.unique(h, return_inverse=True)[1]
        again, before, after, open_ = aligned(group, [b[:x][::-1] for b, x in zip(found, left.tolist(), strict=True)], [b[x + gram :] for b, x in zip(found, left.tolist(), strict=True)], need)
        row, low, high = runs(again)
        yield ranges(h[row], c[row], -high, length - low)
        # groups with windows that no neighbour settled: bytes that another context may share
        near = np.flatnonzero(np.isin(group, group[open_ & ~many]) & (before + after >= need))
        if len(near):
            h, c, many, d, start, left, before, after = (x[near] for x in (h, c, many, d, start, left, before, after))
            found = [found[n][x - b : x + gram + a] for n, x, b, a in zip(near.tolist(), left.tolist(), before.tolist(), after.tolist(), strict=True)]
            text = np.unique(d, return_inverse=True)[1].astype(np.int64)
            at, low, high = repeated_windows(found, many, text, start + left - before, length)
            yield ranges(h[at], c[at], low - before[at], high - before[at] + length)

    def ranges(h: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["h", "c", "low", "high"])

    cuts = cut_contexts(mixed, docs, length, gram, words).select(F.xxhash64("h").alias("key"), "*")
    return cuts.repartition("key").sortWithinPartitions("key").mapInArrow(lean(settle), "h long, c long, low int, high int")


def ordered(side: bytes) -> bytes:
    """A side as bytes whose plain order is that of the sides, an ended one first."""
    return side.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") + b"\0"


def hot_ranges(mixed: DataFrame, docs: DataFrame, length: int, gram: int, words: Words | None = None) -> DataFrame:
    """The same as shard_ranges() for grams with more contexts than a shard holds."""
    need = length - gram

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slow in range(0, batch.num_rows, 500):
                part = batch.slice(slow, 500)
                sides = [(b[:x][::-1], b[x + gram :]) for b, x in zip(part.column("bytes").to_pylist(), part.column("reach").to_pylist(), strict=True)]
                for k in range(2):
                    keys = [ordered(s[k]) + ordered(s[1 - k]) for s in sides]
                    columns = [part.column(n) for n in ("h", "c", "many")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([k] * len(keys), pa.int32()), pa.array(keys), *(pa.array([s[j] for s in sides]) for j in range(2))], ["h", "c", "many", "side", "key", "left", "right"])

    kind = "h long, c long, many boolean, side int, key binary, left binary, right binary"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What neighbours share, and the first and the last row of the partition as they are."""
        from pyspark import TaskContext

        place, last = TaskContext.get().partitionId(), None
        border = lambda row, end: row.select(["h", "c", "many", "side", "left", "right"]).append_column("l", pa.array([end], pa.int32())).append_column("r", pa.array([place], pa.int32()))
        for batch in batches:
            for slow in range(0, batch.num_rows, 4096):
                part = batch.slice(slow, 4096)
                if last is None:
                    yield from border(pa.Table.from_batches([part.slice(0, 1)]), 0).to_batches()
                whole = pa.Table.from_batches([part] if last is None else [last, part])
                yield neighbours(whole, need)
                last = part.slice(part.num_rows - 1)
        if last is not None:
            yield from border(pa.Table.from_batches([last]), 1).to_batches()

    told = "h long, c long, many boolean, side int, left binary, right binary, l int, r int"
    cuts = stored(cut_contexts(mixed, docs, length, gram, words).dropDuplicates(["h", "c"]).mapInArrow(lean(both), kind), "hot")
    met = checkpoint(cuts.repartitionByRange("side", "h", "key").sortWithinPartitions("side", "h", "key").mapInArrow(lean(pairs), told))
    ends = met.filter("left is not null").orderBy("r", "l").toArrow()  # two rows a partition
    crossing = pa.Table.from_batches([neighbours(ends, need)]) if ends.num_rows else ends
    crossed = docs.sparkSession.createDataFrame(crossing.select(["h", "c", "many", "side", "l", "r"]))
    shared = met.filter("left is null").select(*crossed.columns).union(crossed)
    enough = shared.filter(f"l + r >= {need}")
    found = enough.select("h", "c", (-F.col("l")).alias("low"), (F.col("r") + gram).alias("high"))
    # a context is open if its neighbours' ranges leave out windows that the most shared on each side would allow
    most = shared.groupBy("h", "c").agg(F.bool_or("many").alias("many"), F.max("l").alias("l"), F.max("r").alias("r")).filter(f"not many and l + r >= {need}")
    spans = found.groupBy("h", "c").agg(merged(F.collect_set(F.struct((-F.col("high") + length).alias("low"), (-F.col("low") + 1).alias("high")))).alias("spans"))
    whole = F.array(F.struct((F.lit(need) - F.col("r")).alias("low"), (F.col("l") + 1).alias("high")))
    left_open = most.join(spans, ["h", "c"], "left").filter(F.col("spans").isNull() | (F.col("spans") != whole))
    grams = checkpoint(left_open.groupBy("h").agg(F.min(F.lit(need) - F.col("r")).alias("first"), F.max("l").alias("last")))
    if grams.isEmpty():
        return found
    return found.union(counted_windows(cuts.filter("side = 0").join(grams, "h"), length, gram))


def neighbours(rows: pa.Table, need: int) -> pa.RecordBatch:
    """A row for either end of each two rows of one gram and order that follow each other, with the bytes they share left and right."""
    h, c, many, side = (rows.column(n).to_numpy() for n in ("h", "c", "many", "side"))
    left, right = (Sides(rows.column(n).to_pylist(), need) for n in ("left", "right"))
    a = np.flatnonzero((h[1:] == h[:-1]) & (side[1:] == side[:-1]) & (c[1:] != c[:-1]))
    at = np.concatenate([a, a + 1])
    l, r = (np.tile(s.shared(a, a + 1), 2).astype(np.int32) for s in (left, right))  # noqa: E741
    none = pa.nulls(len(at), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(c[at]), pa.array(many[at]), pa.array(side[at]), none, none, pa.array(l), pa.array(r)], ["h", "c", "many", "side", "left", "right", "l", "r"])


def counted_windows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, low, high of each window between `first` and `last` bytes left of the anchor that two contexts of a gram have."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        need = length - gram
        for batch in batches:
            out: list[tuple] = []
            for h, c, left, right, first, last in zip(*(batch.column(n).to_pylist() for n in ("h", "c", "left", "right", "first", "last")), strict=True):
                for o in range(max(first, need - len(right)), min(last, len(left)) + 1):
                    x = xxhash.xxh3_128_intdigest(left[:o] + b"|" + right[: need - o])
                    out.append((h, c, o, (x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], ["h", "c", "o", "x", "y"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], ["h", "c", "o", "x", "y"])

    windows = stored(rows.select("h", "c", "left", "right", "first", "last").mapInArrow(lean(hashes), "h long, c long, o long, x long, y long"), "windows")
    again = checkpoint(windows.groupBy("h", "o", "x", "y").count().filter("count > 1"))
    return windows.join(again, ["h", "o", "x", "y"]).select("h", "c", (-F.col("o")).cast("int").alias("low"), (F.lit(length) - F.col("o")).cast("int").alias("high"))


def merged(ranges):
    """The union of an array of ranges (low, high), as sorted ranges that don't touch."""

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.array(F.struct(last.low.alias("low"), F.greatest(last.high, x.high).alias("high")))
        return F.when(last.high >= x.low, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<low: int, high: int>>"), add)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, words: Words | None = None) -> DataFrame:
    """d, e and ranges [low, high) of each text that holds repeated strings, of its codes by `words` if given; `docs` with text bytes."""
    found = stored(occurrences(docs, length, gram, words), "anchors")
    first = F.min(F.struct(*DIGEST, "pos")).alias("at")
    contexts = stored(found.groupBy("h", "c").agg(F.count("*").alias("n"), first).select("h", "c", "n", "at.*"), "contexts")
    grams = checkpoint(contexts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").cast("int").alias("kinds")).filter("total > 1").select("h", "kinds"))
    ranges = contexts.filter("n > 1").select("h", "c", F.lit(gram - length).alias("low"), F.lit(length).alias("high"))
    ranges = ranges.union(shard_ranges(contexts.join(grams.filter(f"kinds between 2 and {shard}"), "h"), docs, length, gram, shard, words))
    hot = grams.filter(f"kinds > {shard}")
    if not hot.isEmpty():
        ranges = ranges.union(hot_ranges(contexts.join(hot, "h"), docs, length, gram, words))
    # one row a context, and written before it is joined: the join gives a row for each anchor at most, and a hot context can be split
    spans = checkpoint(ranges.groupBy("h", "c").agg(merged(F.collect_set(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))).alias("spans")))
    moved = F.transform("spans", lambda x: F.struct((F.col("pos") + x.low).alias("low"), (F.col("pos") + x.high).alias("high")))
    each = found.join(spans, ["h", "c"]).select(*DIGEST, moved.alias("spans"))
    return stored(each.groupBy(*DIGEST).agg(F.flatten(F.collect_set("spans")).alias("ranges")), "ranges")


def with_ranges(docs: DataFrame, row, length: int, gram: int, shard: int, words: int | None = None) -> DataFrame:
    """text, row, repeated ranges and runs of words (null where there are none) of each row of `docs`, whose other columns `row` is made of."""
    base = docs.select(text_bytes().alias("text"), row.alias("row"))
    ranges = repeated_ranges(base.select("text"), length, gram, shard)
    kind = ranges.schema["ranges"].dataType
    if words:
        runs_of_words = repeated_ranges(base.select("text"), 8 * words, 8 * (words // 2 + 1), shard, Words(words))
        ranges = checkpoint(ranges.join(runs_of_words.withColumnRenamed("ranges", "words"), DIGEST, "full"))
    else:
        ranges = ranges.withColumn("words", F.lit(None).cast(kind))
    keyed = base.select(*own_digest(), "text", "row").withColumn("told", among(ranges.select("d"), "d"))
    # texts without ranges stay where they are
    joined = keyed.filter("told").join(ranges, DIGEST, "left").select("text", "row", "ranges", "words")
    return joined.union(keyed.filter("not told").select("text", "row", F.lit(None).cast(kind), F.lit(None).cast(kind)))


def united(ranges: list[tuple[int, int]], size: int) -> list[dict]:
    """Maximal runs of ranges within `size`."""
    own: list[dict] = []
    for low, high in sorted(ranges):
        low, high = max(low, 0), min(high, size)
        if own and low <= own[-1]["end"]:
            own[-1]["end"] = max(high, own[-1]["end"])
        else:
            own.append({"start": low, "end": high})
    return own


def pairs_of(ranges: pa.ListScalar) -> list[tuple[int, int]]:
    return list(zip(*(ranges.values.field(k).to_pylist() for k in range(2)), strict=True)) if ranges.is_valid else []


def spans_of(text: bytes, ranges: pa.ListScalar, words: pa.ListScalar) -> list[dict]:
    """Maximal removed runs of a text."""
    own = pairs_of(ranges)
    if words.is_valid:
        starts, ends = word_places(np.frombuffer(text, np.uint8))
        for run in united(pairs_of(words), 8 * len(starts)):
            first, last = -(-run["start"] // 8), run["end"] // 8 - 1  # whole words: a neighbour's first bytes may be the same
            own.append((int(starts[first]), int(ends[last])))
    return united(own, len(text))


def remaining(text: bytes, spans: list[dict]) -> bytes:
    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (removed [start, end) runs) and kept (remaining bytes) of each row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slow in range(0, batch.num_rows, 500):
                part = batch.slice(slow, 500)
                texts = part.column(0).to_pylist()
                spans = [spans_of(t, r, w) for t, r, w in zip(texts, part.column(2), part.column(3), strict=True)]
                kept = [remaining(t, s) for t, s in zip(texts, spans, strict=True)]
                columns = [part.column(1), pa.array(list(map(len, texts)), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    joined = with_ranges(docs, F.col("doc_id").cast("long"), length, gram, shard)
    return joined.mapInArrow(lean(remove), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def dedup_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, words: int | None = None) -> DataFrame:
    """`docs` with the remaining text in each row; bytes of a character that a cut went through go as well.

    With `words`, every run of so many words that also starts anywhere else goes too, however few bytes it has.
    """

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slow in range(0, batch.num_rows, 500):
                part = batch.slice(slow, 500)
                own = zip(part.column(0).to_pylist(), part.column(2), part.column(3), strict=True)
                texts = [remaining(t, spans_of(t, r, w)).decode(errors="ignore") for t, r, w in own]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(1)], ["text", "row"])

    joined = with_ranges(docs, F.struct("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text"))), length, gram, shard, words)
    whole = joined.mapInArrow(lean(replace), f"text string, row {joined.schema['row'].dataType.simpleString()}")
    return whole.select("row.*", "text").select(*docs.columns)
