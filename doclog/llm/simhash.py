"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. The Golay code (23, 12) is perfect: every 23-bit word
lies within three bits of exactly one codeword. A segment's keys are the codewords of the word and of all its one-bit
neighbours (six at most, one for words close to their codeword). Two segments that differ in at most two bits share a word
one bit from both, and so a key. Four differing bits leave at least two of three segments with two or fewer, so the pairs of
keys of two segments (24 bits) bring every linked pair together. Pairs that meet are verified on the fingerprints.

Equal fingerprints are one node, so copies cost nothing. Rows that meet under a key are compared inside sorted partitions,
and only a spanning forest of what was verified leaves a task. A key with more than RUN fingerprints is not compared there: its
rows are dealt over blocks (in_blocks()), so that no key is dropped or held whole.

Null and word-less texts have fingerprint zero, linked like any other. Repeated rows and ids give a row each. A null doc_id gets
the component of its fingerprint, and can't name one: a component without any other id is null. Other columns are ignored.

keep_one() uses the same keys for a Jaccard similarity of LEAST on the sets of WORDS-word shingles, where some 15 of 100 bits differ. Six
segments of 23 bits are decoded by the margins of their bits, which tell the bits that flip from those that don't: each gives the
NEAREST codewords by correlation. Pairs of segments make the keys, nodes that meet and differ in at most CHECKED of 128 bits are
candidates, and within a group of candidates every pair is decided by its sets. Two sets of similarity 0.8 meet with a
probability of 0.99 (by simulation), more similar ones more often. Equal sets are one node; texts without words equal each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, checkpoint, components, forest, lean, stored, text_bytes

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: (lowest bit, bits) of each segment; at most 23 bits each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RUN = 2048
#: Of keep_one(): words of a shingle, least similarity, segments, codewords of each, and bits of 128 in which candidates may differ.
WORDS, LEAST, PARTS, NEAREST, CHECKED = 5, 0.8, 6, 3, 36
#: Sets that are compared with each other at once, and values of them.
SETS, VALUES = 1024, 1 << 20


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned SimHash of a text's word shingles; a bit is 1 if over half of the shingles' hashes have it."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts words
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        hashes = digest(line, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = (np.cumsum(lengths + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[: len(words) - size])]
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[size - 1 :], strict=True)])
    counts, n = np.zeros(64, np.int64), len(hashes) // 8
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for low in range(0, n, 4096):
        counts += np.unpackbits(raw[low : low + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the unsigned fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


class Golay:
    """Index (0 to 4095) of the codeword within three bits of each 23-bit word."""

    #: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
    GENERATOR = 0b110001110101

    def __init__(self) -> None:
        columns = []
        for bit in range(23):
            left = 1 << bit
            for high in range(bit, 10, -1):
                if left >> high & 1:
                    left ^= self.GENERATOR << (high - 11)
            columns.append(left)
        words = np.arange(256)
        self.parts = [np.bitwise_xor.reduce([np.where(words >> b & 1, columns[at + b] if at + b < 23 else 0, 0) for b in range(8)]) for at in (0, 8, 16)]
        self.errors = np.zeros(2048, np.int64)
        one = [1 << b for b in range(23)]
        for e in [*one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]:
            self.errors[self.syndrome(np.array([e]))] = e

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parts[0][words & 255] ^ self.parts[1][words >> 8 & 255] ^ self.parts[2][words >> 16]

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[self.syndrome(words)]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Rows of the distinct codewords of each word and its one-bit neighbours, -1 where there are fewer."""
        found = np.sort(np.stack([self.index(words), *(self.index(words ^ (1 << b)) for b in range(bits))], axis=1), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return -np.sort(-found, axis=1)[:, :7]


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys (two bits for the pair of segments, 24 for its codewords) and the place of each key's fingerprint."""
    segments = [golay.keys((fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1), bits) for low, bits in SEGMENTS]
    keys, places = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for a in range(7):
            for b in range(7):
                at = np.flatnonzero((segments[i][:, a] >= 0) & (segments[j][:, b] >= 0))
                if len(at):
                    keys.append((pair << 24 | segments[i][at, a] << 12 | segments[j][at, b]).astype(np.int32))
                    places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def near(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the ids that share a key and differ in at most `most` bits of their prints; rows sorted by key."""
    a, b, at, lag = [], [], np.arange(len(keys)), 1
    waiting = 0
    while True:
        at = at[at + lag < len(keys)]
        at = at[keys[at + lag] == keys[at]]
        if not len(at):
            break
        x, y = ids[at], ids[at + lag]
        ok = (x != y) & (np.bitwise_count(prints[at] ^ prints[at + lag]).sum(axis=1, dtype=np.int64) <= most)
        a.append(x[ok])
        b.append(y[ok])
        waiting += int(ok.sum())
        if waiting > 1 << 19:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, waiting = [x], [y], len(x)
        lag += 1
    return forest(np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b]))


def meet(rows: DataFrame, most: int, run: int | None) -> DataFrame:
    """Links a-b among the ids that share a key, from rows (key, id, prints...; without prints the id is one).

    Rows with a set `late` come back instead, as (key, id), if their key has over `run` ids.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, late: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), late))], ["a", "b", "late"])

        def settle(keys: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            over = np.repeat(sizes > (run or len(keys)), sizes)
            if over.any():
                yield out(keys[over], own[over, 0], True)
            own = own[~over]
            a, b = near(keys[~over], own[:, 0], (own[:, 1:] if own.shape[1] > 1 else own).view(np.uint64), most)
            if len(a):
                yield out(a, b, False)

        kept, old, hot = np.empty(0, np.int64), None, None
        for batch in batches:
            fresh = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            keys = np.concatenate([kept, batch.column(0).to_numpy().astype(np.int64)])
            own = fresh if old is None else np.concatenate([old, fresh])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            if hot is not None and len(keys):
                n = int(np.searchsorted(keys, hot, "right"))
                if n:
                    yield out(keys[:n], own[:n, 0], True)
                keys, own, last = keys[n:], own[n:], max(0, last - n)
                if not len(keys):
                    kept, old = keys, own
                    continue
                hot = None
            yield from settle(keys[:last], own[:last])
            kept, old = keys[last:], own[last:]
            if run and len(kept) > run:
                yield out(kept, old[:, 0], True)
                hot, kept, old = int(kept[0]), kept[:0], old[:0]
        if old is not None:
            yield from settle(kept, old)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(pairs), "a long, b long, late boolean")


def in_blocks(members: DataFrame, told: DataFrame, compare: Callable[[DataFrame], DataFrame], run: int) -> DataFrame:
    """Links (a, b) that connect what compare() would link among all members (key, id) of each key; `told` (id, ...) is what it needs of each.

    A key with over `run` members is dealt over blocks of half as many, twice, and compare() sees (block, id, ...). An id with several
    keys, all of them that large, is dealt under the largest. What that leaves outside the largest component of a key then meets
    all of the key's blocks, as many at a time as a block has: any other pair is connected already. So no task gets more than about
    `run` members at once, however many stay outside.
    """
    rest = [c for c in told.columns if c != "id"]
    sizes = checkpoint(members.groupBy("key").agg(F.count("*").alias("n")))
    blocks = F.when(F.col("n") > run, F.ceil(F.col("n") / (run // 2))).otherwise(1).cast("int").alias("blocks")
    sized = stored(members.join(sizes.select("key", blocks), "key"), "members")
    main = sized.groupBy("id").agg(F.max(F.struct("blocks", "key")).alias("m")).select("m.key", "id", "m.blocks")
    own = lambda deal: F.pmod(F.xxhash64("id", "key", deal), "blocks").cast("int")
    each = main.withColumn("deal", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = checkpoint(compare(each.select(F.xxhash64("key", "deal", own(F.col("deal"))).alias("block"), "id").join(told, "id").select("block", "id", *rest)))
    many = sized.filter("blocks > 1")
    if many.isEmpty():
        return out
    found = checkpoint(components(out).select(F.col("node").alias("id"), "component"))
    parts = many.join(found, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    largest = checkpoint(parts.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").select("key", "most"))
    open_ = parts.join(largest, "key").withColumn("own", own(F.lit(2))).withColumn("outside", F.col("part") != F.col("most"))
    # those outside are many where few link: they are dealt over groups too, and each block meets one group at a time
    groups = checkpoint(open_.filter("outside").groupBy("key").agg(F.ceil(F.count("*") / (run // 2)).cast("int").alias("groups")))
    dealt = open_.join(groups, "key").withColumn("mine", F.pmod(F.xxhash64("id", "key", F.lit(3)), "groups").cast("int"))
    at = lambda block, group: F.struct(block.alias("block"), group.alias("group"))
    here = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: at(F.col("own"), g))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")), lambda k: at(k, F.col("mine")))
    again = dealt.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(here, others)).otherwise(here)))
    return out.union(checkpoint(compare(again.select(F.xxhash64("key", F.lit(2), "at").alias("block"), "id").join(told, "id").select("block", "id", *rest))))


def linked(rows: DataFrame, prints: DataFrame, most: int, run: int) -> DataFrame:
    """Links (a, b) that span every group of ids within `most` bits among rows (key, id, prints...); `prints` (id, prints...) once each."""
    met = checkpoint(meet(rows, most, run))
    late = met.filter("late").select(F.col("a").alias("key"), F.col("b").alias("id"))
    # a group meets under many keys, and each task gives a forest of its own: fewer tasks join these before they go on
    found = met.filter("not late").select("a", "b").coalesce(max(4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))
    if late.isEmpty():
        return found
    return found.union(in_blocks(late, prints, lambda x: meet(x.withColumnRenamed("block", "key"), most, None).select("a", "b"), run))


def links(fps: DataFrame, run: int = RUN) -> DataFrame:
    """Links (a, b) that span every group of distinct fingerprints within MOST_BITS of each other."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            held = batch.column(0).to_numpy()
            for low in range(0, len(held), 4096):
                part = held[low : low + 4096]
                keys, at = golay_keys(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], ["key", "id"])

    ids = fps.select(F.col("fp").alias("id"))
    return linked(ids.mapInArrow(lean(explode), "key int, id long"), ids, MOST_BITS, run)


def near_duplicates(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of each row of `docs`."""
    marked = checkpoint(fingerprints(docs))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, run)).select(F.col("node").alias("fp"), "component")
    named = checkpoint(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = checkpoint(named.groupBy("component").agg(F.min("least").alias("component_id")))
    by_fp = checkpoint(named.join(least, "component").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(line, SEED), np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return np.unique(np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[size - 1 :], strict=True)]), np.uint64))


class Margins:
    """How clearly each bit of a set's fingerprint is one or zero, and what its segments decode to."""

    BITS = 23 * PARTS

    def __init__(self) -> None:
        golay, index = Golay(), np.arange(4096) << 11
        self.codewords = ((((index | golay.syndrome(index))[:, None] >> np.arange(23)) & 1) * 2 - 1).T.astype(np.float32)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Ones less zeros of each bit; a hash gives all bits by mixing it again."""
        ones = np.zeros(self.BITS, np.int64)
        for low in range(0, len(hashes), 2048):
            x, words = hashes[low : low + 2048], []
            for _ in range(-(-self.BITS // 64)):
                words.append(x)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(29)
            raw = np.stack(words, axis=1).view(np.uint8)
            ones += np.unpackbits(raw, axis=1, count=self.BITS).sum(axis=0, dtype=np.int32)
        return 2 * ones - len(hashes)

    def decoded(self, sums: np.ndarray) -> np.ndarray:
        """Indices of the NEAREST codewords of each row's segments, as [row, segment, codeword]."""
        rows, out = sums.reshape(-1, 23).astype(np.float32), []
        for low in range(0, len(rows), 512):
            out.append(np.argpartition(rows[low : low + 512] @ self.codewords, 4096 - NEAREST, axis=1)[:, -NEAREST:])
        return np.concatenate([np.empty((0, NEAREST), np.int64), *out]).reshape(-1, PARTS, NEAREST)

    def prints(self, sums: np.ndarray) -> np.ndarray:
        """128 bits of each fingerprint, as two longs."""
        return np.packbits(sums[:, :128] > 0, axis=1).view(np.int64)


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sorted sets with a Jaccard similarity of `least` or more.

    Hashes are spread evenly, so ranges of them hold about VALUES values of all sets each: what is in memory beside the sets doesn't grow
    with the texts' lengths.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    parts, width, common = max(1, -(-int(sizes.sum()) // VALUES)), max(64, (1 << 22) // m), np.zeros((m, m))
    starts = np.zeros(m, np.int64)
    for k in range(1, parts + 1):
        ends = sizes if k == parts else np.array([np.searchsorted(s, np.uint64((k << 64) // parts)) for s in sets], np.int64)
        owner = np.repeat(np.arange(m, dtype=np.int32), ends - starts)
        at, counts = np.unique(np.concatenate([s[i:j] for s, i, j in zip(sets, starts, ends, strict=True)]), return_inverse=True, return_counts=True)[1:]
        starts, many = ends, counts > 1
        owner, at = owner[many[at]], (np.cumsum(many) - 1)[at[many[at]]]
        by = np.argsort(at, kind="stable")
        owner, at, distinct = owner[by], at[by], int(many.sum())
        for low in range(0, distinct, width):
            part = slice(*np.searchsorted(at, (low, low + width)))
            held = np.zeros((m, min(width, distinct - low)), np.float32)
            held[owner[part], at[part] - low] = 1
            common += held @ held.T
    whole = (sizes[:, None] + sizes - common).astype(np.float64)
    return np.nonzero(np.triu(common / np.maximum(whole, 1) >= least, 1))


def marked_sets(docs: DataFrame) -> DataFrame:
    """row, doc_id, node (a hash of the set), its print (p, q) and the codewords of its segments, of `docs` (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        margins = Margins()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                nodes, sums = np.empty(part.num_rows, np.uint64), np.empty((part.num_rows, Margins.BITS), np.int64)
                for k, text in enumerate(part.column(2)):
                    found = shingles(text.as_py())
                    nodes[k], sums[k] = xxhash.xxh3_64_intdigest(found.tobytes(), SEED), margins.sums(found)
                prints = margins.prints(sums)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(margins.decoded(sums).ravel().astype(np.int16)), PARTS * NEAREST).cast(pa.list_(pa.int16()))
                columns = (part.column(0), part.column(1), pa.array(nodes.view(np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), codes)
                yield pa.RecordBatch.from_arrays(list(columns), ["row", "doc_id", "node", "p", "q", "codes"])

    return docs.select("row", F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(lean(run), "row long, doc_id long, node long, p long, q long, codes array<short>")


def segment_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, p, q for each pair of codewords of two segments."""
    pairs = [(i, j) for i in range(PARTS) for j in range(i + 1, PARTS)]
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            codes = part.column(3).flatten().to_numpy().reshape(-1, PARTS, NEAREST).astype(np.int32)
            keys = [(n << 24) + (codes[:, i, :, None] << 12) + codes[:, j, None, :] for n, (i, j) in enumerate(pairs)]
            keys = np.stack(keys, axis=1).reshape(part.num_rows, -1)
            columns = [np.repeat(part.column(k).to_numpy(), keys.shape[1]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), *map(pa.array, columns)], ["key", "id", "p", "q"])


def compared(dealt: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that span what is similar among the ids of each block; `dealt` (block, id, row), `texts` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids, sets = np.empty(0, np.int64), np.empty(0, np.int64), []

        def settle(n: int) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.r_[True, blocks[1:n] != blocks[: n - 1], True]) if n else np.zeros(1, np.int64)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if high - low > 1:
                    i, j = similar(sets[low:high], least)
                    a, b = forest(ids[low + i], ids[low + j])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                blocks, ids = np.r_[blocks, part.column(0).to_numpy()], np.r_[ids, part.column(1).to_numpy()]
                sets += [shingles(x.as_py()) for x in part.column(2)]
                last = int(np.searchsorted(blocks, blocks[-1]))  # the last block may go on
                yield from settle(last)
                blocks, ids, sets = blocks[last:], ids[last:], sets[last:]
        yield from settle(len(blocks))

    rows = dealt.join(texts, "row").select("block", "id", "text")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(lean(run), "a long, b long")


def similar_links(nodes: DataFrame, texts: DataFrame, least: float = LEAST, run: int = RUN, sets: int = SETS) -> DataFrame:
    """Links (a, b) among `nodes` (node, row, p, q, codes) whose sets are similar; `texts` holds the text of each row."""
    ids = nodes.select(F.col("node").alias("id"), "p", "q")
    rows = nodes.select(F.col("node").alias("id"), "p", "q", "codes").mapInArrow(lean(segment_keys), "key int, id long, p long, q long")
    groups = components(linked(rows, ids, CHECKED, run))
    members = checkpoint(groups.select(F.col("node").alias("id"), F.col("component").alias("key")).join(nodes.select(F.col("node").alias("id"), "row"), "id"))
    needed = texts.filter(among(members.select(F.xxhash64("row").alias("x")), F.xxhash64("row"))).select("row", "text")
    return in_blocks(members.select("key", "id"), members.select("id", "row"), lambda x: compared(x, needed, least), sets)


def keep_one(docs: DataFrame, least: float = LEAST, run: int = RUN, sets: int = SETS) -> DataFrame:
    """One row of `docs` of each group of near copies: of those with the smallest doc_id the first; one without an id if none has any."""
    numbered = stored(docs.withColumn("near_copy_row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col("near_copy_row").alias("row"), text_bytes().alias("text"))
    found = stored(marked_sets(numbered.select(F.col("near_copy_row").alias("row"), "doc_id", "text")), "marked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    nodes = stored(found.groupBy("node").agg(first.alias("first"), F.min(F.struct("row", "p", "q", "codes")).alias("at")).select("node", "first", "at.*"), "nodes")
    joined = nodes.select("node", "first").join(components(similar_links(nodes, texts, least, run, sets)), "node", "left")
    kept = joined.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("near_copy_row"))
    return numbered.join(kept, "near_copy_row", "left_semi").select(*docs.columns)
