"""Substring dedup with suffix automata of reference shards (operator 2).

A window is ``length`` consecutive words. Among the 10-word grams of a window the one with the least hash is its
anchor; equal windows have equal anchors, so repeats can only meet at an anchor that occurs twice. Windows in a row
with one anchor make a segment.

1. Count anchors over the whole corpus. Anchors that occur once are done with. Where all segments of an anchor are
   equal, each of their windows repeats.
2. Segments of the other anchors are the reference. They are dealt by anchor into shards of bounded size; a shard's
   distinct segments build a suffix automaton, then stream through it for their matching statistics. A match of
   ``length`` words ends in the state of just that word sequence, where occurrences are added up.
3. Windows counted twice or more go back to their texts, which lose every word these cover.

An automaton of the whole corpus cannot be broadcast, so shards meet the segments that could match them in a shuffle;
only Bloom filters of fixed size are broadcast, and a false positive there costs a row, never a result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, merged, mixed, partitions, signed, split_words, stored, window_hashes

GRAM = 10
BLOOM_BITS = 1 << 24
HOT = 2048  # occurrences of an anchor from which its windows are dealt singly
SHARD_WORDS = 150_000


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the first of equals."""
    at, low, span = np.arange(len(g)), g, 1
    while span < width:
        step = min(span, width - span)
        take = low[step:] < low[: len(low) - step]
        at = np.where(take, at[step:], at[: len(at) - step])
        low = np.where(take, low[step:], low[: len(low) - step])
        span += step
    return at


def segments(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, first window, number of windows) of each segment, and all window hashes."""
    if len(h) < length:
        e = np.empty(0, np.uint64)
        return e, e, np.empty(0, np.int64), np.empty(0, np.int64), e
    g = window_hashes(h, GRAM)
    at = _least(g, length - GRAM + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    f = window_hashes(h, length)
    with np.errstate(over="ignore"):
        name = mixed(f[first] + np.uint64(3) * mixed(f[first + count - 1]) + count.astype(np.uint64) + (at[first] - first).astype(np.uint64) * np.uint64(0x51ED270B))
    return g[at[first]], name, first, count, f


def _anchors(length: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            a, s = [], []
            for t in batch.column(0).to_pylist():
                anchor, name, *_ = segments(hashes.of(split_words(t)), length)
                a.append(anchor)
                s.append(name)
            if not a:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(a))), pa.array(signed(np.concatenate(s)))], names=["anchor", "segment"])

    return run


def _places(keys: np.ndarray) -> np.ndarray:
    h = mixed(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
    m = np.uint64(BLOOM_BITS - 1)
    return np.stack([h & m, (h >> np.uint64(24)) & m, h >> np.uint64(40)]).astype(np.int64)


def _bloom(batches):
    """Three filters in one: all repeated anchors, those with several segments, those dealt by window."""
    bits = np.zeros((3, BLOOM_BITS // 8), np.uint8)
    for batch in batches:
        keys, one, total = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for row, own in enumerate((keys, keys[~one.astype(bool)], keys[~one.astype(bool) & (total > HOT)])):
            at = _places(own.astype(np.int64)).ravel()
            np.bitwise_or.at(bits[row], at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([int(bits.sum()) & 0xFFFF], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "blob"])


def _in(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7) & 1).all(axis=0)


_SEGMENTS = "anchor long, segment long, key long, key2 int, at int, n_windows int, copies long, salt long, window int, words binary"


def _found(shared, length: int):
    """Of texts (once a batch, with their number): where repeated anchors stand, and the words of segments that need
    the automaton (32-bit word names, once a task)."""

    def run(batches):
        bits, hashes, seen = shared.value.reshape(3, -1), WordHashes(), set()
        for batch in batches:
            texts: dict[tuple, list] = {}
            for key, key2, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                texts.setdefault((key, key2), [t, 0])[1] += 1
            rows = []
            for (key, key2), (t, copies) in texts.items():
                h = hashes.of(split_words(t))
                anchor, name, first, count, f = segments(h, length)
                if not len(anchor):
                    continue
                at = _places(anchor)
                many, hot = _in(bits[1], at), _in(bits[2], at)
                anchor_, name_ = signed(anchor).tolist(), signed(name).tolist()
                for i in np.flatnonzero(_in(bits[0], at)).tolist():
                    a, s, lo, n = anchor_[i], name_[i], int(first[i]), int(count[i])
                    rows.append((a, s, key, key2, lo, n, copies, None, None, None))
                    if many[i] and (a, s) not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add((a, s))
                        w = h[lo : lo + n + length - 1].astype(np.uint32)
                        if hot[i]:
                            salts = signed(f[lo : lo + n]).tolist()
                            rows += [(a, s, None, None, None, n, None, salts[j], j, w[j : j + length].tobytes()) for j in range(n)]
                        else:
                            rows.append((a, s, None, None, None, n, None, 0, 0, w.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _TYPES)], names=_NAMES)

    return run


_NAMES = [x.split()[0] for x in _SEGMENTS.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _SEGMENTS.split(", ")]


class SuffixAutomaton:
    """Of many sequences: each is added from the root."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list[int]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:  # known from an earlier sequence
                if size[q] == size[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def states(self, words: list[int], length: int) -> list[int]:
        """Matching statistics cut at ``length``: for each end from the first full window on, the state of the
        ``length`` words before it, or -1."""
        nxt, link, size = self.next, self.link, self.size
        at, got, out = 0, 0, []
        for i, c in enumerate(words):
            while at and c not in nxt[at]:
                at = link[at]
                got = size[at]
            if c in nxt[at]:
                at = nxt[at][c]
                got += 1
            if got > length:
                got = length
            while at and size[link[at]] >= length:
                at = link[at]
            if i + 1 >= length:
                out.append(at if got == length else -1)
        return out


def repeats(rows: list[tuple[list[int], int]], length: int) -> list[int]:
    """Of segments (words, occurrences): a bit for each window that occurs twice or more among all of them."""
    automaton = SuffixAutomaton()
    for words, _ in rows:
        automaton.add(words)
    counts = [0] * len(automaton.next)
    ends = []
    for words, n in rows:
        s = automaton.states(words, length)
        ends.append(s)
        for x in s:
            if x >= 0:
                counts[x] += n
    return [sum(1 << i for i, x in enumerate(s) if x >= 0 and counts[x] > 1) for s in ends]


def _shards(length: int):
    """Rows sorted by (anchor, salt): shards end between anchors. Out: (anchor, segment, mask)."""

    def run(batches):
        held, words, key = [], 0, None

        def out():
            masks = repeats([(r[3], r[4]) for r in held], length)
            kept = [(r[0], r[1], m << r[2]) for r, m in zip(held, masks) if m]
            held.clear()
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["anchor", "segment", "mask"])

        for batch in batches:
            for anchor, salt, segment, window, n, blob in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (anchor, salt) != key:
                    if words >= SHARD_WORDS:
                        yield from out()
                        words = 0
                    key = (anchor, salt)
                own = np.frombuffer(blob, np.uint32).tolist()
                held.append((anchor, segment, window, own, n))
                words += len(own)
        yield from out()

    return run


def _kept(length: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = split_words(t)
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        at, mask = s["at"], s["mask"]
                        while mask:
                            low = mask & -mask
                            i = at + low.bit_length() - 1
                            edge[i] += 1
                            edge[i + length] -= 1
                            mask ^= low
                    covered = np.cumsum(edge[:-1]) > 0
                    n_removed.append(int(covered.sum()))
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, length: int = 35, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).
    ``length`` is 11 to 64 words.

    Every word covered by a window that starts anywhere else too is removed; windows are judged on the input. Null
    texts have no words; texts shorter than a window lose none. All copies lose what they share, repeated rows too.
    Very long texts are read whole. No rows give no rows. Other columns are not read, whatever their names."""
    if not GRAM < length <= 64:
        raise ValueError("length must be from 11 to 64 words")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    anchors = rows.select("text").mapInArrow(_anchors(length), "anchor long, segment long")
    twice = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), F.min("segment").alias("x"), F.max("segment").alias("y")).where("total > 1")
    twice = stored(twice.select("anchor", F.expr("x = y").alias("one"), "total"), "anchors")
    bits = spark.sparkContext.broadcast(merged(twice.mapInArrow(_bloom, "part int, blob binary"), "uint8", "or", 3 * BLOOM_BITS // 8))

    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), F.hash("text").alias("key2"))
    found = stored(keyed.select("key", "key2", "text").mapInArrow(_found(bits, length), _SEGMENTS), "segments")
    where = found.where("words is null").select("anchor", "segment", "key", "key2", "at", "n_windows", "copies")
    words = found.where("words is not null").select("anchor", "segment", "salt", "window", "words").dropDuplicates(["anchor", "segment", "window"])
    times = where.groupBy("anchor", "segment").agg(F.sum("copies").alias("n"))
    reference = words.join(times, ["anchor", "segment"]).join(twice.where("not one").select("anchor"), "anchor").select("anchor", "salt", "segment", "window", "n", "words")
    masks = reference.repartition(partitions(spark), "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_shards(length), "anchor long, segment long, mask long")
    masks = stored(masks.groupBy("anchor", "segment").agg(F.bit_or("mask").alias("mask")), "masks")

    all_windows = F.expr("shiftleft(1L, n_windows) - 1")
    spans = where.select("anchor", "segment", "key", "key2", "at", "n_windows").distinct()
    whole = spans.join(twice.where("one").select("anchor"), "anchor").select("key", "key2", "at", all_windows.alias("mask"))
    part = spans.join(masks, ["anchor", "segment"]).select("key", "key2", "at", "mask")
    by_text = whole.unionByName(part).groupBy("key", "key2").agg(F.collect_list(F.struct("at", "mask")).alias("spans"))
    joined = keyed.join(by_text.hint("shuffle_hash"), ["key", "key2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept string")
