"""Language-model scoring with an Elias-Fano n-gram trie (operator 3).

A text is the cycle END w1 .. wn END, so each token stands once on the left of a pair and pair counts hold all
counts. Pairs are counted by chunk before they are dealt, by the hash of their left word, to shards. A shard is a
trie of two levels: sorted word names with counts, quantised back-off weights and monotone pointers, and below each
word the sorted names of its successors (counted twice or more) with quantised discounted probabilities. Names and
pointers are Elias-Fano sequences; successors are searched within the range of their context. The shards form one
file, which workers map into memory, so what a worker holds is what it touches.

    p(w | u) = seen(u, w) + backoff(u) * (c(w) + 1) / (N + V + 1)

where seen is (c(u, w) - D) / c(u) and backoff the mass left. Codes round down, so probabilities add up to 1 at most.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held_out, mixed, partitions, scratch, split_words, stored

END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))
CHUNK = 2_000_000  # tokens counted before they are dealt
_SELECT = np.array([[next((b for b in range(8) if bin(x & ((2 << b) - 1)).count("1") == k + 1 and x >> b & 1), 8) for k in range(8)] for x in range(256)], np.uint8)
#: Of the Python worker, which later tasks of a stage find filled.
_HASHES = WordHashes(800_000)
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _aligned(parts: list[np.ndarray]) -> bytes:
    out = []
    for p in parts:
        b = np.ascontiguousarray(p).tobytes()
        out.append(b + bytes(-len(b) % 8))
    return b"".join(out)


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high bits unary with a count a byte block."""

    BLOCK = 8  # bytes of the unary part that share one count

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = min(low, 56)
        v = values.astype(np.uint64)
        high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) + 8) // 8 if n else 0
        size = -(-size // EliasFano.BLOCK) * EliasFano.BLOCK
        bits = np.zeros(size * 8, np.uint8)
        bits[high] = 1
        unary = np.packbits(bits, bitorder="little")
        counts = np.cumsum(np.r_[0, _ONES[unary].reshape(-1, EliasFano.BLOCK).sum(axis=1, dtype=np.int64)]).astype(np.uint32) if size else np.zeros(1, np.uint32)
        width = -(-low // 8)  # whole bytes: read without shifts
        lows = (v & np.uint64((1 << low) - 1)).view(np.uint8).reshape(n, 8)[:, :width] if n else np.empty((0, width), np.uint8)
        return _aligned([np.array([n, low, size, len(counts)], np.uint64), unary, counts, lows])

    def __init__(self, data: np.ndarray, at: int):
        self.n, self.low, size, blocks = (int(x) for x in data[at : at + 32].view(np.uint64))
        at += 32
        self.unary = data[at : at + size]
        at += size
        self.counts = data[at : at + 4 * blocks].view(np.uint32)
        at += -(-4 * blocks // 8) * 8
        self.width = -(-self.low // 8)
        self.lows = data[at : at + self.n * self.width].reshape(self.n, self.width)
        self.end = at + -(-self.n * self.width // 8) * 8

    def get(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.counts, i.astype(np.uint32), side="right") - 1
        left = (i - self.counts[block]).astype(np.int64)
        bytes_ = self.unary.reshape(-1, self.BLOCK)[block]
        ones = _ONES[bytes_]
        inside, before, ahead = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for b in range(self.BLOCK - 1):  # how many whole bytes come before the wanted one
            ahead += ones[:, b]
            passed = ahead <= left
            inside += passed
            before = np.where(passed, ahead, before)
        bit = _SELECT[bytes_[np.arange(len(i)), inside], left - before].astype(np.int64)
        high = (block * self.BLOCK + inside) * 8 + bit - i
        low = np.zeros(len(i), np.uint64)
        for b in range(self.width):
            low |= self.lows[i, b].astype(np.uint64) << np.uint64(8 * b)
        return high.astype(np.uint64) << np.uint64(self.low) | low

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, span: float) -> np.ndarray:
        """Place of each x within [lo, hi), or -1. Values of a range are spread evenly over [least, least + span), so
        all are searched at once by interpolation, with a halving in every third step as a safeguard."""
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(lo < hi)
        x, lo, hi, base = x[live], lo[live].astype(np.int64), hi[live].astype(np.int64), least[live]
        at = (x - base).astype(np.float64)
        left, right = np.zeros(len(x)), np.full(len(x), span)
        step = 0
        while len(live):
            step += 1
            share = 0.5 if step % 3 == 0 else np.clip((at - left) / np.maximum(right - left, 1.0), 0.0, 1.0)
            mid = np.minimum(lo + ((hi - lo) * share).astype(np.int64), hi - 1)
            got = self.get(mid)
            hit = got == x
            out[live[hit]] = mid[hit]
            less = got < x
            value = (got - base).astype(np.float64)
            lo, left = np.where(less, mid + 1, lo), np.where(less, value, left)
            hi, right = np.where(less, hi, mid), np.where(less, right, value)
            on = np.flatnonzero(~hit & (lo < hi))
            live, x, lo, hi, base, at, left, right = live[on], x[on], lo[on], hi[on], base[on], at[on], left[on], right[on]
        return out


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(book of 256 ascending values, code of each value): the largest entry that is not above it."""
    if not len(values):
        return np.zeros(256), np.zeros(0, np.uint8)
    book = np.quantile(values, np.linspace(0, 1, 256), method="lower")
    return book, (np.searchsorted(book, values, side="right") - 1).astype(np.uint8)


def _successor(w: np.ndarray) -> np.ndarray:
    """32-bit name of a word below its context."""
    return mixed(w ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)


#: Of each shard's words: where those begin whose next bits are 0, 1, 2, ...
DIRECTORY_BITS = 12
DIRECTORY = 1 << DIRECTORY_BITS


def pack_shard(u: np.ndarray, w: np.ndarray, c: np.ndarray, bits: int, min_count: int = 1) -> tuple[bytes, int, int]:
    """(bytes, tokens, words) of a shard from its sorted distinct pairs and counts."""
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.empty(0, np.int64)
    total = np.add.reduceat(c, first) if len(u) else np.empty(0, np.int64)
    keep = c >= min_count
    n1, n2 = int((c == 1).sum()), int((c == 2).sum())
    discount = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))
    size = np.diff(np.r_[first, len(u)])
    context = np.repeat(np.arange(len(first)), size)[keep]
    seen = (c[keep] - discount) / total[context]
    name = _successor(w[keep])
    order = np.lexsort((name, context))
    context, name, seen = context[order], name[order], seen[order]
    children = np.bincount(context, minlength=len(first))
    backoff = 1 - np.bincount(context, weights=seen, minlength=len(first))
    seen_book, seen_code = _codes(np.log10(seen))
    back_book, back_code = _codes(np.log10(np.maximum(backoff, 1e-12)))
    names = EliasFano.pack(u[first], 1 << 64)
    pointers = EliasFano.pack(np.r_[0, np.cumsum(children)], int(children.sum()) + 1)
    below = EliasFano.pack((context.astype(np.uint64) << np.uint64(32)) | name, max(len(first), 1) << 32)
    edges = np.searchsorted(u[first] << np.uint64(bits), np.arange(DIRECTORY, dtype=np.uint64) << np.uint64(64 - DIRECTORY_BITS)) if len(first) else np.zeros(DIRECTORY)
    directory = np.r_[edges, len(first)].astype(np.uint32)
    head = _aligned([np.array([len(first), len(seen)], np.uint64), directory, seen_book, back_book, total.astype(np.uint64), back_code, seen_code])
    return head + names + pointers + below, int(total.sum()), len(first)


class Shard:
    def __init__(self, data: np.ndarray, at: int, bits: int):
        self.bits = np.uint64(bits)
        n, m = (int(x) for x in data[at : at + 16].view(np.uint64))

        def take(kind: str, k: int):
            nonlocal at
            size = np.dtype(kind).itemsize * k
            out = data[at : at + size].view(kind)
            at += -(-size // 8) * 8
            return out

        at += 16
        self.directory = take("u4", DIRECTORY + 1)
        self.seen_book, self.back_book = take("f8", 256), take("f8", 256)
        self.counts, self.back, self.seen = take("u8", n), take("u1", n), take("u1", m)
        self.names = EliasFano(data, at)
        self.pointers = EliasFano(data, self.names.end)
        self.below = EliasFano(data, self.pointers.end)

    def word(self, u: np.ndarray) -> np.ndarray:
        part = (u << self.bits >> np.uint64(64 - DIRECTORY_BITS)).astype(np.int64)
        width = 64 - int(self.bits) - DIRECTORY_BITS
        return self.names.find(u, self.directory[part], self.directory[part + 1], u >> np.uint64(width) << np.uint64(width), 2.0**width)

    def pair(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Probability of the successor among those seen, 0 if it isn't one."""
        lo, hi = self.pointers.get(context).astype(np.int64), self.pointers.get(context + 1).astype(np.int64)
        own = context.astype(np.uint64) << np.uint64(32)
        at = self.below.find(own | _successor(w), lo, hi, own, 2.0**32)
        return np.where(at >= 0, 10.0 ** self.seen_book[self.seen[np.maximum(at, 0)]] if len(self.seen) else 0.0, 0.0)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them; only the distinct ones are sorted."""
    codes, own = pd.factorize(values)
    order = np.argsort(own, kind="stable")
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    return own[order], place[codes]


class Model:
    """All shards of one mapped file; ``offsets`` by shard, a shard being the top bits of a word's hash."""

    def __init__(self, path: str, offsets: dict[int, int], bits: int, tokens: int, words: int, min_count: int = 1):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray) if offsets else None
        self.shards = {s: Shard(data, at, bits) for s, at in offsets.items()}
        self.shift, self.tokens, self.words, self.min_count = np.uint64(64 - bits), tokens, words, min_count

    def score(self, texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        seqs = [hashes.of(split_words(t, lower=True)) for t in texts]
        size = np.array([len(s) + 1 for s in seqs])
        nxt = np.concatenate([np.r_[s, END] for s in seqs])
        prv = np.concatenate([np.r_[END, s] for s in seqs])
        vocab, of = _ranked(np.concatenate([nxt, prv]))
        wi, ui = of[: len(nxt)], of[len(nxt) :]
        count, place = np.zeros(len(vocab)), np.full(len(vocab), -1, np.int64)
        backoff = np.ones(len(vocab))
        shard = (vocab >> self.shift).astype(np.int64)
        edges = np.searchsorted(shard, np.arange(int(shard[-1]) + 2))
        for s in np.unique(shard).tolist():
            if s in self.shards:
                own, part = slice(edges[s], edges[s + 1]), self.shards[s]
                place[own] = at = part.word(vocab[own])
                count[own] = np.where(at >= 0, part.counts[np.maximum(at, 0)], 0)
                backoff[own] = np.where(at >= 0, 10.0 ** part.back_book[part.back[np.maximum(at, 0)]], 1.0)
        uni = (count + 1) / (self.tokens + self.words + 1)
        pairs, back = _ranked(ui.astype(np.int64) * len(vocab) + wi)
        pu, pw = np.divmod(pairs, len(vocab))
        seen = np.zeros(len(pairs))
        edges = np.searchsorted(shard[pu], np.arange(int(shard[-1]) + 2))
        for s in np.unique(shard[pu]).tolist():
            if s in self.shards:
                own = np.arange(edges[s], edges[s + 1])
                own = own[(place[pu[own]] >= 0) & (np.minimum(count[pu[own]], count[pw[own]]) >= self.min_count)]
                if len(own):
                    seen[own] = self.shards[s].pair(place[pu[own]], vocab[pw[own]])
        p = np.log10(seen + backoff[pu] * uni[pw])[back]
        starts = np.cumsum(np.r_[0, size[:-1]])
        return size, np.add.reduceat((count[wi] > 0).astype(np.int64), starts), np.add.reduceat(np.log10(uni)[wi], starts), np.add.reduceat(p, starts)


def _distinct(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, u))
    u, w, c = u[order], w[order], c[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    return u[first], w[first], np.add.reduceat(c, first)


def _counted(bits: int):
    """(shard, blob): distinct pairs of a chunk with counts; left words once, with the length of their run."""

    def deal(seqs):
        u = np.concatenate([np.r_[END, s] for s in seqs])
        w = np.concatenate([np.r_[s, END] for s in seqs])
        u, w, c = _distinct(u, w, np.ones(len(u), np.int64))
        shard = (u >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        out = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            own = u[lo:hi]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            run = np.diff(np.r_[first, len(own)]).astype(np.uint32)
            small = zlib.compress(run.tobytes() + c[lo:hi].astype(np.uint32).tobytes(), 1)
            out.append((int(shard[lo]), len(first), hi - lo, own[first].tobytes() + w[lo:hi].tobytes() + small))
        return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["shard", "left", "pairs", "blob"])

    def run(batches):
        hashes, seqs, n = _HASHES, [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seqs.append(hashes.of(split_words(t, lower=True)))
                n += len(seqs[-1]) + 1
                if n >= CHUNK:
                    yield deal(seqs)
                    seqs, n = [], 0
        if seqs:
            yield deal(seqs)

    return run


def _tries(bits: int, min_count: int):
    """Rows sorted by shard, streamed; a shard's pairs are merged as they come. Out: its trie."""

    def run(batches):
        shard, held, n = None, [], 0

        def merge():
            u, w, c = (np.concatenate(x) for x in zip(*held))
            return _distinct(u, w, c)

        def out():
            blob, tokens, words = pack_shard(*merge(), bits, min_count)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([tokens], pa.int64()), pa.array([words], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "tokens", "words", "trie"])

        for batch in batches:
            for s, left, pairs, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s != shard:
                    if held:
                        yield out()
                    shard, held, n = s, [], 0
                small = zlib.decompress(blob[8 * (left + pairs) :])
                run_ = np.frombuffer(small, np.uint32, left)
                held.append((np.repeat(np.frombuffer(blob, np.uint64, left), run_), np.frombuffer(blob, np.uint64, pairs, 8 * left), np.frombuffer(small, np.uint32, pairs, 4 * left).astype(np.int64)))
                n += pairs
                if n > 3_000_000:
                    held = [merge()]
                    n = len(held[0][0]) // 2
        if held:
            yield out()

    return run


def train(rows: DataFrame, min_count: int = 1) -> tuple[str, dict[int, int], int, int, int]:
    """(file, offset of each shard, bits of a shard's number, tokens, words) from a column of texts. The driver
    streams one trie at a time into the file; it stands in the shared folder if workers can map that, else it goes to
    the executors as a Spark file."""
    spark = rows.sparkSession
    bits = max(4, (2 * partitions(spark) - 1).bit_length())
    counted = rows.mapInArrow(_counted(bits), "shard int, left int, pairs int, blob binary")
    tries = counted.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(_tries(bits, min_count), "shard int, tokens long, words long, trie binary")
    tries = stored(tries, "tries")
    path = scratch(spark, "trie")
    shared = path.startswith("file:")
    local = path.split(":", 1)[1] if shared else os.path.join(SparkFiles.getRootDirectory(), os.path.basename(path))
    local = "/" + local.lstrip("/")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    offsets, tokens, words, at = {}, 0, 0, 0
    with open(local, "wb") as f:
        for row in tries.orderBy("shard").toLocalIterator():
            offsets[row.shard] = at
            at += f.write(row.trie)
            tokens += row.tokens
            words += row.words
    if not shared:
        spark.sparkContext.addFile(local)
    return local if shared else os.path.basename(local), offsets, bits, tokens, words


def _slices(texts: list, chars: int):
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_count: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from every row whose crc32(doc_id) mod 7 is not 2. Null texts count as empty: one token, the end. Without
    rows to learn from all scores are 0. Repeated rows count as often as they stand."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, 7, 2).alias("held_out"), F.col(text).alias("text"))
    path, offsets, bits, tokens, words = train(rows.where(~F.col("held_out")).select("text"), min_count)

    def run(batches):
        model = Model(path if os.path.isabs(path) else SparkFiles.get(path), offsets, bits, tokens, words, min_count)
        hashes = _HASHES
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts = [model.score(texts[lo:hi], hashes) for lo, hi in _slices(texts, 4_000_000)]
            if not parts:
                continue
            n, known, base, score = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
