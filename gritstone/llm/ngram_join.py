"""N-gram Jaccard join by prefix trees (operator 7), and near-duplicate groups from its links.

1. Each text becomes a set of 64-bit shingle hashes; equal sets are one node from here on.
2. A sketch of fixed size counts shingles over the whole corpus. A set is ordered by class, the rank of a shingle's
   cell in the sketch, then by hash: any one order is right for prefix filtering, this one keeps boilerplate out of
   prefixes. The class is the high byte of a shingle's name, so to sort a set is to order it.
3. Two sets that link share a shingle among the first n - ceil(3n/4) + 1 of each. These postings (shingle, node, size,
   position) are dealt by shingle, once. A pair whose first common shingle stands at positions i and j overlaps in
   min(nx - i, ny - j) at most and needs 3/7 (nx + ny). So with reach u = 7/3 (n - position) - n a pair is open only
   if nx <= uy and ny <= ux. Blocks of few sets name their pairs. Blocks of many connect what is open without pairs:
   these conditions are intervals, which one sweep in order of size joins. Postings of one scan that are alike (same
   shingle, size and position) leave it as one if they are many, so a shingle that a third of all rows hold does not
   gather in one task.
4. Prefixes of sets that link share many shingles, not one: of the prefix that ends first, all but n - need stand in
   the other too. A pair that shares fewer, even if all its shingles in large blocks were shared, is dropped.
5. Nodes that pairs and large blocks connect form a family. A family of bounded size is joined in one task, to which
   its texts move: each set is held against earlier sets that share a prefix shingle and are not connected with it
   yet, in a prefix tree.
6. Larger families go through rounds: their pairs are tested, and each large block whose nodes are not yet connected
   names leaders by a hash; a leader's set is held against the others' sets, which lie in a prefix tree, and leaves
   the block. Their number grows fourfold a round. No open pair of two components stays untested, so no link that
   joins components is lost; pairs within a component need no test.

FEW, FAMILY, CHUNK and the growth of leaders move work between tasks and rounds; they change no result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, lower_word_hashes, merged, mixed, partitions, signed, stored

WIDTH = 5
SKETCH = 1 << 18
CHUNK = 2048  # sets in one prefix tree
FAMILY = 6000  # nodes, and a thousand times as many shingles, that one task joins
FEW = 16  # sets of a block that names its pairs
POSTINGS = 400_000  # of one scan that are looked through for alike ones at a time


HASH = np.uint64((1 << 56) - 1)
_CELL = np.uint64(SKETCH - 1)


def shingle_sets(column: pa.Array, order: np.ndarray | None = None, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of an Arrow text column: the distinct shingle names of each row, ascending, end to end, and bounds. The
    high byte is the class by ``order``, 0 without it. ``counts`` gathers the shingles of all rows."""
    powers = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(WIDTH)]
    with np.errstate(over="ignore"):
        for h, bounds in lower_word_hashes(column):
            k = max(len(h) - WIDTH + 1, 0)
            windows = mixed(sum((h[i : i + k] * powers[i] for i in range(WIDTH)), np.zeros(k, np.uint64))) & HASH
            if counts is not None:
                counts += np.bincount((windows & _CELL).astype(np.int64), minlength=SKETCH)
            if order is not None:
                windows |= order[(windows & _CELL).astype(np.int64)]
            found = [h[:0]]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo >= WIDTH:
                    own = windows[lo : hi - WIDTH + 1]
                    own.sort()
                    found.append(own)
                elif hi > lo:
                    found.append(mixed((h[lo:hi] * powers[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)) & HASH)
                else:
                    found.append(h[:0])
            flat = np.concatenate(found)
            ends = np.cumsum([len(f) for f in found])
            new = np.ones(len(flat), bool)
            new[1:] = flat[1:] != flat[:-1]
            new[ends[ends < len(flat)]] = True
            yield flat[new], np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])[ends]


def order_of(counts: np.ndarray) -> np.ndarray:
    """The high byte of shingles by cell: 256 classes of equal size, by count."""
    out = np.empty(len(counts), np.uint64)
    out[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64) * np.uint64(256) // np.uint64(len(counts))
    return out << np.uint64(56)


def nodes_of(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One signed 64-bit name for each set, whatever the order; 0 for empty ones."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(flat & HASH))])
        sizes = np.diff(bounds)
        return np.where(sizes > 0, signed(mixed(np.diff(total[bounds]) + sizes.astype(np.uint64))), 0)


def needed(n: int) -> int:
    """Least overlap of a set of n in any link: ceil(3n / 4)."""
    return -(-3 * n // 4)


def _sets(batches):
    """doc rows (doc_id, node, n), and at the end of the task one row with its counts."""
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        nodes, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for flat, bounds in shingle_sets(batch.column(1), counts=counts):
            nodes.append(nodes_of(flat, bounds))
            sizes.append(np.diff(bounds))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.nulls(batch.num_rows, pa.binary())], names=["doc_id", "node", "n", "blob"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "node", "n", "blob"])


def _fresh(batches, column, order):
    """(node, set) of texts whose set no earlier text of the task has."""
    seen = set()
    for batch in batches:
        for flat, bounds in shingle_sets(batch.column(column), order):
            for node, lo, hi in zip(nodes_of(flat, bounds).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if lo < hi and node not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(node)
                    yield node, flat[lo:hi]


def _reach(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The largest partner that a set can still link with whose first common shingle stands at this position."""
    return 7 * (n - pos) // 3 - n


#: size: the set's size above the position in it, 32 bits each.
_POSTING = "tok long, size long, node long, alike long"


def _postings(shared):
    """Prefix postings. Of more than FEW alike ones, if they reach their own size, one names itself as ``alike`` and
    the others name it, too."""

    def run(batches):
        order, toks, nodes, sizes, held = shared.value, [], [], [], 0

        def out():
            k = [len(p) for p in toks]
            tok, node, n = np.concatenate(toks), np.repeat(np.array(nodes, np.int64), k), np.repeat(np.array(sizes, np.int64), k)
            pos = np.concatenate([np.arange(m) for m in k])
            size = n << 32 | pos
            at = np.lexsort((size, tok))
            tok, node, n, pos, size = tok[at], node[at], n[at], pos[at], size[at]
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (size[1:] != size[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(tok)), 0))
            at = np.flatnonzero(new)
            many = np.repeat(np.diff(np.r_[at, len(tok)]) > FEW, np.diff(np.r_[at, len(tok)]))
            own = ~many | (_reach(n, pos) < n)
            return pa.RecordBatch.from_arrays([pa.array(signed(tok)), pa.array(size), pa.array(node), pa.array(node[first], mask=own)], names=["tok", "size", "node", "alike"])

        for node, s in _fresh(batches, 0, order):
            toks.append(s[: len(s) - needed(len(s)) + 1])
            nodes.append(node)
            sizes.append(len(s))
            held += len(toks[-1])
            if held >= POSTINGS:
                yield out()
                toks, nodes, sizes, held = [], [], [], 0
        if toks:
            yield out()

    return run


def open_postings(tok, n, pos, node):
    """Of postings in order of (tok, n, node): the places of those with an open partner, and the node that connects
    each with its partners."""
    wide = np.int64(1) << np.int64(34)
    block = (np.cumsum(np.r_[True, tok[1:] != tok[:-1]]) - 1) * wide
    u = _reach(n, pos)
    at = np.flatnonzero(u >= n)
    if not len(at):
        return at, node[at]
    low, high = block[at] + n[at], np.maximum.accumulate(block[at] + u[at])
    part = np.cumsum(np.r_[True, low[1:] > high[:-1]]) - 1  # intervals [n, u] that overlap, block by block
    lead = node[at[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])]]
    other = np.flatnonzero(u < n)
    below = np.searchsorted(low, block[other] + u[other], side="right") - 1
    met = (below >= 0) & (high[np.maximum(below, 0)] >= block[other] + n[other])
    other = other[met]
    of = part[np.searchsorted(low, block[other] + n[other], side="right") - 1]
    at, part = np.concatenate([at, other]), np.concatenate([part, of])
    keep = np.bincount(part, minlength=len(lead))[part] > 1
    return at[keep], lead[part[keep]]


#: Kinds of rows. OPEN: an open posting of a large block, ``other`` connects it. PAIR: two nodes with their sizes, how
#: many shingles of small blocks they share, and in ``tok`` whether one of them is open. LARGE: how many postings
#: (``shared``) the node has in large blocks.
OPEN, PAIR, LARGE = range(3)
_BLOCK = "kind int, tok long, size long, node long, other long, size2 long, shared long"


def _rows(kind, tok, size, node, other, size2, shared):
    k = len(node)
    cols = [np.broadcast_to(np.asarray(c, np.int64), k) for c in (tok, size, node, other, size2, shared)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["kind", "tok", "size", "node", "other", "size2", "shared"])


def _summed(a: np.ndarray, b: np.ndarray, *what: np.ndarray) -> tuple:
    """Distinct (a, b), and for each of them the sums of the rest."""
    at = np.lexsort((b, a))
    a, b = a[at], b[at]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new], at[new], *(np.add.reduceat(w[at].astype(np.int64), new) for w in what)


def settled_blocks(tok, n, pos, node, alike):
    """Whole blocks in order of (tok, n, node): batches of rows of the three kinds. alike: the row stands for others."""
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])  # not another task's copy of the set
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    stands = np.logical_or.reduceat(alike, first)
    stands = np.repeat(stands, np.diff(np.r_[first, len(tok)]))[new]
    tok, n, pos, node = (x[new] for x in (tok, n, pos, node))
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    size = np.diff(np.r_[first, len(tok)])
    of = np.repeat(np.arange(len(first)), size)
    large = (size > FEW)[of] | stands
    if large.any():
        at, lead = open_postings(tok[large], n[large], pos[large], node[large])
        yield _rows(OPEN, tok[large][at], (n << 32 | pos)[large][at], node[large][at], lead, 0, 0)
        own, number = np.unique(node[large], return_counts=True)
        yield _rows(LARGE, 0, 0, own, 0, 0, number)
    u, small = _reach(n, pos), np.flatnonzero(~large & (size[of] > 1))
    parts = []
    for step in range(1, FEW):
        i = small[small + step < len(tok)]
        i = i[of[i + step] == of[i]]
        if not len(i):
            break
        j = i + step
        fits = 4 * n[i] >= 3 * n[j]
        i, j = i[fits], j[fits]
        swap = node[i] > node[j]
        parts.append((np.where(swap, j, i), np.where(swap, i, j)))
    if parts:
        i, j = (np.concatenate(x) for x in zip(*parts))
        if len(i):
            a, b, at, shared, opened = _summed(node[i], node[j], np.ones(len(i), np.int64), (n[i] <= u[j]) & (n[j] <= u[i]))
            yield _rows(PAIR, opened > 0, n[i[at]], a, b, n[j[at]], shared)


def _blocks(batches):
    """Postings in order of (tok, size, node), streamed block by block."""
    rest = [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
    waiting, held = [], 0
    for batch in batches:
        tok, size, node = (batch.column(i).to_numpy() for i in range(3))
        alike = batch.column(3).fill_null(0).to_numpy()
        stands = np.asarray(batch.column(3).is_valid())
        twin = stands & (alike != node)
        if twin.any():  # the block has its stand-in
            yield _rows(OPEN, tok[twin], size[twin], node[twin], alike[twin], 0, 0)
            yield _rows(OPEN, tok[twin], size[twin], alike[twin], alike[twin], 0, 0)
            yield _rows(LARGE, 0, 0, node[twin], 0, 0, 1)
        waiting.append([c[~twin] for c in (tok, size >> 32, size & 0xFFFFFFFF, node, stands)])
        held += len(waiting[-1][0])
        if held >= 200_000:
            rows = [np.concatenate(c) for c in zip(rest, *waiting)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if cut:
                yield from settled_blocks(*(c[:cut] for c in rows))
            rest, waiting, held = [c[cut:] for c in rows], [], 0
    rows = [np.concatenate(c) for c in zip(rest, *waiting)]
    if len(rows[0]):
        yield from settled_blocks(*rows)


def _spots(nodes: np.ndarray, bits: int) -> np.ndarray:
    h = mixed(nodes.view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(20)) & np.uint64(bits - 1), (h >> np.uint64(37)) & np.uint64(bits - 1)]).astype(np.int64)


def _bloom(bits: int):
    def run(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _spots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits).ravel()
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([int(own.sum()) & 0xFFFF], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "blob"])

    return run


def _wanted(shared, texts: bool):
    """(node, text) or (node, ordered set) of rows whose node may be wanted, once a task; a false positive costs a row,
    no more."""

    def run(batches):
        (order, bits), seen = shared.value, set()
        for batch in batches:
            column, at = batch.column(0), 0
            for flat, bounds in shingle_sets(column, order):
                nodes = nodes_of(flat, bounds)
                spots = _spots(nodes, 8 * len(bits))
                hit = (nodes != 0) & (bits[spots >> 3] >> (spots & 7) & 1).all(axis=0)
                rows, sets = [], []
                for i in np.flatnonzero(hit).tolist():
                    if (node := int(nodes[i])) not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(node)
                        rows.append(i)
                        if not texts:
                            sets.append(flat[bounds[i] : bounds[i + 1]].tobytes())
                if rows:
                    content = column.take(pa.array(np.array(rows) + at)) if texts else pa.array(sets, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), content], names=["node", "text" if texts else "toks"])
                at += len(nodes)

    return run


def probe(x: list[int], tree: list[tuple[tuple[int, ...], int]]) -> list[int]:
    """Ids of the sets in the tree that link with x. The tree is the sorted list of ordered sets, read as a
    path-compressed trie: the sets between two bounds share a path, whose overlap with x is counted once; a path is
    left, and nothing below it visited, once overlap plus what can still come is too little for the smallest of all."""
    if not tree:
        return []
    rank = {t: i for i, t in enumerate(x)}
    nx, found = len(x), []
    sizes = [len(y) for y, _ in tree]
    short, long = min(sizes), max(sizes)
    todo = [(0, len(tree), 0, 0, 0)]  # bounds, depth, overlap so far, how much of x has been passed
    while todo:
        lo, hi, depth, got, past = todo.pop()
        a, z = tree[lo][0], tree[hi - 1][0]
        if hi - lo == 1:
            least = most = len(a)
        else:
            least, most = max(short, depth), long
        need = 3 * (nx + least)  # 7 I >= 3 (nx + ny)
        top = min(len(a), len(z))
        while 7 * (got + min(most - depth, nx - past)) >= need and depth < top and a[depth] == z[depth]:
            i = rank.get(a[depth])
            if i is not None:
                got += 1
                past = max(past, i + 1)
            depth += 1
        if 7 * (got + min(most - depth, nx - past)) < need:
            continue
        while lo < hi and len(tree[lo][0]) == depth:  # sets that end here come first
            if 7 * got >= 3 * (nx + depth):
                found.append(tree[lo][1])
            lo += 1
        while lo < hi:
            end = bisect_right(tree, tree[lo][0][depth], lo, hi, key=lambda y: y[0][depth])
            todo.append((lo, end, depth, got, past))
            lo = end
    return found


def _verify(batches):
    """Rows sorted by (lead, salt, role): the leader's set, then the sets to hold against it. Out: links (a, b)."""
    key, x, waiting = None, None, []

    def flush():
        found = probe(x, sorted(waiting)) if x is not None and waiting else []
        waiting.clear()
        return [(key[0], f) for f in found]

    for batch in batches:
        links = []
        for lead, salt, role, node, toks in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (lead, salt) != key:
                links += flush()
                key, x = (lead, salt), None
            if role == 0:  # its own set comes first
                x = np.frombuffer(toks, np.uint64).tolist()
            else:
                waiting.append((tuple(np.frombuffer(toks, np.uint64).tolist()), node))
                if len(waiting) >= CHUNK:
                    links += flush()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])
    links = flush()
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def join_family(names: list[int], sets: list[np.ndarray]) -> list[int]:
    """The component of each set: the least name that links reach."""
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    held: dict[int, tuple[list[int], list[int]]] = {}  # shingle: sets with it in their prefix, and their reach
    plain: dict[int, tuple[int, ...]] = {}
    for i, own in enumerate(sets):
        n = len(own)
        x = plain[i] = tuple(own.tolist())
        prefix = x[: n - needed(n) + 1]
        near = [(held[t], 7 * (n - at) // 3 - n) for at, t in enumerate(prefix) if t in held]
        if near:
            left = np.concatenate([np.array(sets_) for (sets_, _), _ in near])
            reach = np.concatenate([np.array(r) for (_, r), _ in near])
            mine = np.repeat([u for _, u in near], [len(s) for (s, _), _ in near])
            left = np.unique(left[(reach >= n) & (size[left] <= mine)])
        else:
            left = np.empty(0, np.int64)
        chunk = 24
        while len(left := left[label[left] != label[i]]):
            for j in probe(list(x), sorted((plain[int(j)], int(j)) for j in left[:chunk])):
                a, b = sorted((int(label[i]), int(label[j])))
                if a != b:
                    label[label == b] = a
            left, chunk = left[chunk:], min(4 * chunk, CHUNK)
        for at, t in enumerate(prefix):
            sets_, reach = held.setdefault(t, ([], []))
            sets_.append(i)
            reach.append(7 * (n - at) // 3 - n)
    least: dict[int, int] = {}
    for n, k in zip(names, label.tolist()):
        least[k] = min(n, least.get(k, n))
    return [least[k] for k in label.tolist()]


def _families(shared):
    """Rows (family, node, text) sorted by family, streamed; the sets of one family are held whole, their size is
    bounded. Out: links (a, b) to the least."""

    def run(batches):
        order, family, names, sets = shared.value, None, [], []

        def out():
            found = [(n, c) for n, c in zip(names, join_family(names, sets)) if n != c]
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            own = (flat[lo:hi] for flat, bounds in shingle_sets(batch.column(2), order) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            for f, node, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own):
                if f != family:
                    if names:
                        yield out()
                    family, names, sets = f, [], []
                elif node == names[-1]:  # another task's copy of the set
                    continue
                names.append(node)
                sets.append(s)
        if names:
            yield out()

    return run


def _held_against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs (lead, node). A leader with many pairs is dealt out in parts, its own set with each."""
    parts = stored(pairs.groupBy("lead").agg((F.floor(F.count(F.lit(1)) / CHUNK) + 1).cast("int").alias("parts")), "parts")
    salted = stored(pairs.join(parts, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), "node"), "salted")
    others = salted.join(sets, "node").select("lead", "salt", F.lit(1).alias("role"), "node", "toks")
    leads = parts.join(sets, parts["lead"] == sets["node"]).select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), "node", "toks")
    rows = others.unionByName(leads).repartition(partitions(pairs.sparkSession), "lead", "salt").sortWithinPartitions("lead", "salt", "role")
    return rows.mapInArrow(_verify, "a long, b long")


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, n, comp) with the components that links (a, b) between nodes join made one."""
    ends = [comp.select(F.col("node").alias(e), F.col("comp").alias(f"c{e}")) for e in "ab"]
    linked = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joined = components(linked).withColumnRenamed("node", "old").withColumnRenamed("comp", "new")
    return stored(comp.join(joined, comp["comp"] == joined["old"], "left").select("node", "n", F.coalesce("new", "comp").alias("comp")), "comp")


def _pairs(blocks: DataFrame) -> DataFrame:
    """(node, other) that small blocks name and that share enough of their prefixes to link. The prefix that ends first
    holds n - ceil(3n/4) + 1 shingles, of which n - ceil(3/7 (nx + ny)) at most are not in the other."""
    named = blocks.where(F.col("kind") == PAIR).groupBy("node", "other").agg(F.sum("shared").alias("shared"), F.max("tok").alias("open"), F.max("size").alias("n"), F.max("size2").alias("m")).where("open = 1")
    large = blocks.where(F.col("kind") == LARGE).groupBy("node").agg(F.sum("shared").alias("large"))
    named = named.join(large, "node", "left").join(large.select(F.col("node").alias("other"), F.col("large").alias("large2")), "other", "left")
    need = F.floor((3 * (F.col("n") + F.col("m")) + 6) / 7) + 1 - F.floor((3 * F.greatest("n", "m") + 3) / 4)
    more = F.least(F.coalesce("large", F.lit(0)), F.coalesce("large2", F.lit(0)))
    return named.where(F.col("shared") + more >= need).select("node", "other")


def _in_rounds(pairs: DataFrame, blocks: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """comp (node, n, comp) of the nodes of large families, connected by the links among pairs (lead, node) and open
    pairs of blocks."""
    comp = _relabelled(comp, stored(_held_against(pairs, sets), "links"))
    reach = lambda r: F.floor(7 * (F.col(f"{r}.n") - F.col(f"{r}.pos")) / 3) - F.col(f"{r}.n")
    of = F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 2)
    leaders = 1
    while True:
        rows = blocks.join(comp.select("node", "comp"), "node")
        live = rows.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min(of).alias("least"), F.count(F.lit(1)).alias("size")).where("x < y")
        bound = F.greatest(F.col("least"), (F.least(F.lit(1.0), F.lit(float(leaders)) / F.col("size")) * float(1 << 62)).cast("long"))
        round_ = stored(rows.join(live, "tok").select("tok", "n", "pos", "node", "comp", (of <= bound).alias("leads")), "round")
        dropped(blocks)
        if round_.isEmpty():
            dropped(round_)
            return comp
        a, b = round_.where("leads").alias("a"), round_.alias("b")
        met = (F.col("a.tok") == F.col("b.tok")) & (F.col("a.comp") != F.col("b.comp")) & (F.col("b.n") <= reach("a")) & (F.col("a.n") <= reach("b"))
        pairs = a.join(b, met).select(F.least("a.node", "b.node").alias("lead"), F.greatest("a.node", "b.node").alias("node")).distinct()
        pairs = stored(pairs, "pairs")
        links = stored(_held_against(pairs, sets), "links")
        comp = _relabelled(comp, links)
        blocks = stored(round_.where("not leads").select("tok", "n", "pos", "node"), "blocks")
        dropped(round_, pairs, links)
        leaders *= 4


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable over links, itself included).

    Texts of fewer than five words are one shingle; null texts and texts without words have none and stay alone.
    Very long texts are hashed whole, piece by piece. Repeated rows repeat; rows with a null id take part, but never
    name a component unless alone. No rows give no rows. Other columns are not read, whatever their names."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scan = stored(rows.mapInArrow(_sets, "doc_id long, node long, n long, blob binary"), "sets")
    own = scan.where("blob is null").select("doc_id", "node", "n")
    counts = merged(scan.where("blob is not null").select(F.pmod(F.xxhash64("blob"), F.lit(16)).cast("int").alias("part"), "blob"), "int64", "add", SKETCH)
    classes = order_of(counts)
    order = share(classes)

    def found(nodes: DataFrame, texts: bool) -> DataFrame:
        """Rows that may hold the nodes. The filter has 12 bits a node, up to 16 MB in all; beyond that more rows move."""
        bits = 1 << min(27, max(20, int(12 * nodes.count()).bit_length()))
        filled = merged(nodes.select("node").mapInArrow(_bloom(bits), "part int, blob binary"), "uint8", "or", bits // 8)
        return rows.select("text").mapInArrow(_wanted(share((classes, filled)), texts), "node long, " + ("text string" if texts else "toks binary"))

    postings = rows.select("text").mapInArrow(_postings(order), _POSTING)
    stays = F.col("alike").isNull() | (F.col("alike") == F.col("node"))
    dealt = postings.repartition(partitions(spark), F.when(stays, F.col("tok")).otherwise(F.col("node")))
    blocks = stored(dealt.sortWithinPartitions("tok", "size", "node").mapInArrow(_blocks, _BLOCK), "blocks")
    pairs = stored(_pairs(blocks), "pairs")
    open_ = blocks.where(F.col("kind") == OPEN)
    edges = stored(pairs.unionByName(open_.select("node", "other")).distinct(), "edges")
    family = components(edges.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("comp", "family")
    member = stored(family.join(own.groupBy("node").agg(F.min("n").alias("n")), "node"), "members")
    large = member.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where((F.col("k") > FAMILY) | (F.col("shingles") > 1000 * FAMILY)).select("family")
    large = stored(large, "large")
    small = member.join(large, "family", "left_anti").select("node", "family")
    in_task = found(small, True).join(small, "node").select("family", "node", "text").repartition(partitions(spark), "family").sortWithinPartitions("family", "node")
    links = stored(in_task.mapInArrow(_families(order), "a long, b long"), "settled")
    comp = member.join(links, member["node"] == links["a"], "left").select("node", "n", F.coalesce("b", "node").alias("comp"))
    if not large.isEmpty():
        rest = stored(member.join(large, "family", "left_semi").select("node", "n", F.col("node").alias("comp")), "rest")
        size = [F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")]
        open_ = stored(open_.join(rest.select("node"), "node", "left_semi").select("tok", *size, "node").distinct(), "open")
        lead = stored(pairs.join(rest.select("node"), "node", "left_semi").select(F.col("node").alias("lead"), F.col("other").alias("node")), "lead")
        comp = comp.join(rest.select("node"), "node", "left_anti").unionByName(_in_rounds(lead, open_, rest, stored(found(rest, False).dropDuplicates(["node"]), "candidates")))
    comp = stored(comp, "comp")
    dropped(blocks, pairs, edges, member, links)

    known = own.join(comp.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = known.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return known.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
