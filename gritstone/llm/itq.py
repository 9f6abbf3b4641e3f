"""Embedding near-dedup: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

1. Equal vectors become one class. A sample of classes, ``SAMPLE`` at most by hash, fits the codes: principal axes of
   the centred unit vectors and a rotation that brings them nearest to the corners of a cube. Everything else reads
   all rows.
2. A code is cut into substrings of about log2(rows) bits, one a table, so that buckets keep their size as the table
   grows. Two codes meet in a table when their substrings differ in at most two bits: each is put under its own
   substring and those one bit away. How many tables are needed is measured on the sample, against copies turned by
   the angle of the threshold in random directions; if one rotation has too few bits, more are learned.
3. Codes alone are dealt to the buckets first. A pair counts in one bucket of the first table it meets in and goes on
   if the whole codes are near enough; only then do its vectors travel to that bucket, where the cosine decides.

No pairs are written: buckets give link counts, and edges that span what is linked. A bucket of more than ``SIDE``
rows is dealt into pairs of blocks, so that no task holds it, and all its pairs are compared.

Vectors that are null, empty, zero, hold null or non-finite entries, or are of another length than the most common one
link with nothing and are their own component. A repeated row is another vector. A null id never is the smallest; a
component without ids has a null component_id. Of other columns nothing is read. No rows give no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, stored
from .vectors import dimension, finite, matrix

#: Classes that the codes are fitted on, at most.
SAMPLE = 16_384
#: Rounds of the rotation's fit; tables at most; the share of turned copies that must be met.
ROUNDS, TABLES, RECALL = 30, 40, 0.98
#: Rows of a bucket that one block holds, pairs that are held at once.
SIDE, HELD = 2_048, 1_000_000


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rotation(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """d x bits: principal axes, turned until signs are as near to the values as they get."""
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    rng = np.random.default_rng(seed)
    axes = axes[:bits].T
    if axes.shape[1] < bits:  # fewer rows than bits
        axes = np.linalg.qr(np.hstack([axes, rng.standard_normal((x.shape[1], bits - axes.shape[1]))]))[0]
    v = x @ axes
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return axes @ turn


class Codes:
    """Substrings of balanced codes, fitted on a sample of unit vectors for ``rows`` rows and a cosine."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float):
        d = sample.shape[1]
        self.width = w = min(d, 24, max(6, math.ceil(math.log2(rows + 1))))
        self.mean, each = sample.mean(0), d // w
        rng = np.random.default_rng(3)
        side = rng.standard_normal(sample.shape)
        side -= (side * sample).sum(1, keepdims=True) * sample
        turned = cosine * sample + math.sqrt(1 - cosine**2) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        parts, met, far = [], np.zeros(len(sample), bool), np.zeros(len(sample), int)
        for t in range(TABLES):
            if t % each == 0:
                parts.append(_rotation(sample - self.mean, each * w, t))
            self.axes, self.tables = np.hstack(parts), t + 1
            a, b = (self._part(x - self.mean, t) for x in (sample, turned))
            apart = np.bitwise_count(a ^ b)
            met |= apart <= 2
            far += apart
            if met.mean() >= RECALL:
                break
        #: Whole codes of copies at the threshold are no further apart, but for one in a thousand.
        self.reach = int(np.quantile(far[met], 0.999)) if met.any() else 0
        self.axes = self.axes[:, : self.tables * w]

    def _part(self, x: np.ndarray, t: int) -> np.ndarray:
        bits = x @ self.axes[:, t * self.width : (t + 1) * self.width] >= 0
        return (bits << np.arange(self.width)).sum(1).astype(np.uint32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """One row of ``tables`` substrings a vector."""
        return np.stack([self._part(x - self.mean, t) for t in range(self.tables)], 1)


def _pairs(starts: np.ndarray, ends: np.ndarray):
    """All pairs of places within runs, ``HELD`` or so at a time."""
    left = ends - 1 - np.arange(len(ends))  # partners after a place in its run
    total = np.concatenate([[0], np.cumsum(left)])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + HELD, "right")) - 1)
        n = left[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], n)
        lo = hi


def _meeting(table, bucket, i, j, salt, code, reach):
    """Pairs (a, b) of places that this bucket has to decide: once a table, in the first table, near enough."""
    t = len(table)
    cut = np.ones(t, bool)
    cut[1:] = (table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    at = np.flatnonzero(cut)
    ends = np.repeat(np.append(at[1:], t), np.diff(np.append(at, t)))
    for a, b in _pairs(at, ends):
        own = (salt[a] != salt[b]) | (i[a] == j[a])
        a, b = a[own], b[own]
        x, y, key = code[a, table[a]], code[b, table[a]], bucket[a]
        # substrings 0, 1 or 2 bits apart share 1 + width, 2 or 2 buckets: the pair's is its own or the smaller one
        here = key == np.where(x == y, x, np.minimum(key, x ^ y ^ key))
        a, b = a[here], b[here]
        apart = np.bitwise_count(code[a] ^ code[b])
        first = (apart <= 2).argmax(1) == table[a]
        near = first & (apart.sum(1, dtype=np.int64) <= reach)
        yield a[near], b[near]


def _runs(batches, key: int):
    """Batches cut at the ends of runs of the first ``key`` columns, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(key)]
        changed = np.zeros(len(batch), bool)
        for c in cols:
            changed[1:] |= c[1:] != c[:-1]
        last = held[-1] if held else None
        fresh = last is None or any(last.column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(key))
        at = np.flatnonzero(changed)
        if held and (fresh or len(at)):
            head = 0 if fresh else int(at[0])
            yield pa.Table.from_batches([*held, batch.slice(0, head)]).combine_chunks()
            held, batch, at = [], batch.slice(head), at[at > head] - head
        if len(at):
            yield pa.Table.from_batches([batch.slice(0, int(at[-1]))]).combine_chunks()
            batch = batch.slice(int(at[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(rows: DataFrame, row: str, side: int) -> DataFrame:
    """Rows (table, bucket, ...) dealt to blocks: with i, j and salt, sorted in their partitions."""
    large = rows.groupBy("table", "bucket").count().where(F.col("count") > side).select("table", "bucket", F.ceil(F.col("count") / side).cast("int").alias("parts"))
    out = rows.join(large, ["table", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("salt", F.pmod(F.xxhash64(row), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other")).drop("parts", "other")
    keys = ["table", "bucket", "i", "j"]
    out = out.select(*keys, "salt", "code", *[c for c in rows.columns if c not in ("table", "bucket", "code")])
    return out.repartition(*keys).sortWithinPartitions(*keys)


def _columns(run: pa.Table, tables: int):
    batch = run.to_batches()[0]
    table, bucket, i, j, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
    code = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32).reshape(len(batch), tables)
    return batch, (table, bucket.astype(np.uint32), i, j, salt, code)


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by links (a, b)."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
    return root


def _linked(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of rows a and b reaches the threshold, the sums of borderline cases without rounding."""
    s = np.einsum("ij,ij->i", u[a], u[b])
    out = s >= cosine
    for k in np.flatnonzero(np.abs(s - cosine) < 1e-9):
        x, y = v[a[k]] / np.abs(v[a[k]]).max(), v[b[k]] / np.abs(v[b[k]]).max()
        out[k] = math.fsum(x * y) >= cosine * math.sqrt(math.fsum(x * x) * math.fsum(y * y))
    return out


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, side: int = SIDE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = rows.sparkSession
    own = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    d = dimension(own.where(finite(F.col("v"))), "v")
    usable = finite(F.col("v")) & (F.size("v") == d) & F.exists("v", lambda x: x != 0)
    alone = own.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = own.where(usable).groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    if not count:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    sample = classes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow()
    codes = Codes(_units(matrix(sample.column(0).combine_chunks(), d)), count, cosine)
    tables, reach = codes.tables, codes.reach

    def encode(batches):
        for batch in batches:
            if len(batch):
                c = codes.of(_units(matrix(batch.column(2), d)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in c], pa.binary())], names=["node", "n", "v", "code"])

    coded = stored(classes.select("node", "n", "v").mapInArrow(encode, "node long, n long, v array<double>, code binary"), "coded")

    flips = np.concatenate([[0], 1 << np.arange(codes.width)]).astype(np.uint32)

    def placed(batches):
        for batch in batches:
            c = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(len(batch), tables)
            for lo in range(0, len(c), 500):
                at = c[lo : lo + 500]
                where = np.repeat(np.arange(lo, lo + len(at)), tables * len(flips))
                bucket = (at[:, :, None] ^ flips).ravel().astype(np.int64)
                table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), len(flips)), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(bucket), batch.column(0).take(pa.array(where))], names=["table", "bucket", "code"])

    def scouted(batches):
        for run in _runs(batches, 4):
            batch, known = _columns(run, tables)
            met = np.zeros(len(batch), bool)
            for a, b in _meeting(*known, reach):
                met[a] = met[b] = True
            at = pa.array(np.flatnonzero(met))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in (0, 1, 5)], names=["table", "bucket", "code"])

    by_code = coded.groupBy("code").count()
    placing = by_code.select("code").mapInArrow(placed, "table int, bucket long, code binary")
    met = _dealt(placing, "code", side).mapInArrow(scouted, "table int, bucket long, code binary")
    # rows of one code meet under their first substring
    first = by_code.where("count > 1").select("code").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), pa.array(np.frombuffer(b"".join(c[:4] for c in b.column(0).to_pylist()), np.uint32).astype(np.int64)), b.column(0)], names=["table", "bucket", "code"]) for b in bs), "table int, bucket long, code binary")
    met = stored(met.unionByName(first).distinct(), "met")

    def verified(batches):
        for run in _runs(batches, 4):
            batch, known = _columns(run, tables)
            node, n, v = batch.column(6).to_numpy(), batch.column(7).to_numpy(), matrix(batch.column(8), d)
            u, links = _units(v), np.zeros(len(batch), np.int64)
            root = np.arange(len(batch))
            for a, b in _meeting(*known, reach):
                yes = _linked(u, v, a, b, cosine)
                a, b = a[yes], b[yes]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                joined = _rooted(len(root), np.concatenate([a, np.arange(len(root))]), np.concatenate([b, root]))
                root = joined
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[root[at]])], names=["node", "links", "a"])

    found = _dealt(met.join(coded, "code"), "node", side).mapInArrow(verified, "node long, links long, a long")
    found = stored(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("a").alias("b")))
    known = classes.join(links, "node", "left").join(comp, "node", "left").select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    known = stored(known, "known")
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    linked = own.where(usable).join(known.drop("least").join(least, "comp"), "v").select("vec_id", "n_links", "component_id")
    out = stored(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "links")
    dropped(classes, coded, met, found, known)
    return out
