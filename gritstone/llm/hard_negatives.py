"""Hard-negative mining with bit-sliced integer products.

Components are whole numbers x = -2^P s + sum of 2^p b_p with bits b_p, s. The product of an anchor with a candidate is
summed over bit-planes, most significant first: after each plane the rest lies between bounds known from the anchor
alone, so each score has an interval that only tightens. A candidate is dropped once its interval cannot qualify: it
misses the window of scores, or its upper end is below the k-th best score that is certain already. Planes are
products of whole blocks while many candidates live, sums over single pairs once few do.

The query set (anchors) meets all rows in blocks: a block of about ``BLOCK`` anchors at a time goes to all tasks, which
read the rows where they lie; only the best k of an anchor and task are shuffled.

Rows whose label or vector is null, empty, or holds null or non-finite entries, rows without id, and vectors of another
length than the most common one take no part. Repeated rows (id, vector and label equal) count once; an anchor meets
no row of its own id. Ties go to the smaller id. Of other columns nothing is read. No rows, or anchors without positives, give no rows. Products that could pass 62 bits raise an
OverflowError."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, scratch, stored
from .vectors import dimension, finite, floors, matrix

#: Anchors that one job meets all rows with, about; rows that one product takes.
BLOCK, ROWS = 2_048, 1_024
#: Share of pairs below which planes are summed pair by pair.
SPARSE = 0.05
LEAST = -(2**62)


class Planes:
    """Intervals of the products of anchors with candidates, plane by plane."""

    def __init__(self, anchors: np.ndarray, bits: int):
        d, top = anchors.shape[1], int(np.abs(anchors).max(initial=1))
        if d * top << bits >= 2**62:
            raise OverflowError("products do not fit 62 bits")
        self.bits, self.kind = bits, np.float64 if d * top << bits < 2**53 else np.int64
        self.anchors = anchors.astype(self.kind)
        self.up, self.down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)

    def scan(self, x: np.ndarray, live: np.ndarray, lows: np.ndarray, highs: np.ndarray, best: np.ndarray, k: int):
        """(anchor, candidate, score) of all pairs of ``live`` that may be among the first k of a window of their
        anchor. lows, highs, best: an anchor a row, a window a column; ``best`` is the k-th best score known."""
        whole = np.zeros(live.shape, self.kind)
        planes = ((x[:, :, None] >> np.arange(self.bits + 1)) & 1).astype(self.kind)
        best = best.copy()
        plane = self.bits
        while plane >= 0:
            weight = -(1 << plane) if plane == self.bits else 1 << plane
            whole += weight * (self.anchors @ planes[:, :, plane].T)
            rest = (1 << plane) - 1
            low, high = whole + (rest * self.down)[:, None], whole + (rest * self.up)[:, None]
            keep = np.zeros_like(live)
            for w in range(lows.shape[1]):
                a, b = lows[:, w, None], highs[:, w, None]
                if live.shape[1] > k:  # the k-th best that lies in the window for certain
                    sure = np.where(live & (low >= a) & (high <= b), low, LEAST)
                    best[:, w] = np.maximum(best[:, w], np.partition(sure, -k, axis=1)[:, -k])
                keep |= (high >= np.maximum(a, best[:, w, None])) & (low <= b)
            live = live & keep
            plane -= 1
            if np.count_nonzero(live) <= SPARSE * live.size:
                break
        a, c = np.nonzero(live)
        score = whole[a, c]
        while plane >= 0 and len(a):
            score = score + (1 << plane) * np.einsum("ij,ij->i", self.anchors[a], planes[c, :, plane])
            rest = (1 << plane) - 1
            low, high = score + rest * self.down[a], score + rest * self.up[a]
            keep = ((high[:, None] >= np.maximum(lows, best)[a]) & (low[:, None] <= highs[a])).any(1)
            a, c, score = a[keep], c[keep], score[keep]
            plane -= 1
        return a, c, score.astype(np.int64)


class Best:
    """The first k of each anchor and window: by score, then id."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k, self.windows = k, windows
        self.slot = self.score = self.row = np.empty(0, np.int64)
        self.least = np.full((anchors, windows), LEAST, np.int64)

    def add(self, a, w, score, row) -> None:
        slot = np.concatenate([self.slot, a * self.windows + w])
        score, row = np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        start = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - start
        first = place < self.k
        self.slot, self.score, self.row = slot[first], score[first], row[first]
        full = place == self.k - 1
        self.least.ravel()[slot[full]] = score[full]


def _scan(rows: DataFrame, block: list, d: int, bits: int, k: int, same: bool) -> DataFrame:
    """(anchor, window, row id, score): the first k rows of a task for each anchor of the block and window of it."""
    by_label: dict[int, list] = {}
    for r in block:
        by_label.setdefault(r.label if same else 0, []).append(r)
    blob = []
    for label, own in by_label.items():
        width = max(len(r.lows) for r in own)
        none = lambda xs, x: list(xs) + [x] * (width - len(xs))
        blob.append((label, np.array([r.anchor for r in own]), np.array([r.vec_id for r in own]), np.array([r.label for r in own]), np.array([r.x for r in own], np.int64).reshape(len(own), d), np.array([none(r.lows, 1) for r in own], np.int64), np.array([none(r.highs, 0) for r in own], np.int64)))

    def run(batches):
        state = [(label, key, ids, labels, Planes(x, bits), lows, highs, Best(len(key), lows.shape[1], k)) for label, key, ids, labels, x, lows, highs in blob]
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                own, row_label = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = matrix(part.column(2), d)
                for label, _, ids, labels, planes, lows, highs, best in state:
                    at = np.flatnonzero(row_label == label) if same else np.arange(len(own))
                    if not len(at):
                        continue
                    live = ids[:, None] != own[at]
                    if not same:
                        live &= labels[:, None] != row_label[at]
                    a, c, score = planes.scan(x[at], live, lows, highs, best.least, k)
                    for w in range(lows.shape[1]):
                        fits = (score >= np.maximum(lows, best.least)[a, w]) & (score <= highs[a, w])
                        if fits.any():
                            best.add(a[fits], w, score[fits], own[at][c[fits]])
        for _, key, _, _, _, lows, _, best in state:
            if len(best.slot):
                yield pa.RecordBatch.from_arrays([pa.array(key[best.slot // lows.shape[1]]), pa.array((best.slot % lows.shape[1]).astype(np.int32)), pa.array(best.row), pa.array(best.score)], names=["anchor", "window", "row_id", "score"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, "anchor long, window int, row_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, anchors: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the
    first rows of another label whose score is ``low`` to ``high`` percent of the positive's. ``anchors`` says which
    rows are anchors, all by default."""
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    is_anchor = F.lit(True) if anchors is None else anchors
    clean = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    d = dimension(clean, "v")
    clean = stored(clean.where(F.size("v") == d).withColumn("x", floors(F.col("v"))).drop("v").distinct(), "vectors")
    least, most, n = clean.agg(F.min(F.array_min("x")), F.max(F.array_max("x")), F.count(F.when(F.col("is_anchor"), 1))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    bits = max(int(most), -1 - int(least), 1).bit_length()
    blocks = -(-n // block)
    asked = stored(clean.where("is_anchor").withColumn("anchor", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).drop("is_anchor"), "anchors")
    positives, negatives = scratch(spark, "positives"), scratch(spark, "negatives")
    window = F.array(F.lit(LEAST + 1)).alias("lows"), F.array(F.lit(-LEAST)).alias("highs")
    for b in range(blocks):
        own = asked.where(F.col("block") == b).select("anchor", "vec_id", "label", "x", *window).collect()
        if own:
            _ranked(_scan(clean, own, d, bits, n_positives, True), n_positives).withColumn("block", F.lit(b)).write.mode("append").parquet(positives)
    kept = spark.read.schema("anchor long, window int, row_id long, score long, rank int, block int").parquet(positives)
    for b in range(blocks):
        # windows of whole scores s with low * p <= 100 s <= high * p
        edge = kept.where(F.col("block") == b).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
        edge = edge.withColumn("lows", F.transform("p", lambda p: F.ceil(F.lit(low) * p["score"] / F.lit(100).cast("decimal(20,0)")).cast("long"))).withColumn("highs", F.transform("p", lambda p: F.floor(F.lit(high) * p["score"] / F.lit(100).cast("decimal(20,0)")).cast("long")))
        own = asked.where(F.col("block") == b).join(edge, "anchor").select("anchor", "vec_id", "label", "x", "lows", "highs").collect()
        if own:
            _ranked(_scan(clean, own, d, bits, n_negatives, False), n_negatives).write.mode("append").parquet(negatives)
    if not kept.count():
        return spark.createDataFrame([], schema)
    found = spark.read.schema("anchor long, window int, row_id long, score long, rank int").parquet(negatives)
    p = kept.select("anchor", (F.col("rank") - 1).alias("window"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = found.join(p, ["anchor", "window"]).join(names, "anchor")
    out = stored(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
    dropped(clean, asked)
    return out


#: SQL for the query, in which all anchors are scored against all rows.
ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10"""
