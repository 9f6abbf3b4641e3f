"""Shared plumbing of the training-data operators: inputs, scratch tables, words, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the controls TAB..CR.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset and one
    machine does all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gritstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/gritstone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, so a lost executor costs one read."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what came from them is stored itself."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; emptied when it holds ``limit`` words so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: A-Z to a-z on bytes, nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without the six separators: just what ``bytes.split`` does."""
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the weak low bits of a polynomial hash."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` values, by differences of one running sum."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        p = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * p[::-1], out=total[1:])  # highest power first: window i carries the factor p[n-k-i]
        inv = np.uint64(pow(_BASE, -1, 1 << 64))
        back = np.full(n - k + 1, inv, np.uint64)
        back[-1] = 1
        back = np.multiply.accumulate(back[::-1])[::-1]
        return mixed((total[k:] - total[:-k]) * back)


#: 64 random bits by byte, A-Z as a-z; zero for the separators.
_BYTES = np.random.default_rng(20).integers(1, MASK, 256, np.uint64)
_BYTES[list(SPACES.encode())] = 0
_BYTES[65:91] = _BYTES[97:123]
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_INVERSES = np.ones(1, np.uint64)
PIECE = 1 << 20


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        p = np.full(max(n, 2 * len(_INVERSES)), pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _INVERSES = np.multiply.accumulate(p)
    return _INVERSES[:n]


def lower_word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of consecutive rows, of about ``PIECE`` bytes unless one text is longer: the 64-bit hashes of all
    their words, A-Z lower-cased, and each row's bounds among them. A hash is a polynomial over the word's bytes.
    Longer texts are hashed piece by piece, cut between words; null is empty."""
    text = column.fill_null("").cast(pa.large_binary())
    if not len(text):
        return
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        rows, lo, end = at[first:last], int(at[first]), int(at[last])
        starts, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        while lo < end:
            hi = min(end, lo + PIECE)
            if hi < end:
                gap = _GAP.search(data, hi)
                hi = min(end, gap.start() if gap else end)
            t = _BYTES[data[lo:hi]]
            word = t != 0
            start = word.copy()
            start[1:] &= ~word[:-1]
            inside = rows[(rows >= lo) & (rows < hi)] - lo
            start[inside] = word[inside]
            s = np.flatnonzero(start)
            if len(s):
                with np.errstate(over="ignore"):
                    hashes.append(mixed(np.add.reduceat(t * _powers(hi - lo), s) * _inverses(hi - lo)[s]))
                starts.append(s + lo)
            lo = hi
        yield np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at[first : last + 1])
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def merged(blobs: DataFrame, kind: str, how: str, size: int) -> np.ndarray:
    """One array of ``size`` numbers from rows (part int, blob binary), one a task: added or or-ed by 16 tasks, whose
    results of that fixed size meet on the driver."""
    op = {"add": np.add, "or": np.bitwise_or}[how]

    def fold(batches):
        total = None
        for batch in batches:
            for b in batch.column(1):
                a = np.frombuffer(b.as_buffer(), kind)
                total = a.copy() if total is None else op(total, a, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    total = np.zeros(size, kind)
    for row in blobs.repartition(16, "part").mapInArrow(fold, "part int, blob binary").toLocalIterator():
        op(total, np.frombuffer(row.blob, kind), out=total)
    return total


#: Edges that one task joins by union-find, in about 300 MB at most; more go through stars.
IN_ONE_TASK = 1_000_000


def _union_find(batches):
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        own = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(x) for x in own], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(node, comp) for all nodes of edges (a, b): the least node reachable. Edges whose count is proven small go
    through union-find in one task, else through alternating large and small stars, of which every step is an
    aggregate (pre-aggregated by the map side) and an equi-join, and is stored."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= in_one_task:
        return stored(now.coalesce(1).mapInArrow(_union_find, "node long, comp long"), "components")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
