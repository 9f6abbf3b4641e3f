"""Exact dedup over a cuckoo-filter index of live digests (operator 8).

A task keeps an index of the digests it has seen: the filter answers "maybe", a hit is settled by the full
32-byte digests bucketed beside it, a better copy deletes the live entry and inserts its own, and a full filter is
rebuilt at twice the size from the stored keys. Each scan task indexes its own rows first, so a group holding a
third of all rows leaves a task as one row; winners then meet in a second index, dealt by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, partitions


class CuckooIndex:
    """digest (bytes) -> live record. Four fingerprints a bucket, two buckets a key, partial-key displacement."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[int, dict[bytes, tuple]] = getattr(self, "content", {})

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _homes(self, digest: bytes, fp: int) -> tuple[int, int]:
        a = int.from_bytes(digest[8:16], "little") & self.mask
        return a, self._other(a, fp)

    def _other(self, at: int, fp: int) -> int:
        return (at ^ (fp * 0x5BD1E995)) & self.mask

    def _group(self, digest: bytes) -> int:
        return int.from_bytes(digest[16:20], "little") & 0xFFFFF

    def maybe(self, digest: bytes) -> bool:
        fp = self._print(digest)
        a, b = self._homes(digest, fp)
        return fp in self.table[a] or fp in self.table[b]

    def get(self, digest: bytes) -> tuple | None:
        """The live record; the filter's hit is verified against the bucketed digests."""
        return self.content.get(self._group(digest), {}).get(digest) if self.maybe(digest) else None

    def insert(self, digest: bytes, record: tuple) -> None:
        self.content.setdefault(self._group(digest), {})[digest] = record
        if not self._place(digest):
            self._resize()

    def delete(self, digest: bytes) -> None:
        """Only for live digests, as a cuckoo filter asks."""
        fp = self._print(digest)
        for at in self._homes(digest, fp):
            if fp in self.table[at]:
                self.table[at].remove(fp)
                break
        group = self.content[self._group(digest)]
        del group[digest]

    def _place(self, digest: bytes) -> bool:
        fp = self._print(digest)
        a, b = self._homes(digest, fp)
        for at in (a, b):
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(fp)
                return True
        at = b
        for kick in range(self.KICKS):
            slot = (fp + kick) % self.SLOTS
            fp, self.table[at][slot] = self.table[at][slot], fp
            at = self._other(at, fp)
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(fp)
                return True
        return False

    def _resize(self) -> None:
        """Overflow: twice the buckets, filled again from the stored keys."""
        self.resizes += 1
        while True:
            self._clear(2 * (self.mask + 1))
            if all(self._place(d) for group in self.content.values() for d in group):
                return

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for group in self.content.values():
            yield from group.items()


_SCHEMA = "digest binary, best_chars long, best_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("group_size", pa.int64())])


def _better(a: tuple, b: tuple) -> bool:
    """More code points, then the smaller id; a null id comes last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _indexed(flush: int):
    """Rows (digest, best_chars, best_id, group_size) in, one per digest out. flush > 0: leave and start anew at so
    many digests, which bounds memory where the next index merges the rest."""

    def run(batches):
        index, held = CuckooIndex(), 0

        def out():
            rows = [(d, *r) for d, r in index.items()]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), _ARROW.types)], schema=_ARROW)

        for batch in batches:
            for d, chars, doc, size in zip(*(batch.column(n).to_pylist() for n in _ARROW.names)):
                live = index.get(d)
                if live is None:
                    index.insert(d, (chars, doc, size))
                    held += 1
                else:
                    total = live[2] + size
                    if _better((chars, doc), live):
                        index.delete(d)
                        index.insert(d, (chars, doc, total))
                    else:
                        index.content[index._group(d)][d] = (live[0], live[1], total)
            if flush and held >= flush:
                yield from out()
                index, held = CuckooIndex(), 0
        yield from out()

    return run


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Texts are equal when equal without the six white-space characters. The row with the
    most code points stays, then the smallest id (null ids last); repeated ids with the same text all say kept.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.length(t).cast("long").alias("chars"),
        F.unhex(F.sha2(F.translate(t, SPACES, "").cast("binary"), 256)).alias("digest"),
    )
    first = rows.select("digest", F.col("chars").alias("best_chars"), F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("group_size"))
    local = first.mapInArrow(_indexed(200_000), _SCHEMA)
    live = local.repartition(partitions(spark), "digest").mapInArrow(_indexed(0), _SCHEMA)
    return rows.join(live, "digest").select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
