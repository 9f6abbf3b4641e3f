"""A table that is replaced in transactions (S16, S17), and a stream's sink that may repeat a batch.

Data lie in folders of their transaction and part; a version of the table is a manifest, one small file that says which
transaction holds each part. A commit writes the parts it touches to its own folder and its manifest last, in one
file, so readers see all of it or nothing; a write that fails or is rolled back leaves the old version. Parts that are
not touched are neither read nor written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another transaction has committed since this one began."""


class Table:
    """Rows with unique keys, replaced by key; ``part`` is the column that tells which rows lie together. A key stays in
    its part. Null keys are keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], part: str):
        self.spark, self.path, self.schema, self.key, self.part = spark, path.rstrip("/"), schema, key, part
        kind = schema[part].dataType
        self._manifest = StructType().add("part", kind).add("txn", "string").add("version", "long")

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self._manifest).parquet(f"{self.path}/manifest")
        except Exception as x:
            if "PATH_NOT_FOUND" in str(x):
                return None
            raise

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        all_ = self._versions()
        return (all_.agg(F.max("version")).first()[0] or 0) if all_ is not None else 0

    def _parts(self, version: int) -> DataFrame:
        all_ = self._versions() if version else None
        if all_ is None:
            return self.spark.createDataFrame([], self._manifest).select("part", "txn")
        return all_.where((F.col("version") == version) & F.col("txn").isNotNull()).select("part", "txn")

    def read(self, version: int | None = None) -> DataFrame:
        parts = self._parts(self.version() if version is None else version)
        txns = sorted(r.txn for r in parts.select("txn").distinct().collect())  # transactions that still hold a part
        if not txns:
            return self.spark.createDataFrame([], self.schema)
        data = self.spark.read.schema(StructType([*self.schema.fields]).add("txn", "string")).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/txn={t}" for t in txns])
        own = parts.select(F.col("part").alias("_part"), F.col("txn").alias("_txn"))
        return data.join(own, data[self.part].eqNullSafe(own["_part"]) & (data["txn"] == own["_txn"]), "left_semi").select(self.schema.names)

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Changes that count together. As a context it commits at the end, or rolls back if an error leaves it."""

    def __init__(self, table: Table):
        self.table, self.base, self.id = table, table.version(), uuid.uuid4().hex
        self.changes: list[tuple[DataFrame, bool]] = []
        self.open = True

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Rows replace those of their key. Of repeated keys the row of the highest ``order`` counts, then the greatest row."""
        t = self.table
        best = F.struct(*([order] if order else []), F.struct(*t.schema.names))
        newest = rows.groupBy(*t.key).agg(F.max(best).alias("_x")) if not set(t.key) >= set(t.schema.names) else rows.select(*t.schema.names).distinct()
        self.changes.append((newest.select("_x.col2.*" if order else "_x.col1.*") if "_x" in newest.columns else newest, True))

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys (the key columns and the part) go."""
        self.changes.append((keys, False))

    def replace_part(self, part, rows: DataFrame, order: str | None = None) -> None:
        """All rows of one part give way to these."""
        t = self.table
        self.delete(t.read(self.base).where(F.col(t.part).eqNullSafe(F.lit(part))).select(*dict.fromkeys([*t.key, t.part])))
        self.upsert(rows, order)

    def commit(self) -> int:
        """Returns the new version."""
        self._check()
        t, spark = self.table, self.table.spark
        now = t.read(self.base)
        touched = None
        for rows, _ in self.changes:
            own = rows.select(F.col(t.part).alias("_part")).distinct()
            touched = own if touched is None else touched.unionByName(own).distinct()
        if touched is None:
            self.open = False
            return self.base
        now = now.join(touched, now[t.part].eqNullSafe(touched["_part"]), "left_semi")
        for rows, adds in self.changes:
            keys = rows.select(*[F.col(k).alias(f"_{k}") for k in t.key]).distinct()
            same = F.lit(True)
            for k in t.key:
                same = same & now[k].eqNullSafe(keys[f"_{k}"])
            now = now.join(keys, same, "left_anti")
            if adds:
                now = now.unionByName(rows.select(t.schema.names))
        now.select(*t.schema.names, F.lit(self.id).alias("txn")).write.mode("append").partitionBy("txn", t.part).parquet(f"{t.path}/data")
        if t.version() != self.base:
            raise Conflict(f"version {self.base} is no longer the last")
        old = t._parts(self.base)
        kept = old.join(touched, old["part"].eqNullSafe(touched["_part"]), "left_anti")
        new = self._written()
        manifest = kept.unionByName(new) if new is not None else kept
        none = spark.createDataFrame([(None, None)], StructType().add("part", t.schema[t.part].dataType).add("txn", "string"))
        # One file, put in place as a whole; the row without a transaction says that the version is there.
        manifest.unionByName(none).coalesce(1).write.mode("errorifexists").parquet(f"{t.path}/manifest/version={self.base + 1}")
        self.open = False
        return self.base + 1

    def _written(self) -> DataFrame | None:
        t = self.table
        try:
            data = t.spark.read.schema(StructType([*t.schema.fields]).add("txn", "string")).option("basePath", f"{t.path}/data").parquet(f"{t.path}/data/txn={self.id}")
        except Exception as x:
            if "PATH_NOT_FOUND" in str(x):
                return None
            raise
        return data.select(F.col(t.part).alias("part"), "txn").distinct()

    def rollback(self) -> None:
        """Nothing of this transaction counts."""
        self.changes, self.open = [], False

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind:
            self.rollback()
        elif self.open:
            self.commit()


def once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch has a folder of its own, which a replay writes anew."""
    return lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")


def deliver(events: DataFrame, key: list[str], ts: str, path: str, checkpoint: str, within: str = "10 minutes"):
    """Starts a query that gives each key once: repeats within the watermark are dropped, batches may be replayed."""
    rows = events.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once(path)).start()
