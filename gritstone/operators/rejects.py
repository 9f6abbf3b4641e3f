"""Parse-error log: rows and rejects from one pass over the inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def parsed(files: DataFrame, parse: Callable[[str], Iterable[tuple]], schema: str, clock: Column, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame, dict]:
    """(rows, rejects, counts). ``parse(text)`` gives the rows (``schema``) of a file or raises; the whole file is then
    a reject (file_path, error_time, reason) and gives no rows. Null texts are rejects. Files are read once: what the
    pass finds is stored, counts (files, parsed, rejected, rows) are observed on the way."""
    kind = T._parse_datatype_string(schema)
    out = T.StructType().add("file_path", "string").add("reason", "string").add("rows", T.ArrayType(kind))
    arrow = pa.schema([("file_path", pa.string()), ("reason", pa.string()), ("rows", _arrow(T.ArrayType(kind)))])
    names = kind.names

    def run(batches):
        for batch in batches:
            found = []
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if text is None:
                        raise ValueError("no content")
                    found.append((p, None, [dict(zip(names, r, strict=True)) for r in parse(text)]))
                except Exception as x:  # a file that cannot be parsed is a result, not the end of the stage
                    found.append((p, f"{type(x).__name__}: {x}", None))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], arrow.field(i).type) for i in range(3)], schema=arrow)

    seen = Observation()
    bad = F.col("reason").isNotNull()
    one = files.select(F.col(path).cast("string"), content).mapInArrow(run, out).observe(seen, F.count(F.lit(1)).alias("files"), F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("rejected"), F.coalesce(F.sum(F.size(F.coalesce("rows", F.array().cast(T.ArrayType(kind))))), F.lit(0)).alias("rows"))
    one = stored(one, "parsed")
    rows = one.where(~bad).select("file_path", F.explode("rows").alias("r")).select("file_path", "r.*")
    return rows, one.where(bad).select("file_path", clock.alias("error_time"), "reason"), seen.get


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
