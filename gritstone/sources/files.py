"""Sources and sinks. Paths are Spark paths of any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import claim_id_of, document_type, flatten_path


def rtl_files(spark: SparkSession, root: str) -> DataFrame:
    """.v, .sv and .svh below a folder: path, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{v,sv,svh}").load(root)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"), "length", pipeline_id(F.col("path")).alias("pipeline_id"))


def pipeline_id(path):
    """The folder after rtl-sources/."""
    return F.regexp_extract(path, r"rtl-sources/([^/]+)/", 1)


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole files with their type."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return raw.withColumn("document_type", document_type(F.col("path")))


def filelist(lines: DataFrame, line: str = "line") -> DataFrame:
    """S3: comment, include, nested list, option or file."""
    t = F.trim(line)
    return lines.where(t != "").withColumn("kind", F.when(t.startswith("//") | t.startswith("#"), "comment").when(t.startswith("+incdir+"), "include").when(t.rlike("^-[fF] "), "list").when(t.startswith("-") | t.startswith("+"), "option").otherwise("file"))


def hierarchy_lines(lines: DataFrame, group: str, at: str, line: str) -> DataFrame:
    """Depth from the indent, parent = the nearest line above with a smaller indent, by one window over depths."""
    from pyspark.sql import Window

    d = lines.where(F.trim(line) != "").withColumn("indent", F.length(line) - F.length(F.ltrim(line))).withColumn("name", F.trim(line))
    above = F.collect_list(F.struct("indent", "name")).over(Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_above", above)
    # Walk up: keep, from the last line to the first, each one whose indent is below the least so far.
    up = F.aggregate(F.reverse("_above"), F.struct(F.col("indent").alias("least"), F.array().cast("array<string>").alias("names")), lambda acc, x: F.when(x["indent"] < acc["least"], F.struct(x["indent"].alias("least"), F.concat(F.array(x["name"]), acc["names"]).alias("names"))).otherwise(acc))["names"]
    return d.withColumn("parents", up).select(group, at, "name", F.element_at(F.when(F.size("parents") > 0, F.col("parents")), -1).alias("parent"), F.concat_ws(".", F.concat("parents", F.array("name"))).alias("path"), F.size("parents").alias("depth"))


def archive_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Flat names; hidden, system and unknown files go."""
    base = F.element_at(F.split(name, "/"), -1)
    return names.where(~base.startswith(".") & ~F.contains(F.col(name), F.lit("__MACOSX")) & (document_type(F.col(name)) != "other")).withColumn("flat", flatten_path(F.col(name)))


def to_jsonl(edges: DataFrame, path: str) -> None:
    """Fields in alphabetical order."""
    edges.select(*sorted(edges.columns)).write.mode("overwrite").json(path)


def hierarchy_csv(tree: DataFrame) -> DataFrame:
    """Slash-joined lists."""
    return tree.select(F.col("path").alias("Hierarchy"), F.col("module").alias("Module"), *[F.concat_ws("/", c).alias(n) for c, n in (("clocks", "Clock"), ("resets", "Reset"), ("memories", "Memory_Instances"))])


def markdown_report(edges: DataFrame, group: str, line: str, cap: int = 20) -> DataFrame:
    """A section a group with its first ``cap`` lines (the report's limit) and the number of all."""
    g = edges.groupBy(group).agg(F.slice(F.array_sort(F.collect_set(line)), 1, cap).alias("l"), F.count(F.lit(1)).alias("n"))
    return g.select(group, F.concat(F.lit("## "), F.col(group), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("markdown"))


def upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str], partition: str) -> None:
    """Replaces the partitions of ``new`` in one commit; a key stands once."""
    new.dropDuplicates(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_where(df: DataFrame, **equal) -> DataFrame:
    """What stays after a delete by filter; an empty filter is refused."""
    if not equal or any(v in (None, "") for v in equal.values()):
        raise ValueError("a delete needs a full filter")
    hit = F.lit(True)
    for k, v in equal.items():
        hit = hit & (F.col(k) == v)
    return df.where(~F.coalesce(hit, F.lit(False)))


def backfill(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no sidecar yet."""
    return keys.join(done.select(key).distinct(), key, "left_anti")


def drained(messages: DataFrame) -> DataFrame:
    """Each message once, counted by error."""
    return messages.dropDuplicates(["message_id"]).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


def bi_rows(log: DataFrame) -> DataFrame:
    """Flat rows with defaults and types."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return log.select(text("query_id").alias("query_id"), text("query_text").alias("query_text"), F.coalesce("search_type", F.lit("unknown")).alias("search_type"), whole("response_time_ms").alias("response_time_ms"), whole("citation_count").alias("citation_count"))


def fresh(cache: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Entries of a result cache that have not run out."""
    return cache.where(F.col("stored_at") + F.make_interval(secs=F.lit(ttl_seconds)) > now)


def point_id(*columns: str):
    return claim_id_of(*columns)
