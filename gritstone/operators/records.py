"""Parse and claim records to graph nodes and edges, as projections that Spark reads in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = """analysis_type string, pipeline_id string, module_name string, file_path string, module_type string, topic string,
port_list array<struct<name:string,direction:string,bit_width:string>>,
instance_list array<struct<instance_name:string,module_type:string,generate_scope:string,hier_path:string>>,
port_name string, signal_name string, signal_expr string, expression_type string, direction string, clock_domain string"""


def _has(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def _parts(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ports, instances, port bindings and clock claims of records that name their module."""
    named = records.where(_has("module_name"))
    modules = named.where("analysis_type = 'module_parse'")
    ports = modules.select("pipeline_id", "module_name", F.explode("port_list").alias("p")).select("pipeline_id", "module_name", F.col("p.name").alias("port"), "p.direction", "p.bit_width").where(_has("port"))
    inst = modules.select("pipeline_id", "module_name", F.explode("instance_list").alias("i")).where(_has("i.instance_name"))
    path = F.coalesce("i.hier_path", F.concat_ws("/", "module_name", "i.instance_name"))
    inst = inst.select("pipeline_id", "module_name", F.col("i.instance_name").alias("instance"), path.alias("hier_path"), F.coalesce("i.module_type", "i.instance_name").alias("of"), F.coalesce("i.generate_scope", F.lit("")).alias("scope"))
    claims = named.where("analysis_type = 'claim'")
    bound = claims.where("topic = 'PortBinding'").withColumn("signal", F.coalesce("signal_name", "signal_expr")).where(_has("port_name") & _has("signal"))
    clocks = claims.where("topic = 'ClockDomain'").where(_has("signal_name") & _has("clock_domain"))
    return ports, inst, bound, clocks


def _key(*parts) -> Column:
    return F.concat_ws("/", *parts)


def nodes(records: DataFrame) -> DataFrame:
    """(pipeline_id, label, key), once each."""
    ports, inst, bound, clocks = _parts(records)
    one = lambda df, label, *key: df.select("pipeline_id", F.lit(label).alias("label"), _key(*key).alias("key"))
    found = one(records.where("analysis_type = 'module_parse'").where(_has("module_name")), "ModuleDef", "module_name")
    for df in (
        one(ports, "PortDef", "module_name", "port"),
        one(ports, "PortInstance", "module_name", "port"),
        one(inst, "Instance", "hier_path"),
        one(bound, "PortInstance", "module_name", "port_name"),
        one(bound, "Signal", "module_name", "signal"),
        one(clocks, "Signal", "module_name", "signal_name"),
        one(clocks, "ClockDomain", "clock_domain"),
    ):
        found = found.unionByName(df)
    return found.distinct()


def edges(records: DataFrame) -> DataFrame:
    """(pipeline_id, type, from_label, src, to_label, dst, note), a row each time a record says so."""
    ports, inst, bound, clocks = _parts(records)

    def one(df, type_, a, src, b, dst, note=F.lit("")):
        return df.select("pipeline_id", F.lit(type_).alias("type"), F.lit(a).alias("from_label"), _key(*src).alias("src"), F.lit(b).alias("to_label"), _key(*dst).alias("dst"), note.alias("note"))

    port, signal = ("module_name", "port_name"), ("module_name", "signal")
    out = one(ports, "DEFINES", "ModuleDef", ["module_name"], "PortDef", ["module_name", "port"])
    for df in (
        one(ports, "HAS_PORT", "Instance", ["module_name"], "PortInstance", ["module_name", "port"]),
        one(inst, "INSTANCE_OF", "Instance", ["hier_path"], "ModuleDef", ["of"], F.col("scope")),
        one(bound, "BINDS_TO", "PortInstance", port, "Signal", signal, F.coalesce("expression_type", F.lit("simple"))),
        one(bound.where("direction in ('output', 'inout')"), "DRIVES", "PortInstance", port, "Signal", signal, F.col("direction")),
        one(bound.where("direction in ('input', 'inout')"), "READS", "Signal", signal, "PortInstance", port, F.col("direction")),
        one(clocks, "BELONGS_TO", "Signal", ["module_name", "signal_name"], "ClockDomain", ["clock_domain"]),
    ):
        out = out.unionByName(df)
    return out


def export_check(edges: DataFrame, expected: list[str]) -> DataFrame:
    """How many edges there are of each expected type, and whether one is missing."""
    want = edges.sparkSession.createDataFrame([(t,) for t in expected], "type string")
    n = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return want.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("missing"))


def without_manual(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic claims of modules that have none made by hand."""
    return auto.join(manual.select("module_name").distinct(), "module_name", "left_anti")


def with_ports(modules: DataFrame, ports: DataFrame) -> DataFrame:
    """Each module with the set of its ports, empty if it has none."""
    sets = ports.groupBy("module_name").agg(F.array_sort(F.collect_set("port")).alias("ports"))
    return modules.join(sets, "module_name", "left").withColumn("ports", F.coalesce("ports", F.array().cast("array<string>")))
