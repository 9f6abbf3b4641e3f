"""Analyses of parsed facts: struct layouts, chip settings, roles, sections, graph evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that roles and settings are known by, in order of precedence.
ROLES = {
    "tt_overlay_cpu_wrapper": "cpu_cluster",
    "tt_idma_wrapper": "idma",
    "tt_rocc_accel": "rocc_accelerator",
    "tt_overlay_tile_counters": "llk_counter",
    "tt_overlay_smn_wrapper": "smn",
    "tt_fds_wrapper": "fds",
    "tt_overlay_edc_wrapper": "edc",
    "tt_overlay_memory_wrapper": "memory",
    "tt_overlay_noc_wrap": "noc_interface",
}
CHIP_WORDS = ["size", "num", "width", "depth", "count", "max", "min", "tensix", "noc", "grid", "tile", "cluster", "core"]
CPU_WORDS = ["num_cluster_cpus", "num_interrupts", "reset_vector_width", "num_harts", "num_cores", "isa_extensions"]
L1_WORDS = ["num_banks", "bank_width", "ecc_type", "sram_type", "cache_size", "line_size", "associativity", "num_ways", "num_sets"]
MOST_SKIPPED = 0.30


def flit_layouts(fields: DataFrame) -> DataFrame:
    """(struct, layout) of flit structs, from (struct, ordinal, name, bit_width, msb, lsb, ref_type): by the
    highest bit downwards, fields of unknown width last, in their order."""
    known = F.col("bit_width") > 0
    place = F.format_string("%s[%d:%d]", "name", "msb", "lsb")
    other = F.concat("name", F.when(F.coalesce("ref_type", F.lit("")) != "", F.concat(F.lit("("), "ref_type", F.lit(")"))).otherwise("(unknown width)"))
    part = F.struct((~known).alias("last"), F.when(known, -F.col("msb")).alias("down"), "ordinal", F.when(known, place).otherwise(other).alias("text"))
    found = fields.where(F.col("struct").rlike(r"(?:_flit_t|_header_t|_payload_t)\z")).groupBy("struct").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return found.select("struct", F.concat(F.lit("Flit structure '"), "struct", F.lit("' layout: "), F.array_join("parts.text", ", ")).alias("layout"))


def nested_structs(fields: DataFrame) -> DataFrame:
    """(struct, name, ref_type, truncated) of fields whose type is a struct, from (struct, name, ref_type). A
    relation is truncated where two or more structs enclose its struct and its type holds structs itself. Only two
    levels upwards decide, so two semi joins on distinct names do; circles of structs end there too."""
    structs = fields.select(F.col("struct").alias("ref_type")).distinct()
    links = fields.join(structs, "ref_type", "left_semi").select("struct", "name", "ref_type")
    up = links.where("struct <> ref_type").select("struct", "ref_type").distinct()
    inner = up.select(F.col("ref_type").alias("struct")).distinct()
    deep = up.join(inner, "struct", "left_semi").select(F.col("ref_type").alias("struct")).distinct().withColumn("deep", F.lit(True))
    holds = links.select(F.col("struct").alias("ref_type")).distinct().withColumn("holds", F.lit(True))
    marked = links.join(deep, "struct", "left").join(holds, "ref_type", "left")
    return marked.select("struct", "name", "ref_type", (F.coalesce("deep", F.lit(False)) & F.coalesce("holds", F.lit(False))).alias("truncated"))


def _has_word(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words])


def chip_config(params: DataFrame) -> DataFrame:
    """Parameters (module, name, value) that describe the chip, each with the axis of the grid that it gives."""
    axis = F.when(F.col("name") == "SizeX", "x").when(F.col("name") == "SizeY", "y")
    return params.where(_has_word(F.col("name"), CHIP_WORDS)).withColumn("axis", axis)


def settings(params: DataFrame, words: list[str]) -> DataFrame:
    """Parameters whose name holds one of the words; ``number`` where the value is an integer in any base of C
    notation, else ``text`` without quotes."""
    value = F.trim("value")
    plain = F.when(value.rlike(r"^[+-]?(?:0+|[1-9][0-9]*)\z"), value.try_cast("long"))
    number = F.when(value.rlike(r"(?i)^0x[0-9a-f]{1,15}\z"), F.conv(F.substr(value, F.lit(3)), 16, 10).cast("long")).when(value.rlike(r"(?i)^0b[01]{1,60}\z"), F.conv(F.substr(value, F.lit(3)), 2, 10).cast("long")).otherwise(plain)
    found = params.where(_has_word(F.col("name"), words)).withColumn("number", number)
    return found.withColumn("text", F.when(F.col("number").isNull(), F.regexp_replace(value, "^[\"']+|[\"']+\\z", "")))


def role_of(module: Column) -> Column:
    """Role of a module by its whole name, else by the first known name that it starts with, else null."""
    whole, start = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, role in ROLES.items():
        whole = whole.when(module == name, role)
        start = start.when(F.startswith(module, F.lit(name)), role)
    return F.coalesce(whole, start)


def skip_ratio(records: DataFrame, by: str, skipped: Column, nodes: Column) -> DataFrame:
    """Share of records skipped, whether it is beyond the limit, and whether all parsing gave no node."""
    n, out = F.count(F.lit(1)), F.count_if(skipped)
    return records.groupBy(by).agg(F.round(out / n, 6).alias("ratio"), (out / n > MOST_SKIPPED).alias("warn"), (F.coalesce(F.sum(nodes), F.lit(0)) == 0).alias("mismatch"))


def sections(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, title) of section headers. ``markdown``: one to six ``#``, blanks, a title. ``pdf``: a numbered
    heading, or a line that starts with chapter, section or appendix; form feeds at its ends do not count. Lines end
    at a line feed alone; starts are code points. Null texts have none; keys are to be unique."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "raw"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # Lengths alone move to the window; a header's title comes along, other lines' text does not.
    if kind == "markdown":
        title = F.regexp_extract(F.regexp_replace("raw", "\r+\\z", ""), r"(?s)^#{1,6}[ \t]+(\S.*?)[ \t]*\z", 1)
    else:
        line = F.regexp_replace(F.regexp_replace("raw", "\r+\\z", ""), "^\f+|\f+\\z", "")
        title = F.when(line.rlike(r"(?s)^[ \t]*[0-9]+(?:\.[0-9]+)*[ \t]+\S") | line.rlike(r"(?is)^[ \t]*(?:chapter|section|appendix)\b"), F.regexp_replace(line, r"^\s+|\s+\z", "")).otherwise("")
    sized = lines.select(key, "line", (F.length("raw") + 1).alias("n"), title.alias("title"))
    placed = sized.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    return placed.where("title <> ''").select(key, "start", "title")


def topic_neighbourhood(edges: DataFrame, topics: list[str], most: int = 20) -> DataFrame:
    """For each topic of a short list, the first edges (source, relationship, target) whose source holds the
    topic's last part in capitals. Each is a distributed top-k, not a window over one topic's rows."""
    found = [edges.where(F.contains("source", F.lit(t.split("/")[-1].upper()))).orderBy("source", "relationship", "target").limit(most).withColumn("topic", F.lit(t)) for t in topics]
    return reduce(DataFrame.unionByName, found)


def connectivity(edges: DataFrame, start: str, end: str, hops: int = 6, most: int = 10) -> DataFrame:
    """Paths of 1..hops edges (src, type, dst) from a node that holds ``start`` to one that holds ``end``; no
    edge stands twice in a path. The shortest ``most``, then by name. The last hop meets only edges to the end."""
    edge = F.struct("src", "type", "dst")
    steps = edges.select("src", "type", "dst").distinct().withColumn("edge", edge)
    now = steps.where(F.contains("src", F.lit(start))).select(F.col("dst").alias("at"), F.array("edge").alias("walk"))
    out = now
    for i in range(1, hops):
        ways = steps if i < hops - 1 else steps.where(F.contains("dst", F.lit(end)))
        now = now.join(ways, now["at"] == ways["src"]).where(~F.array_contains("walk", F.col("edge"))).select(F.col("dst").alias("at"), F.concat("walk", F.array("edge")).alias("walk"))
        out = out.unionByName(now)
    arrow = F.transform("walk", lambda e: F.concat(F.lit(" -"), e["type"], F.lit("-> "), e["dst"]))
    shown = out.where(F.contains("at", F.lit(end))).select(F.size("walk").alias("hops"), F.concat(F.col("walk")[0]["src"], F.array_join(arrow, "")).alias("path"))
    return shown.orderBy("hops", "path").limit(most)


def evidence_text(edges: DataFrame, children: DataFrame, topic: str) -> DataFrame:
    """(module, evidence), a block of text a module: how much there is, its first ten bindings (module, src,
    dst, direction) and five of at most ten paths below it (module, path)."""

    def first(df: DataFrame, by: list, n: int) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy("module").orderBy(*by))).where(F.col("_n") <= n)

    line = F.format_string("  - %s -> %s (%s)", "src", "dst", F.coalesce("direction", F.lit("")))
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda x: x[name])
    bound = first(edges.select("module", "src", "dst", line.alias("line")), ["src", "dst", "line"], 10).groupBy("module").agg(in_order("line").alias("lines"))
    many = edges.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    below = first(children, ["path"], 10).groupBy("module").agg(in_order("path").alias("paths"))
    j = many.join(bound, "module").join(below, "module", "full")
    none = F.array().cast("array<string>")
    tree = F.when(F.size("paths") > 0, F.concat(F.array(F.format_string("- Hierarchy (%d paths):", F.size("paths"))), F.transform(F.slice("paths", 1, 5), lambda p: F.concat(F.lit("  - "), p)))).otherwise(none)
    summary = F.when(F.col("n") > 0, F.concat(F.array(F.format_string("- Summary: %d bindings", "n")), F.coalesce("lines", none))).otherwise(none)
    block = F.concat(F.array(F.lit(f"[GRAPH EVIDENCE — {topic} Section]")), summary, F.coalesce(tree, none))
    return j.select("module", F.array_join(block, "\n").alias("evidence"))


def source_files(nodes: DataFrame) -> DataFrame:
    """Files of each tree in depth-first order, from (root, path array, file); nodes without a file are left out."""
    named = nodes.where(F.coalesce("file", F.lit("")) != "")
    return named.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "file"))), lambda x: x["file"]).alias("files"))
