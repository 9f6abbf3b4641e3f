"""Generate loops of RTL as windows over lines and column functions over block bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import closing, matches, owners, upcoming

# The form of a loop, and of the wirings of a block with its loop variables {p} and {s}.
LOOP = r"\bfor\s*\(\s*(?:(?:genvar|int|integer)\s+)?(\w+)\s*=\s*([^;]+);\s*\1\s*([<>=!]+)\s*([^;]+);\s*([^)]+)\)"
LABEL = r"\bbegin\s*:\s*(\w+)"
FEEDTHROUGH = r"(?:assign\s+)?(\w+)\s*\[{p}\]\s*=\s*\({p}\s*==\s*0\s*\)\s*\?\s*(\w+)\s*:\s*(\w+)\[{p}\s*-\s*1\]"
RING = r"(?s)(\w+)\s*\[\s*\w+\s*-\s*1\s*\].*?(\w+)\s*\[\s*0\s*\]"
DAISY = r"(\w+)(?:\[[^\]]*\])*\s*\[\s*{p}\s*\+\s*1\s*\]\s*=\s*(\w+)(?:\[[^\]]*\])*\s*\[{p}\]"
NEXT = r"(\w+)(?:\[[^\]]*\])*\s*\[\s*{p}\s*\+\s*1\s*\]"
SAME = r"(?:\[[^\]]*\])*\s*\[\s*{p}\s*\]"
GRIDS = [r"(\w+)\s*\[{s}\]\s*\[{p}\]", r"(\w+)\s*\[{p}\]\s*\[{s}\]", r"(\w+)\s*\[\s*{s}\s*\]\s*\[\s*{p}\s*\]\s*\.\s*\w+", r"(\w+)\s*\[\s*{p}\s*\]\s*\[\s*{s}\s*\]\s*\.\s*\w+"]
ANY = r"(\w+)\s*\[\s*{p}[^\]]*\]"


def active_loops(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, line, loops) of lines inside ``for`` loops, outermost first, from texts without comments.

    The depth of ``begin`` and ``end`` never falls below zero: it is the running sum less its least value so far. A
    loop of depth D ends at the first line from its own on whose ``end`` leaves less than D. A line says which depths it
    closes, so that the end is found per file and depth by one window, and lines and loops never meet in pairs."""
    broken = F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    lines = files.select(key, F.posexplode(broken).alias("at", "raw")).select(key, (F.col("at") + 1).alias("line"), "raw").where(F.col("raw").rlike(r"\S"))
    count = lambda word: F.regexp_count("raw", F.lit(rf"\b{word}\b"))
    got = lambda i: F.trim(F.regexp_extract("raw", LOOP, i))
    loop = F.when(F.col("raw").rlike(LOOP), F.struct(got(1).alias("variable"), got(2).alias("lower_bound"), got(4).alias("upper_bound"), got(5).alias("step"), F.regexp_extract("raw", LABEL, 1).alias("label")))
    facts = lines.select(key, "line", count("begin").alias("b"), count("end").alias("e"), loop.alias("loop"))
    order = Window.partitionBy(key).orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = facts.withColumn("sum", F.sum(F.col("b") - F.col("e")).over(so_far)).withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    facts = facts.withColumn("peak", F.lag("after", 1, 0).over(order) + F.col("b")).withColumn("last", F.max("line").over(Window.partitionBy(key)))
    closes = F.when((F.col("e") > 0) & (F.col("peak") > F.col("after")), F.sequence(F.col("after") + 1, F.col("peak")))
    ends = facts.where(closes.isNotNull()).select(key, F.explode(closes).alias("depth"), "line", F.col("line").alias("end"), F.lit(None).cast(facts.schema["loop"].dataType).alias("loop"), "last")
    starts = facts.where("loop is not null").select(key, F.col("peak").alias("depth"), "line", F.lit(None).cast("int").alias("end"), "loop", "last")
    ahead = Window.partitionBy(key, "depth").orderBy(F.desc("line"), F.col("end").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = starts.unionByName(ends).withColumn("until", F.coalesce(F.last("end", ignorenulls=True).over(ahead), "last")).where("loop is not null")
    inside = spans.select(key, F.explode(F.sequence("line", "until")).alias("inner"), F.struct(F.col("line").alias("start_line"), "loop").alias("x"))
    inside = inside.withColumnRenamed("inner", "line").groupBy(key, "line").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["loop"].withField("start_line", x["start_line"])).alias("loops"))
    return inside.join(lines.select(key, "line"), [key, "line"], "left_semi")


def topology(body: Column, primary: Column, secondary: Column) -> dict[str, Column]:
    """Pattern and signal of a block's wiring: feedthrough, ring, daisy-chain, 2D array, else unknown; the first
    that fits counts. ``secondary`` is null where there is one loop. Variables are identifiers."""

    def form(pattern: str) -> Column:
        filled = F.replace(F.lit(pattern), F.lit("{p}"), primary)
        return F.replace(filled, F.lit("{s}"), secondary) if "{s}" in pattern else filled

    def found(pattern: str) -> Column:
        name = F.call_function("regexp_extract", body, form(pattern), F.lit(1))
        return F.when(name != "", name)

    after = found(NEXT)
    again = F.when(F.call_function("rlike", body, F.concat(F.lit(r"\Q"), after, F.lit(r"\E"), form(SAME))), after)
    tried = [("feedthrough", found(FEEDTHROUGH)), ("ring", found(RING)), ("daisy-chain", F.coalesce(found(DAISY), again)), ("2D array", F.coalesce(*[found(g) for g in GRIDS]))]
    pattern = F.coalesce(*[F.when(name.isNotNull(), F.lit(kind)) for kind, name in tried], F.lit("unknown"))
    return {"pattern": pattern, "signal": F.coalesce(*[name for _, name in tried], found(ANY), F.lit("unknown_signal"))}


def harvest_bypasses(instances: DataFrame) -> DataFrame:
    """(module, bypass_module, type) of the instances (module, of) of bus multiplexers and demultiplexers."""
    name = F.regexp_extract("of", r"(?i)(tt_edc1_serial_bus_(?:mux|demux))", 1)
    return instances.select("module", name.alias("bypass_module")).where("bypass_module <> ''").withColumn("type", F.when(F.contains(F.lower("bypass_module"), F.lit("demux")), "demux_bypass").otherwise("mux_bypass"))


# Labelled blocks, instances, the words that are no instances (of blocks, and more of labels), ports that
# carry an endpoint number, loops with a constant step, repeaters, what labels say of a place.
LABELLED = {"for": r"(?s)\bfor\s*\([^)]*\)\s*begin\s*:\s*(\w+)", "if": r"(?s)\bif\s*\([^)]*\)\s*begin\s*:\s*(\w+)"}
BRACKET = r"\b(begin|end)\b"
INSTANCE = r"(\w+)\s+(\w+)\s*\("
NO_INSTANCE = ["if", "for", "begin", "end", "assign", "always", "initial", "generate", "endgenerate", "module", "endmodule", "wire", "logic", "reg", "input", "output", "inout", "parameter", "localparam", "genvar", "else", "case", "endcase"]
NO_LABEL_INSTANCE = [*NO_INSTANCE, "function", "endfunction", "task", "endtask", "typedef", "struct", "enum", "interface", "endinterface", "class", "endclass", "package", "endpackage", "import", "export", "virtual", "static"]
ENDPOINT, ENDPOINT_WITHIN = r"\.(?:ep_id|endpoint_id|noc_endpoint_id)\s*\(\s*(\d+|[\w\*\+\-]+)\s*\)", 500
RANGE = r"\bfor\s*\(\s*genvar\s+(\w+)\s*=\s*(\w+)\s*;\s*\w+\s*<\s*(\w+)\s*;\s*\w+\s*\+\+\s*\)"
REPEATER = r"(?is)(\w*noc_repeater\w*)\s*#\s*\([^)]*\.(?:NUM_REPEATERS|NUM)\s*\(\s*(\d+)\s*\)[^)]*\)\s*(\w+)\s*\("
PLACES = [("ne_opt", "x", "1"), ("nw_opt", "x", "2"), ("se_opt", "x", "1"), ("sw_opt", "x", "2"), ("north", "y", "0"), ("south", "y", "1"), ("east", "x", "0"), ("west", "x", "1")]


def labelled_blocks(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, label, parent_label, hierarchy_path, block_type, start, body_start, end, instances) of the labelled
    generate blocks of texts without comments; a block that is never closed runs to the end.

    Blocks find the ``end`` that closes them by bracket matching, and parents, paths and the innermost block of an
    instance by a sweep. Blocks of one label stay apart: a parent is the block around, not one of that name."""
    files = files.select(key, F.col(text).alias("text"))
    total = files.select(key, F.length("text").cast("long").alias("total"))
    heads = None
    for kind, pattern in LABELLED.items():
        found = matches(files, key, "text", pattern, 1).select(key, "start", F.col("end").alias("body_start"), F.col("g1").alias("label"), F.lit(kind).alias("block_type"))
        heads = found if heads is None else heads.unionByName(found)
    words = matches(files, key, "text", BRACKET).select(key, "start", F.col("end").alias("shut"), F.col("g0").alias("word"))
    paired = closing(words, key, "start", F.col("word") == "begin", "shut").where("word = 'begin'").select(key, F.col("start").alias("begins"), F.col("close"))
    # A head holds just one ``begin``, its last before the label: the next one that its brackets meet.
    begins = heads.select(key, "start", "body_start", "label", "block_type")
    heads = upcoming(begins, paired.select(key, F.col("begins").alias("start"), F.col("begins").alias("end"), F.struct("begins", "close").alias("bracket")), key, 1 << 30, "bracket")
    heads = heads.join(total, key).select(key, "start", F.col("body_start").cast("long").alias("lo"), F.coalesce("bracket.close", "total").cast("long").alias("hi"), "label", "block_type")
    spans = heads.select(key, "lo", "hi", F.struct("label", "lo").alias("of"))
    placed = owners(spans, heads.select(key, F.col("lo").alias("at"), "hi", "start", "label", "block_type"), key, path=True, upto="hi")
    instance = matches(files, key, "text", INSTANCE, 2)
    instance = instance.where(~F.col("g1").isin(NO_LABEL_INSTANCE) & ~F.col("g2").isin(NO_LABEL_INSTANCE) & ~F.col("g1").rlike("^[0-9]") & ~F.col("g2").rlike("^[0-9]"))
    inside = owners(spans, instance.select(key, F.col("start").cast("long").alias("at"), F.col("g2").alias("name")), key).where("owner is not null")
    inside = inside.groupBy(key, F.col("owner.lo").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("instances"))
    labels = F.transform("around", lambda x: x["label"])
    return placed.join(inside, [key, "at"], "left").select(
        key, "label", F.col("owner.label").alias("parent_label"), F.array_join(F.concat(labels, F.array("label")), "/").alias("hierarchy_path"), "block_type",
        F.col("start").cast("long").alias("start"), F.col("at").alias("body_start"), F.col("hi").alias("end"), F.coalesce("instances", F.array().cast("array<string>")).alias("instances"),
    )


def label_claim(module: Column) -> Column:
    """The sentence on a row of :func:`labelled_blocks`."""
    some = F.size("instances") > 0
    tail = F.when(some, F.concat(F.lit(") contains instances: "), F.array_join("instances", ", "))).otherwise(F.concat(F.lit(") at hierarchy path '"), F.col("hierarchy_path"), F.lit("'")))
    nested = F.when(F.col("parent_label").isNotNull(), F.concat(F.lit(" [nested under '"), F.col("parent_label"), F.lit("', path: "), F.col("hierarchy_path"), F.lit("]"))).otherwise("")
    return F.concat(F.lit("Module '"), module, F.lit("' generate block '"), F.col("label"), F.lit("' ("), F.col("block_type"), tail, nested)


def _ranges(text: Column) -> Column:
    """The loops of a block in the order in which their variables first stand; a variable's last loop counts."""
    got = lambda i: F.regexp_extract_all(text, F.lit(RANGE), F.lit(i))
    loops = F.transform(F.arrays_zip(got(1).alias("name"), got(2).alias("start"), got(3).alias("limit")), lambda x: F.struct(F.lower(x["name"]).alias("low"), x["name"].alias("name"), x["start"].alias("start"), x["limit"].alias("limit")))
    return F.transform(F.array_distinct(F.transform(loops, lambda x: x["name"])), lambda n: F.element_at(F.filter(loops, lambda x: x["name"] == n), -1))


def _axis(low: Column, axis: str) -> Column:
    names = {"x": ("col", "c"), "y": ("row", "r")}
    return F.contains(low, F.lit(axis)) | low.isin(*names[axis])


def instance_positions(blocks: DataFrame, key: str = "block", text: str = "content") -> DataFrame:
    """P25: (key, label, instance, module_type, x, y, ep, tile_type) of the instances of generate blocks: places by the
    ranges of loop variables, else by what the first label says, endpoint numbers by the next port within 500 places."""
    rows = blocks.select(key, F.col(text).alias("text"), F.regexp_extract(text, LABEL, 1).alias("label"), _ranges(F.col(text)).alias("ranges"))
    label = F.lower("label")

    def of_loops(mine: Column) -> Column:
        last = F.get(mine, F.size(mine) - 1)
        return F.when(last.isNotNull(), F.concat(F.lit("0.."), last["limit"]))

    x_loops = F.filter("ranges", lambda r: _axis(r["low"], "x"))
    y_loops = F.filter("ranges", lambda r: ~_axis(r["low"], "x") & _axis(r["low"], "y"))
    said = F.lit(None).cast("struct<axis:string,at:string>")
    for word, axis, at in reversed(PLACES):
        said = F.when(F.contains(label, F.lit(word)), F.struct(F.lit(axis).alias("axis"), F.lit(at).alias("at"))).otherwise(said)
    rows = rows.withColumn("said", said)
    by_label = lambda axis: F.when(F.col("said.axis") == axis, F.col("said.at"))
    rows = rows.withColumn("x", F.coalesce(of_loops(x_loops), by_label("x"), F.lit("UNKNOWN"))).withColumn("y", F.coalesce(of_loops(y_loops), by_label("y"), F.lit("UNKNOWN")))
    indexes = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\s*(\d+)\s*\]"), F.lit(1))))
    router = F.contains(label, F.lit("router"))
    two_rows = router & (F.col("y") != "UNKNOWN") & (F.size(indexes) >= 2)
    rows = rows.withColumn("y", F.when(two_rows, F.array_join(F.slice(indexes, 1, 2), "+")).otherwise(F.col("y")))
    found = matches(rows, key, "text", INSTANCE, 2).where(~F.col("g1").isin(NO_INSTANCE) & ~F.col("g2").isin(NO_INSTANCE))
    ports = matches(rows, key, "text", ENDPOINT, 1).select(key, "start", "end", F.col("g1").alias("ep"))
    found = upcoming(found.select(key, "start", F.col("g1").alias("module_type"), F.col("g2").alias("instance")), ports, key, ENDPOINT_WITHIN, "ep")
    bridge = F.contains(F.lower("label"), F.lit("noc2axi")) | F.contains(F.lower("module_type"), F.lit("noc2axi"))
    tile = F.when(bridge, "NOC2AXI").when(F.contains(F.lower("label"), F.lit("router")), "router").otherwise("tile")
    return found.join(rows.select(key, "label", "x", "y"), key).select(key, "label", "instance", "module_type", "x", "y", F.coalesce("ep", F.lit("UNKNOWN")).alias("ep"), tile.alias("tile_type"))


def position_claim() -> Column:
    """The sentence on a row of :func:`instance_positions`."""
    return F.concat(F.lit("Generate block '"), F.col("label"), F.lit("' at (X="), F.col("x"), F.lit(", Y="), F.col("y"), F.lit(") instantiates '"), F.col("module_type"), F.lit("' with EP="), F.col("ep"), F.lit(" ("), F.col("tile_type"), F.lit(")"))


def repeaters(blocks: DataFrame, key: str = "block", text: str = "content") -> DataFrame:
    """P25: (key, instance, stages, y, x_from, x_to) of the network repeaters of generate blocks."""
    rows = blocks.select(key, F.col(text).alias("text"), F.lower(F.regexp_extract(text, LABEL, 1)).alias("label"), _ranges(F.col(text)).alias("ranges"))
    first = lambda axis: F.get(F.filter("ranges", lambda r: _axis(r["low"], axis)), 0)
    near = F.contains("label", F.lit("col_0")) | F.contains("label", F.lit("east"))
    far = F.contains("label", F.lit("col_1")) | F.contains("label", F.lit("west"))
    ends = [F.when(near, a).when(far, b).otherwise(F.coalesce(first("x")[part], F.lit(b))) for part, a, b in (("start", "0", "1"), ("limit", "1", "2"))]
    found = matches(rows, key, "text", REPEATER, 3)
    y = F.coalesce(F.concat(F.lit("0.."), first("y")["limit"]), F.lit("UNKNOWN"))
    return found.join(rows, key).select(key, F.col("g3").alias("instance"), F.col("g2").cast("long").alias("stages"), y.alias("y"), ends[0].alias("x_from"), ends[1].alias("x_to"))
