"""Claims from RTL text in one table: constants, enums, functions and tasks of packages, parameters of
modules, wires, parameter overrides, port bindings, endpoint grids, labels and places of generate blocks.

Each emitter finds its declarations by one pattern over texts without comments and makes sentences from columns; the
table is their union with an id by pipeline, file and the sentence's beginning, each id once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import generate
from .spans import matches, passed

# The forms of declarations, what names say of wires, tiles by place, and how many constants a summary
# names.
_TYPES = "int|integer|logic|bit|string|shortint|longint|byte"
PACKAGE, MODULE = r"\bpackage\s+(\w+)", r"\bmodule\s+(\w+)\s*(?:#\s*\(|[\(\;])"
LOCALPARAM = rf"\blocalparam\s+(?:(?:{_TYPES})\b)?\s*(?:unsigned\s+)?(?:\[[^\]]*\]\s*)?(\w+)\s*=\s*([^;]+);"
PARAMETER = r"\bparameter\s+(?:int|integer|logic|bit|string)?\s*(?:\[[^\]]*\]\s*)?(\w+)\s*=\s*([^;]+);"
ENUM = r"(?s)typedef\s+enum\s+(?:logic|bit|int)?\s*(?:\[[^\]]*\]\s*)?\{([^}]+)\}\s*(\w+)\s*;"
INNER_PARAMETER = rf"\bparameter\s+(?:(?:{_TYPES}|real|signed|unsigned)\s+)*(?:\[[^\]]*\]\s*)?(\w+)\s*=\s*([^;,]+)"
HEAD_PARAMETER = rf"(?s)^\s*(?:(?:{_TYPES}|real|signed|unsigned)\s+)*(?:\[[^\]]*\]\s*)?(\w+)\s*=\s*(.+)$"
WIRE_TYPED = r"\b(wire|logic|reg)\s+((?:\w+::)?\w+)\s+(\w+)\s*((?:\[[^\]]+\])+)\s*;"
WIRE_RANGED = r"\b(logic|wire|reg)\s+\[([^\]]+)\]\s+(\w+)\s*((?:\[[^\]]+\])+)\s*;"
WIRE_BARE = r"(?m)^[ \t]*((?:\w+::)?\w+_t)\s+((?:\[[^\]]+\]\s*)*)(\w+)\s*((?:\[[^\]]+\])+)\s*;"
PURPOSES = [("clock_routing", "clock distribution"), ("de_to_t6", "dispatch-to-tensix feedthrough"), ("t6_to_de", "tensix-to-dispatch feedthrough"), ("edc_", "EDC ring connection"), ("noc_", "NoC interconnect"), ("axi_", "AXI bus connection"), ("apb_", "APB bus connection"), ("prtn", "power partition chain")]
FUNCTION = r"(?s)(?:(automatic|static)\s+)?\bfunction\s+(automatic\s+|static\s+)?((?:(?:void|int|integer|logic|bit|byte|shortint|longint|string|real)(?:\s+(?:unsigned|signed))?(?:\s*\[[^\]]*\])*|(?:\w+)))\s+(\w+)\s*\(([^)]*)\)\s*;"
TASK = r"(?s)(?:(automatic|static)\s+)?\btask\s+(automatic\s+|static\s+)?(\w+)\s*\(([^)]*)\)\s*;"
ENDS = "endfunction"
ARGUMENT = r"^(?:(\w+)(?:\s+(?:unsigned|signed))?(?:\s*\[[^\]]*\])*\s+)?(\w+)\s*$"
LISTED, SHORT_BODY, SHORT_RETURN, GRID_LISTED = 30, 20, 60, 10
TILES = {(0, 4): "NOC2AXI_NE_OPT", (1, 4): "NOC2AXI_ROUTER_NE_OPT", (2, 4): "NOC2AXI_ROUTER_NW_OPT", (3, 4): "NOC2AXI_NW_OPT", (0, 3): "DISPATCH_E", (3, 3): "DISPATCH_W", (1, 3): "ROUTER", (2, 3): "ROUTER"}


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _rows(found: DataFrame, text: Column, topic: str, source: str, owner: str = "owner") -> DataFrame:
    return found.select("path", F.col(owner).alias("module_name"), text.alias("claim_text"), F.lit(topic).alias("topic"), F.lit(source).alias("parser_source")).where("claim_text is not null")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _found(clean: DataFrame, pattern: str, groups: int) -> DataFrame:
    return matches(clean, "path", "text", pattern, groups).join(clean.select("path", "owner"), "path")


def constants(packages: DataFrame) -> DataFrame:
    """Each constant of a package, the last value of a name, and one sentence for all, by first appearance."""
    found = _found(packages, LOCALPARAM, 2).select("path", "owner", "start", F.col("g1").alias("name"), _trim(F.col("g2")).alias("value"))
    each = found.groupBy("path", "owner", "name").agg(F.min("start").alias("at"), F.max_by("value", "start").alias("value"))
    both = F.array_sort(F.collect_list(F.struct("at", _say(F.col("name"), " = ", F.col("value")).alias("t"))))
    every = each.groupBy("path", "owner").agg(F.transform(both, lambda x: x["t"]).alias("l"))
    n = F.size("l")
    more = F.when(n > LISTED, _say(" ... and ", n - LISTED, " more")).otherwise("")
    summary = _rows(every, _say("Package '", F.col("owner"), "' defines ", n, " localparam constants: ", F.array_join(F.slice("l", 1, LISTED), ", "), more), "PackageConfig", "package_extractor")
    return summary.unionByName(_rows(each, _say("Package '", F.col("owner"), "' defines localparam ", F.col("name"), " = ", F.col("value")), "PackageConfig", "package_extractor"))


def package_parameters(packages: DataFrame) -> DataFrame:
    return _rows(_found(packages, PARAMETER, 2), _say("Package '", F.col("owner"), "' defines parameter ", F.col("g1"), " = ", _trim(F.col("g2"))), "PackageConfig", "package_extractor")


def enums(packages: DataFrame) -> DataFrame:
    """Members with the values that are written."""
    member = r"^(\w+)\s*(?:=\s*([^,\s]+))?"
    parts = F.filter(F.transform(F.split("g1", ","), lambda p: _trim(p)), lambda p: p.rlike(member))
    named = F.transform(parts, lambda p: F.concat(F.regexp_extract(p, member, 1), F.when(F.regexp_extract(p, member, 2) != "", F.concat(F.lit("="), F.regexp_extract(p, member, 2))).otherwise("")))
    found = _found(packages, ENUM, 2).withColumn("members", named).where(F.size("members") > 0)
    return _rows(found, _say("Package '", F.col("owner"), "' defines typedef enum '", F.col("g2"), "' with ", F.size("members"), " members: ", F.array_join("members", ", ")), "PackageConfig", "package_extractor")


def _arguments(raw: Column, directed: bool) -> Column:
    """The arguments of a list as they are said; a type or direction holds until another is given."""
    parts = F.filter(F.transform(F.split(raw, r",(?![^\[]*\])"), lambda p: _trim(p)), lambda p: p != "")
    way = r"^(input|output|inout|ref)\s+"

    def add(acc, p):
        given = F.regexp_extract(p, way, 1)
        rest = F.regexp_replace(p, way, "")
        fits = rest.rlike(ARGUMENT)
        words = F.split(rest, r"\s+")
        own = F.when(fits, F.regexp_extract(rest, ARGUMENT, 1)).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        name = F.when(fits, F.regexp_extract(rest, ARGUMENT, 2)).otherwise(F.element_at(words, -1))
        kind = F.when(own != "", own).otherwise(acc["kind"])
        to = F.when(given != "", given).otherwise(acc["way"])
        said = F.concat_ws(" ", *([to] if directed else []), kind, name)
        return F.struct(to.alias("way"), kind.alias("kind"), F.concat(acc["out"], F.array(said)).alias("out"))

    start = F.struct(F.lit("input").alias("way"), F.lit("logic").alias("kind"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(parts, start, add)["out"], ", ")


def _summary(body: Column) -> Column:
    """One line on a short body: loops, branches, what it returns, else how much it does."""
    count = lambda p: F.regexp_count(body, F.lit(p))
    lines = F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S")))
    loops, branches = count(r"\b(?:for|while|foreach|repeat)\b"), count(r"\b(?:if|case|casex|casez)\b")
    back = _trim(F.regexp_extract(body, r"\breturn\b\s+(.+?)\s*;", 1))
    parts = F.array_compact(F.array(
        F.when(loops > 0, _say(loops, " loop(s)")), F.when(branches > 0, _say(branches, " conditional(s)")),
        F.when((branches == 0) & F.contains(body, F.lit("?")) & F.contains(body, F.lit(":")), F.lit("ternary expression")),
        F.when(back != "", F.when(F.length(back) <= SHORT_RETURN, _say("returns ", back)).otherwise("returns computed value")),
    ))
    sets = count(r"<=|=(?!=)")
    said = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).when(sets > 0, _say(sets, " assignment(s)")).otherwise(_say(lines, " statement(s)"))
    return F.when((lines > 0) & (lines <= SHORT_BODY), _say(". Summary: ", said)).otherwise("")


def functions_and_tasks(files: DataFrame) -> DataFrame:
    """Heads of functions and tasks outside modules, with a line on bodies of up to 20 lines of functions.

    What stands before a head is counted by a running sum. Texts are cut at ``endfunction`` once, and a head meets the
    piece that it stands in, so that no head carries its file."""
    word = matches(files, "path", "text", r"\b(?:end)?module\b").select("path", F.col("end").alias("at"), F.when(F.col("g0") == "module", 1).otherwise(-1).alias("n"))
    shut = matches(files, "path", "text", rf"\b{ENDS}\b").select("path", (F.col("start") + 1).alias("at"), F.lit(1).alias("n"))
    pieces = files.select("path", F.posexplode(F.split("text", rf"\b{ENDS}\b", -1)).alias("piece", "body"))
    order = Window.partitionBy("path").orderBy("piece")
    pieces = pieces.withColumn("from", F.sum(F.length("body") + len(ENDS)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("body") - len(ENDS))
    # The last piece has no end.
    pieces = pieces.withColumn("_next", F.lead("piece").over(order)).where("_next is not null").drop("_next")
    out = []
    for pattern, groups, name, args in ((FUNCTION, 5, "g4", "g5"), (TASK, 4, "g3", "g4")):
        found = _found(files, pattern, groups)
        found = passed(found, word, "path", "start", "deep").where("deep <= 0")
        qualifier = F.coalesce(F.when(F.col("g1") != "", F.col("g1")), F.when(_trim(F.col("g2")) != "", _trim(F.col("g2"))))
        tag = F.coalesce(F.concat(F.lit(" ["), qualifier, F.lit("]")), F.lit(""))
        if groups == 5:
            found = passed(found, shut, "path", "end", "piece").join(pieces, ["path", "piece"], "left")
            body = _trim(F.substring("body", (F.col("end") - F.col("from") + 1).cast("int"), F.length("body")))
            text = _say("Package '", F.col("owner"), "' defines function '", F.col(name), "(", _arguments(F.col(args), False), ") → ", F.regexp_replace(_trim(F.col("g3")), r"\s+", " "), "'", tag, F.coalesce(_summary(body), F.lit("")))
        else:
            text = _say("Package '", F.col("owner"), "' defines task '", F.col(name), "(", _arguments(F.col(args), True), ")'", tag)
        out.append(_rows(found, text, "PackageFunction", "package_function_extractor"))
    return out[0].unionByName(out[1])


def _value(raw: Column) -> Column:
    """Up to the first comma that stands in no parentheses."""
    pieces = F.split(raw, ",")
    level = lambda s: F.regexp_count(s, F.lit(r"\(")) - F.regexp_count(s, F.lit(r"\)"))
    n = F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit(0).alias("deep"), F.lit(False).alias("done")), lambda acc, p: F.when(acc["done"], acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["deep"] + level(p)).alias("deep"), (acc["deep"] + level(p) == 0).alias("done"))))["n"]
    return _trim(F.array_join(F.slice(pieces, 1, n), ","))


def module_parameters(modules: DataFrame) -> DataFrame:
    """Parameters of a module's head, then those inside that the head does not have."""
    body = F.regexp_extract("text", r"(?s)\bmodule\s+\w+(.*?)(?:\bendmodule\b|\z)", 1)
    own = modules.select("path", "owner", body.alias("text"))
    head = own.select("path", "owner", F.posexplode(F.split(F.regexp_extract("text", r"(?s)#\s*\((.*?)\)\s*\(", 1), r"\bparameter\b")).alias("at", "x")).where(F.col("x").rlike(HEAD_PARAMETER))
    head = head.select("path", "owner", F.regexp_extract("x", HEAD_PARAMETER, 1).alias("name"), _value(F.regexp_extract("x", HEAD_PARAMETER, 2)).alias("value"), F.lit(0).alias("side"), F.col("at").cast("long").alias("at"))
    parts = F.split("text", r"\)\s*;", 2)
    inner = own.withColumn("text", F.coalesce(F.get(parts, 1), F.col("text")))
    inner = _found(inner, INNER_PARAMETER, 2).select("path", "owner", F.col("g1").alias("name"), _trim(F.col("g2")).alias("value"), F.lit(1).alias("side"), F.col("start").alias("at"))
    # In the head the last of a name counts, inside the first.
    first = Window.partitionBy("path", "name").orderBy("side", F.when(F.col("side") == 0, -F.col("at")).otherwise(F.col("at")))
    each = head.unionByName(inner).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return _rows(each, _say("Module '", F.col("owner"), "' defines parameter ", F.col("name"), " = ", F.col("value")), "TopLevelParameter", "package_extractor")


def wires(modules: DataFrame, structs: list[str] | None = None) -> DataFrame:
    """Arrays of wires, of a type, of a range or of a bare type; of a signal the first sentence counts."""
    lower = F.lower("g3")
    purpose = F.lit("general interconnect")
    for part, said in reversed(PURPOSES):
        purpose = F.when(F.contains(lower, F.lit(part)), F.lit(said)).otherwise(purpose)
    dims = F.transform(F.regexp_extract_all("g4", F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))
    shape = _say("[", F.array_join(dims, ", "), "] (", F.array_join(dims, "×"), " array)")
    known = F.lit(False) if not structs else F.col("kind").isin(structs)
    ref = F.when(known, _say(" [references struct ", F.col("kind"), "]")).otherwise("")
    typed = _say("Wire '", F.col("g3"), "' of type '", F.col("kind"), "' with dimensions ", shape, " for ", purpose, ref)
    plain = _say("Wire '", F.col("g3"), "' with dimensions ", shape, " connects ", purpose)
    out = []
    for turn, pattern in enumerate((WIRE_TYPED, WIRE_RANGED, WIRE_BARE)):
        found = _found(modules, pattern, 4).withColumn("kind", F.col("g2" if turn == 0 else "g1"))
        is_type = [F.col("kind").rlike("_t$|::") | known, F.lit(False), F.lit(True)][turn]
        if turn == 0:
            found = found.where(~F.col("kind").isin("signed", "unsigned"))
        out.append(found.select("path", "owner", F.col("g3").alias("signal"), F.lit(turn).alias("turn"), "start", F.when(is_type, typed).otherwise(plain).alias("said")))
    first = Window.partitionBy("path", "signal").orderBy("turn", "start")
    each = reduce(DataFrame.unionByName, out).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return _rows(each, F.col("said"), "WireTopology", "wire_declaration_parser")


def tile_type(x: Column, y: Column) -> Column:
    out = F.when(y <= 2, "TENSIX").otherwise("UNKNOWN")
    for (a, b), kind in TILES.items():
        out = F.when((x == a) & (y == b), kind).otherwise(out)
    return out


def endpoint_grid(sizes: DataFrame, key: str, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """P20: (key, x, y, ep, tile_type) of each grid, and (key, summary), which names the first ten. Sizes of no extent
    make no grid."""
    own = sizes.where((F.col(x) > 0) & (F.col(y) > 0)).select(key, F.col(x).cast("long").alias("nx"), F.col(y).cast("long").alias("ny"))
    cells = own.select(key, "nx", "ny", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") * F.col("ny") - 1)).alias("ep"))
    cells = cells.select(key, F.floor(F.col("ep") / F.col("ny")).alias("x"), (F.col("ep") % F.col("ny")).alias("y"), "ep")
    cells = cells.withColumn("tile_type", tile_type(F.col("x"), F.col("y")))
    n = F.col("nx") * F.col("ny")
    at = lambda e: (F.floor(e / F.col("ny")), e % F.col("ny"))
    listed = F.transform(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(GRID_LISTED)) - 1), lambda e: _say("EP", e, "=(", at(e)[0], ",", at(e)[1], ") ", tile_type(*at(e))))
    more = F.when(n > GRID_LISTED, _say(", ... (", n - GRID_LISTED, " more)")).otherwise("")
    return cells, own.select(key, _say("EP Index Table: ", F.col("nx"), "×", F.col("ny"), "=", n, " endpoints. ", F.array_join(listed, ", "), more).alias("summary"))


def grid_claims(packages: DataFrame) -> DataFrame:
    size = lambda c: F.regexp_extract("text", rf"\blocalparam\b[^;]*\b{c}\s*=\s*(\d+)", 1).try_cast("long")
    own = packages.select("path", "owner", size("SizeX").alias("sx"), size("SizeY").alias("sy"))
    cells, every = endpoint_grid(own, "path", "sx", "sy")
    one = _say("Endpoint EP=", F.col("ep"), " at position (X=", F.col("x"), ", Y=", F.col("y"), ") is tile type ", F.col("tile_type"))
    named = lambda df: df.join(own.select("path", "owner"), "path")
    return _rows(named(cells), one, "PackageConfig", "ep_index_table").unionByName(_rows(named(every), F.col("summary"), "PackageConfig", "ep_index_table"))


def instance_claims(parsed: DataFrame) -> DataFrame:
    """Port bindings and parameter overrides of instances, from parsed modules."""
    i = parsed.select("path", F.col("module").alias("owner"), F.explode("instances").alias("i"))
    bound = i.select("path", "owner", "i", F.explode("i.bindings").alias("b"))
    over = i.select("path", "owner", "i", F.explode("i.overrides").alias("o"))
    binding = _say("Instance '", F.col("i.name"), "' of module '", F.col("i.module"), "' binds port '", F.col("b.port"), "' to signal '", F.col("b.expr"), "'")
    override = _say("Instance '", F.col("i.name"), "' overrides ", F.col("o.name"), "=", F.col("o.value"))
    return _rows(bound, binding, "PortBinding", "port_binding_parser").unionByName(_rows(over, override, "InstanceParameter", "port_binding_parser"))


def rtl_claims(files: DataFrame, parsed: DataFrame, pipeline: str, structs: list[str] | None = None) -> DataFrame:
    """The one table: (claim_id, claim_type, claim_text, module_name, topic, pipeline_id, file_path, confidence_score,
    parser_source) of files (path, content), of which ``parsed`` holds the modules. Null contents claim nothing."""
    clean = files.select("path", T.strip_comments(F.col("content")).alias("text")).where("text is not null")
    name = lambda p: F.regexp_extract("text", p, 1)
    packages = clean.withColumn("owner", name(PACKAGE)).where("owner <> ''")
    modules = clean.withColumn("owner", F.when(name(MODULE) != "", name(MODULE)).otherwise("unknown"))
    labels = generate.labelled_blocks(clean, "path", "text").join(modules.select("path", "owner"), "path")
    labels = _rows(labels, generate.label_claim(F.col("owner")), "Hierarchy", "generate_block_parser")
    every = [constants(packages), package_parameters(packages), enums(packages), functions_and_tasks(packages), grid_claims(packages), module_parameters(modules.where("owner <> 'unknown'")), wires(modules, structs), instance_claims(parsed), labels]
    rows = reduce(DataFrame.unionByName, every)
    key = F.concat_ws(":", F.lit(pipeline), "path", F.substring("claim_text", 1, 100))
    rows = rows.select(F.substring(F.sha2(key.cast("binary"), 256), 1, 16).alias("claim_id"), F.lit("structural").alias("claim_type"), "claim_text", "module_name", "topic", F.lit(pipeline).alias("pipeline_id"), F.col("path").alias("file_path"), F.lit(1.0).alias("confidence_score"), "parser_source")
    one = F.struct(*[c for c in rows.columns if c != "claim_id"])
    return rows.groupBy("claim_id").agg(F.min(one).alias("c")).select("claim_id", "c.*")
