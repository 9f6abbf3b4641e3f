"""RTL text to facts: parse once by file, then explode. The scanner works on one file at a time."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import claim_id_of, port_class
from ..functions.widths import WidthError, evaluate

_COMMENT = (re.compile(r"//[^\n]*"), re.compile(r"/\*.*?\*/", re.S))
_MODULE = re.compile(r"\bmodule\s+(\w+)")
_PARAM = re.compile(r"\b(?:parameter|localparam)\s+(?:\w+\s+)?(?:\[[^\]]*\]\s*)?(\w+)\s*=\s*([^,;)\n]+)")
_PORT = re.compile(r"\b(input|output|inout)\s+(?:(?:wire|reg|logic)\b)?\s*((?:\[[^\]]+\]\s*)*)(\w+)")
_ASSIGN = re.compile(r"\bassign\s+([\w.\[\]]+)\s*=\s*([^;]+);")
_POSEDGE = re.compile(r"always(?:_ff)?\s*@\s*\(\s*posedge\s+(\w+)")
_WIRE = re.compile(r"\b(?:wire|logic)\s+(?:(\w+)\s+)?(\w+)((?:\s*\[[^\]]+\])+)\s*;")
_ENUM = re.compile(r"enum\s+(?:[\w\[\]: -]+)?\{([^}]*)\}\s*(\w+)", re.S)
_STRUCT = re.compile(r"struct\s+packed\s*\{([^}]*)\}\s*(\w+)\s*;", re.S)
_NAMED, _ENDED = re.compile(r"\s*([A-Za-z_]\w*)\s*\("), re.compile(r"\s*;")
_FIELD = re.compile(r"(\w+)?\s*(\[[^\]]+\])?\s*(\w+)\s*$")
_KEYWORDS = {"module", "endmodule", "input", "output", "inout", "wire", "logic", "reg", "assign", "always", "always_ff", "always_comb", "if", "else", "for", "begin", "end", "case", "endcase", "function", "task", "generate", "parameter", "localparam", "typedef", "struct", "enum", "package", "posedge", "negedge", "or", "and", "not"}


def strip_comments(text: str) -> str:
    for p in _COMMENT:
        text = p.sub("", text)
    return text


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return -1


def expression_type(expr: str) -> str:
    """P11."""
    e = expr.strip()
    if e.startswith("{"):
        return "concatenation"
    return "arithmetic" if re.search(r"[-+*/]", re.sub(r"\[[^\]]*\]", "", e)) else "simple"


def bindings(body: str) -> list[dict]:
    """.port(expr) with balanced parentheses; of one port the first wins."""
    out, seen, at = [], set(), 0
    for m in re.finditer(r"\.(\w+)\s*\(", body):
        if m.start() < at:
            continue
        end = closing(body, m.end() - 1)
        if end < 0:
            break
        at = end
        if m[1] not in seen:
            seen.add(m[1])
            e = body[m.end() : end].strip()
            bit = re.search(r"\[([^\]]+)\]\s*$", e)
            out.append({"port": m[1], "expr": e, "kind": expression_type(e), "bits": bit[1] if bit else "", "parts": [x.strip() for x in e.strip("{}").split(",")] if e.startswith("{") else []})
    return out


def instances(body: str) -> list[dict]:
    """Module #(.P(v)) name (bindings);"""
    out = []
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*(#\s*\()?", body):
        if m[1] in _KEYWORDS:
            continue
        at, overrides = m.end(), []
        if m[2]:
            end = closing(body, m.end() - 1)
            if end < 0:
                continue
            overrides = bindings(body[m.end() : end])
            at = end + 1
        name = _NAMED.match(body, at)
        if not name or name[1] in _KEYWORDS or (not m[2] and at == m.start()) or not (m[2] or body[m.end(1) : m.end(1) + 1].isspace()):
            continue
        open_ = name.end() - 1
        end = closing(body, open_)
        if end < 0 or not _ENDED.match(body, end + 1):
            continue
        out.append({"module": m[1], "name": name[1], "bindings": bindings(body[open_ + 1 : end]), "overrides": [{"name": o["port"], "value": o["expr"]} for o in overrides]})
    return out


def width(text: str | None, params: dict[str, int]) -> tuple[int | None, str]:
    """Bits of [hi:lo], of several ranges their product; unresolved stays text."""
    bits, text = 1, (text or "").strip()
    for one in re.findall(r"\[([^\]]+)\]", text):
        hi, _, lo = one.partition(":")
        try:
            a, b = evaluate(hi, params), evaluate(lo or "0", params)
        except WidthError:
            return None, text
        if not isinstance(a, int) or not isinstance(b, int):
            return None, text
        bits *= abs(a - b) + 1
    return bits, text


def enum_values(body: str) -> list[dict]:
    """Explicit values reset the counter."""
    out, n = [], 0
    for item in filter(None, (x.strip() for x in body.split(","))):
        name, _, value = (x.strip() for x in item.partition("="))
        if value:
            try:
                v = evaluate(value)
                n = v if isinstance(v, int) else n
            except WidthError:
                pass
        out.append({"name": name, "value": n})
        n += 1
    return out


def struct_fields(body: str, params: dict[str, int]) -> list[dict]:
    """One field a semicolon, else the struct is dropped."""
    parts = [x.strip() for x in body.split(";")]
    fields = []
    for p in parts[:-1]:
        m = _FIELD.search(p)
        if m:
            w, _ = width(m[2], params)
            fields.append({"name": m[3], "type": m[1] or "", "width": w})
    return fields if len(fields) == len(parts) - 1 else []


def parse(text: str) -> list[dict]:
    """One record a module; a file without modules gives one with an empty name for its package facts."""
    clean = strip_comments(text or "")
    marks = list(_MODULE.finditer(clean)) or [None]
    out = []
    for i, m in enumerate(marks):
        body = clean if m is None else clean[m.start() : marks[i + 1].start() if i + 1 < len(marks) else len(clean)]
        params: dict[str, str] = {}
        for p in _PARAM.finditer(body):
            params.setdefault(p[1], p[2].strip())
        known: dict[str, int] = {}
        for k, v in params.items():
            try:
                x = evaluate(v, known)
                if isinstance(x, int):
                    known[k] = x
            except WidthError:
                pass
        ports, named = [], set()
        for p in _PORT.finditer(body):
            if p[3] in named:
                continue
            named.add(p[3])
            w, t = width(p[2], known)
            ports.append({"direction": p[1], "name": p[3], "width": w, "range": t})
        head = body.find(";")
        inner = body[head + 1 :] if m is not None else body
        out.append(
            {
                "module": m[1] if m else "",
                "params": [{"name": k, "value": v} for k, v in params.items()],
                "ports": ports,
                "instances": instances(inner),
                "assigns": [{"dst": a[1], "src": a[2].strip()} for a in _ASSIGN.finditer(inner)],
                "clocks": list(dict.fromkeys(_POSEDGE.findall(inner))),
                "wires": [{"name": w[2], "type": w[1] or "", "dims": len(re.findall(r"\[", w[3]))} for w in _WIRE.finditer(inner)],
                "enums": [{"name": e[2], "items": enum_values(e[1])} for e in _ENUM.finditer(body)],
                "structs": [{"name": s[2], "fields": f} for s in _STRUCT.finditer(body) if (f := struct_fields(s[1], known))],
            }
        )
    return out


_BIND = "array<struct<port:string,expr:string,kind:string,bits:string,parts:array<string>>>"
SCHEMA = f"path string, module string, params array<struct<name:string,value:string>>, ports array<struct<direction:string,name:string,width:long,range:string>>, instances array<struct<module:string,name:string,bindings:{_BIND},overrides:array<struct<name:string,value:string>>>>, assigns array<struct<dst:string,src:string>>, clocks array<string>, wires array<struct<name:string,type:string,dims:long>>, enums array<struct<name:string,items:array<struct<name:string,value:long>>>>, structs array<struct<name:string,fields:array<struct<name:string,type:string,width:long>>>>"


def parsed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One nested row a module."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            rows = [{"path": p, **r} for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse(t)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col(path), F.col(content)).mapInArrow(run, SCHEMA)


def ports(modules: DataFrame) -> DataFrame:
    """P2, P6."""
    p = modules.select("path", "module", F.explode("ports").alias("p")).select("path", "module", "p.direction", F.col("p.name").alias("port"), "p.width")
    return p.withColumn("class", port_class(F.col("port")))


def port_bindings(modules: DataFrame) -> DataFrame:
    """P11, G6."""
    i = modules.select("path", "module", F.explode("instances").alias("i"))
    return i.select("path", "module", F.col("i.name").alias("instance"), F.col("i.module").alias("target"), F.explode("i.bindings").alias("b")).select("path", "module", "instance", "target", "b.port", "b.expr", "b.kind")


def hierarchy_edges(modules: DataFrame) -> DataFrame:
    """INSTANTIATES between modules."""
    return modules.select(F.col("module").alias("src"), F.explode("instances").alias("i")).select("src", F.col("i.module").alias("dst"), F.col("i.name").alias("instance"))


def signal_edges(modules: DataFrame) -> DataFrame:
    """Port, assignment and declaration edges with their confidence, once by id."""
    b = port_bindings(modules).select("path", F.lit("PORT_CONNECTS_TO").alias("type"), F.concat_ws(".", "instance", "port").alias("src"), F.col("expr").alias("dst"), F.lit(0.92).alias("confidence"))
    a = modules.select("path", F.explode("assigns").alias("a")).select("path", F.lit("ASSIGNS_TO").alias("type"), "a.src", "a.dst", F.lit(0.96).alias("confidence"))
    w = modules.select("path", "module", F.explode("wires").alias("w")).select("path", F.lit("DECLARES_SIGNAL").alias("type"), F.col("module").alias("src"), F.col("w.name").alias("dst"), F.lit(0.9).alias("confidence"))
    e = b.unionByName(a).unionByName(w)
    return e.withColumn("edge_id", claim_id_of("path", "type", "src", "dst")).withColumn("class", port_class(F.concat_ws(" ", "src", "dst"))).dropDuplicates(["edge_id"])


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def widths(rows: DataFrame, expr: str, value: str) -> DataFrame:
    """Adds ``width``, the value of an expression with W given by a column, and ``unresolved``, its text if it
    has none."""
    kinds = f"{_columns(rows)}, width long, unresolved string"

    def run(batches):
        for batch in batches:
            out = []
            for e, w in zip(batch.column(batch.schema.names.index(expr)).to_pylist(), batch.column(batch.schema.names.index(value)).to_pylist()):
                try:
                    out.append(evaluate(e or "", {"W": w}))
                except WidthError:
                    out.append(e)
            known = [v if isinstance(v, int) else None for v in out]
            text = ["" if isinstance(v, int) else v for v in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, pa.int64()), pa.array(text, pa.string())], names=[*batch.schema.names, "width", "unresolved"])

    return rows.mapInArrow(run, kinds)


def memory_type(instance: Column, module: Column) -> Column:
    """Null if neither name is that of a memory; ROM before register file before SRAM."""
    n = F.lower(F.concat_ws("_", instance, module))
    return F.when(n.rlike("sram|ram|rf_|reg_file|rom|memory|mem_"), F.when(F.contains(n, F.lit("rom")), "ROM").when(n.rlike("rf_|reg_file"), "RF").otherwise("SRAM"))


def subsystem(path: Column, topic: Column) -> Column:
    """By the hierarchy path, then the topic."""
    p = F.lower(path)
    known = F.when(p.rlike("tensix|fpu|sfpu"), "Tensix").when(p.contains("overlay"), "Overlay").when(p.rlike("noc|niu"), "NoC").when(p.contains("edc"), "EDC").when(p.contains("dispatch"), "Dispatch")
    return known.when((topic != "") & (topic != "unclassified"), topic).otherwise("Other")


def sram_inventory(modules: DataFrame) -> DataFrame:
    """Memory instances, once by (instance, parent), with depth and width from the instance's name."""
    i = modules.select(F.col("module").alias("parent"), F.explode("instances").alias("i")).select("parent", F.col("i.name").alias("instance"), F.col("i.module").alias("cell"))
    i = i.withColumn("type", memory_type(F.col("instance"), F.col("cell"))).where("type is not null").dropDuplicates(["instance", "parent"])
    size = r"(?i)(\d+)\s*x\s*(\d+)"
    return i.withColumns({"depth": F.regexp_extract("instance", size, 1).try_cast("long"), "width": F.regexp_extract("instance", size, 2).try_cast("long")})


def sram_summary(inventory: DataFrame) -> DataFrame:
    """Memories in all, by type and by subsystem."""
    of = subsystem(F.col("parent"), F.lit(""))
    rows = inventory.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("total", F.lit("")), ("type", F.col("type")), ("subsystem", of))])).alias("r"))
    return rows.groupBy("r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))


def port_claims(modules: DataFrame, pipeline: str, fewest: int = 10) -> DataFrame:
    """Of modules with ten ports or more a claim for each class of ports, and one for all of them."""
    rows = modules.where(F.size("ports") >= fewest).select("path", "module", F.size("ports").alias("all"), F.posexplode("ports").alias("at", "p")).select("path", "module", "all", "at", F.col("p.name").alias("port"))
    by = rows.withColumn("category", port_class(F.col("port"))).groupBy("path", "module", "all", "category").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "port"))).alias("p"))
    names = F.array_join(F.transform("p", lambda x: x["port"]), ", ")
    of = F.concat(F.lit("Module '"), F.col("module"), F.lit("' has "))
    one = by.where("category <> 'Other'").select("path", "module", "category", F.concat(of, F.size("p").cast("string"), F.lit(" "), "category", F.lit(" ports: "), names).alias("claim_text"))
    rank = F.when(F.col("category") == "Other", F.lit(1 << 30)).otherwise(F.col("at"))
    parts = by.groupBy("path", "module", "all").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat("category", F.lit("("), F.size("p").cast("string"), F.lit(")")).alias("t")))).alias("s"))
    every = parts.select("path", "module", F.lit("PortSummary").alias("category"), F.concat(of, F.col("all").cast("string"), F.lit(" total ports: "), F.array_join(F.transform("s", lambda x: x["t"]), ", ")).alias("claim_text"))
    key = F.concat_ws(":", F.lit(pipeline), "path", F.lit("port"), "category", F.substring("claim_text", 1, 80))
    return one.unionByName(every).withColumns({"claim_id": F.substring(F.sha2(key, 256), 1, 16), "claim_type": F.lit("structural"), "topic": F.lit("TopLevelPorts")})


def cdc_pairs(domains: DataFrame, group: str, domain: str) -> DataFrame:
    """Sorted pairs of the distinct domains of each group."""
    d = domains.groupBy(group).agg(F.array_sort(F.collect_set(domain)).alias("d")).where(F.size("d") > 1)
    pairs = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return d.select(group, F.explode(pairs).alias("p")).select(group, "p.a", "p.b")


def dataflow(modules: DataFrame) -> DataFrame:
    """P10: (path, module, instance, parent_signal, child_module, child_port, direction, bit_width, width_mismatch) of the
    connections of instances: the direction by the port's beginning, the width of a numeric range, no mismatch, which takes the child's ports."""
    i = modules.select("path", "module", F.explode("instances").alias("i")).select("path", "module", F.col("i.name").alias("instance"), F.col("i.module").alias("child_module"), F.explode("i.bindings").alias("b"))
    bare = F.trim(F.regexp_replace("b.expr", r"\[.*?\]", ""))
    bit = lambda n: F.regexp_extract("b.expr", r"\[\s*(\d+)\s*:\s*(\d+)\s*\]", n).try_cast("long")
    way = F.when(F.col("b.port").rlike("^(?:i_|in_)"), "input").when(F.col("b.port").rlike("^(?:o_|out_)"), "output").otherwise("unknown")
    return i.select("path", "module", "instance", F.when(bare != "", bare).otherwise(F.col("b.expr")).alias("parent_signal"), "child_module", F.col("b.port").alias("child_port"), way.alias("direction"), (F.abs(bit(1) - bit(2)) + 1).alias("bit_width"), F.lit(False).alias("width_mismatch"))


def sub_records(modules: DataFrame, pipeline: str, fewest: int = 50) -> DataFrame:
    """P5: (path, module_name, sub_record_type, analysis_type, parsed_summary, instance_list, parameter_list) of modules
    of so many ports or more: a record for each class of ports, one for all ports, one for the instances, one for the parameters, if any."""
    large = modules.where(F.size("ports") >= fewest)
    said = lambda what, items: F.concat(F.lit("Module '"), F.col("module"), F.lit(f"' {what}: "), F.array_join(items, ", "))
    inst = F.transform("instances", lambda i: F.concat_ws(" ", i["module"], i["name"]))
    params = F.transform("params", lambda p: F.concat_ws("=", p["name"], p["value"]))
    shape = lambda df, kind, text, i, p: df.select("path", F.col("module").alias("module_name"), F.lit(kind).alias("sub_record_type"), F.lit("module_parse_chunk").alias("analysis_type"), text.alias("parsed_summary"), i.alias("instance_list"), p.alias("parameter_list"))
    none = F.lit("")
    out = shape(port_claims(large, pipeline, fewest), "port_summary", F.col("claim_text"), none, none)
    out = out.unionByName(shape(large.where(F.size("instances") > 0), "instance_hierarchy", said("instance hierarchy", inst), F.array_join(inst, " "), none))
    return out.unionByName(shape(large.where(F.size("params") > 0), "parameter_config", said("parameter configuration", params), none, F.array_join(params, " ")))
