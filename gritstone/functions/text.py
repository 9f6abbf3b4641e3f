"""Column functions over text and paths. Ids such as P1 name the operator of SURVEY section 2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension of a file to its document type.
DOCUMENT_TYPES = {"pdf": "pdf", "txt": "text", "md": "markdown", "v": "rtl", "sv": "rtl", "vhd": "rtl", "vhdl": "rtl", "vh": "rtl", "svh": "rtl", "py": "code", "c": "code", "h": "code", "cpp": "code", "hpp": "code", "tcl": "script", "sdc": "constraint", "xdc": "constraint"}
#: Sources that count; any other is an upload by hand.
SOURCES = ["archive_md", "rtl_parsed", "codebeamer", "manual_upload", "system_generated"]
#: Query classes in order, each with its words; the first class with a hit wins.
QUERY_CLASSES = [
    ("port_query", ["포트", "port", "input", "output", "인터페이스", "axi", "apb", "clock", "reset", "clk"]),
    ("hierarchy_query", ["인스턴스", "계층", "hierarchy", "instantiate", "모듈 트리", "instance", "sub-module"]),
    ("config_query", ["파라미터", "parameter", "localparam", "설정", "크기", "size", "sizex", "sizey"]),
    ("connectivity_query", ["연결", "topology", "ring", "chain", "routing", "generate", "feedthrough"]),
]
#: Weight of claims, module records and sections by query class.
BOOSTS = {
    "port_query": (4.0, 0.5, 2.0),
    "hierarchy_query": (1.5, 3.0, 2.0),
    "config_query": (4.0, 1.0, 2.0),
    "connectivity_query": (4.0, 1.0, 2.0),
    "general_query": (3.0, 1.0, 2.0),
}
#: Port classes in order, each with its patterns, whatever the case; the first that matches wins.
PORT_CLASSES = [
    ("PRTN_Power", ["PRTNUN_", "ISO_EN", "TIEL_DFT", "power_good"]),
    ("EDC_APB", ["edc_apb_", "edc_.*irq", "edc_reset", "i_edc_", "o_edc_"]),
    ("AXI_Interface", ["npu_out_", "npu_in_", "axi_", "i_axi_clk"]),
    ("APB_Register", ["i_reg_", "o_reg_", "reg_psel", "reg_paddr"]),
    ("DM_Clock_Reset", ["i_dm_clk", "i_dm_core_reset", "i_dm_uncore_reset"]),
    ("AI_Clock_Reset", ["i_ai_clk", "i_ai_reset"]),
    ("NoC_Clock_Reset", ["i_noc_clk", "i_noc_reset"]),
    ("Tensix_Reset", ["i_tensix_reset"]),
    ("SFR_Memory_Config", ["SFR_", "sfr_"]),
]
#: Topics, each with the directories and the beginnings of module names that stand for it.
TOPICS = {
    "NoC": (["noc"], ["tt_noc_", "noc_"]),
    "FPU": (["fpu"], ["tt_fpu_", "fpu_"]),
    "SFPU": (["sfpu"], ["tt_sfpu", "sfpu_"]),
    "TDMA": (["tdma"], ["tt_tdma_", "tdma_"]),
    "Overlay": (["overlay"], ["tt_overlay_", "overlay_"]),
    "EDC": (["edc"], ["tt_edc", "edc_"]),
    "Dispatch": (["dispatch"], ["tt_dispatch_", "dispatch_"]),
    "L1_Cache": (["l1", "cache"], ["tt_l1_", "l1_"]),
    "Clock_Reset": (["clk", "reset"], ["tt_clk_", "clk_", "rst_"]),
    "DFX": (["dfx"], ["tt_dfx_", "dfx_"]),
    "NIU": (["niu"], ["tt_niu_", "niu_", "tt_noc2axi_"]),
    "SMN": (["smn"], ["tt_smn_", "smn_"]),
    "Power": (["power", "prtn"], ["tt_prtn_", "prtn_", "iso_en_"]),
    "Memory": (["memory", "sram"], ["sfr_", "tt_mem_", "mem_"]),
}
UNKNOWN = "미확인"
UNSUPPORTED_MARK = " [확실하지 않음]"


def strip_comments(c: Column) -> Column:
    """Line comments first, then block comments."""
    return F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(c) / 4)


def truncate_tokens(c: Column, tokens: int) -> Column:
    """Three characters a token."""
    return F.substring(c, 1, 3 * tokens)


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def document_type(path: Column) -> Column:
    """By extension; unknown ones are ``other``."""
    table = F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("other"))


def valid_source(source: Column, known: list[str] = SOURCES) -> Column:
    """What isn't a known source counts as an upload by hand."""
    return F.when(source.isin(*known), source).otherwise("manual_upload")


def topic_from_path(path: Column, prefix: str = "documents/") -> Column:
    """Below team, the directories and the bare name without its kind, joined by slashes; short paths have none."""
    path = F.regexp_replace(path, f"^{prefix}", "")
    parts = F.split(path, "/")
    name = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), "(?i)[_-](spec|doc|guide|manual|readme|overview)$", "")
    within = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), "/")
    return F.when(F.size(parts) < 3, "").when(name == "", within).otherwise(F.concat(within, F.lit("/"), name))


def topics_of(path: Column, module: Column) -> Column:
    """All topics whose directory stands in the path or whose beginning the module's name has, sorted."""
    path, module = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(module, F.lit("")))
    found = [F.when(path.rlike(rf"[/\\](?:{'|'.join(dirs)})[/\\]") | module.rlike(f"^(?:{'|'.join(heads)})"), F.lit(t)) for t, (dirs, heads) in TOPICS.items()]
    found = F.array_sort(F.array_compact(F.array(*found)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unclassified")))


def flatten_path(path: Column) -> Column:
    """One flat name."""
    return F.replace(path, F.lit("/"), F.lit("_"))


def query_type(c: Column) -> Column:
    """Lower-case substrings, in order, else general."""
    out = F.lit("general_query")
    for name, words in reversed(QUERY_CLASSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def boost_of(query_class: Column, analysis_type: Column) -> Column:
    """The weight of a kind of record for a class of query; 1 for other kinds."""
    kinds = ["claim", "module_parse", "hdd_section"]
    table = F.create_map(*[F.lit(x) for q, w in BOOSTS.items() for kind, v in zip(kinds, w) for x in (f"{q}:{kind}", v)])
    known = F.when(query_class.isin(*BOOSTS), query_class).otherwise("general_query")
    return F.coalesce(F.element_at(table, F.concat_ws(":", known, analysis_type)), F.lit(1.0))


def port_class(c: Column) -> Column:
    """P6."""
    out = F.lit("Other")
    for name, patterns in reversed(PORT_CLASSES):
        out = F.when(c.rlike(f"(?i){'|'.join(patterns)}"), F.lit(name)).otherwise(out)
    return out


def signals(ports: Column, kind: str) -> Column:
    """The names of ports (``direction [range] name``) of one kind."""
    pattern = {"clock": "(?i)clk|clock", "reset": "(?i)reset|rst"}[kind]
    return F.filter(F.transform(ports, lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1)), lambda n: n.rlike(pattern))


def memories(instances: Column) -> Column:
    """Names of instances (``name: module``) that are memories."""
    names = F.transform(instances, lambda i: F.trim(F.element_at(F.split(i, ": "), 1)))
    return F.filter(names, lambda n: n.rlike("(?i)mem|sram|ram|rom|fifo|reg_bank|latch"))


def summary_of(module: Column, params: Column, ports: Column, instances: Column) -> Column:
    """A line each for what a module has."""
    line = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("module "), F.coalesce(module, F.lit("unknown"))), line("parameters", params), line("ports", ports), line("instances", instances))


def clock_ports(ports: Column) -> dict[str, Column]:
    """Clocks that come in and go out, by the declaration of each port."""
    clocks = F.filter(F.transform(ports, F.lower), lambda p: p.rlike("clk|clock"))
    out = F.size(F.filter(clocks, lambda p: p.startswith("output")))
    return {"clock_in": F.size(clocks) - out, "clock_out": out}


def needs_vision(page: Column, drawings: Column) -> Column:
    """Few characters, or short lines beside many drawings. 100, 12 and 200."""
    lines = F.filter(F.transform(F.split(page, r"\r\n|[\n\r]"), F.trim), lambda x: x != "")
    mean = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / F.size(lines)
    return (F.length(F.trim(page)) < 100) | (F.size(lines) == 0) | ((mean < 12) & (drawings >= 200))


def section_type(topic: Column, children: Column) -> Column:
    """R23."""
    whole = F.coalesce(topic, F.lit("")) == ""
    return F.when(whole | F.lower(topic).isin("all", "chip", "top"), "chip").when(children > 3, "subsystem").otherwise("block")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\x0b\f\r]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """L4: over two token arrays without duplicates; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def sentences(c: Column) -> Column:
    """Up to . ! ? 。 or a line end; pieces of punctuation alone go."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?。\n]+[.!?。]*"), 0), lambda s: F.trim(s)), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def grounding(c: Column) -> dict[str, Column]:
    """A4: tags, their share rounded to four places, and a warning above one half."""
    n = {k: F.regexp_count(c, F.lit(p)) for k, p in (("grounded", r"\[GROUNDED"), ("inferred", r"\[INFERRED"))}
    total = n["grounded"] + n["inferred"]
    share = F.round(F.coalesce(F.try_divide(n["inferred"].cast("double"), total.cast("double")), F.lit(0.0)), 4)
    return {"n_grounded": n["grounded"].cast("long"), "n_inferred": n["inferred"].cast("long"), "inferred_ratio": share, "warn": share > 0.5}


def unresolved_latest(c: Column) -> Column:
    """R16."""
    return c.rlike(r"(?i)\blatest\b")


def blank(c: Column) -> Column:
    """null, empty or the unknown mark."""
    return c.isNull() | (F.trim(c) == "") | (c == UNKNOWN)


def complete_citation(source: Column, version: Column, page: Column, section: Column) -> Column:
    """page 0 is a page."""
    return ~blank(source) & ~blank(version) & (page.isNotNull() | ~blank(section))


def valid_uri(c: Column) -> Column:
    """closed set of schemes, an id without white space."""
    return F.coalesce(c.rlike(r"^(rag|rtl|graph|claim|job|index)://\S+$"), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Over two arrays of doubles, as one pass each."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def parse_int(c: Column) -> Column:
    """Integer with a base prefix, null if it isn't one."""
    return F.when(c.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(c, 3, 20), 16, 10).cast("long")).otherwise(c.try_cast("long"))


def clog2(c: Column) -> Column:
    """Bits to count so many; null below 1."""
    return F.when(c >= 1, F.ceil(F.log2(c.cast("double"))).cast("long"))


def line_of(text: Column, at: Column) -> Column:
    """Line number, from 1, of an offset."""
    head = F.substring(text, F.lit(1), at)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def claim_id_of(*columns: str) -> Column:
    """First 16 hex digits of the SHA-256 of the joined columns."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, 16)


def used_in_n1(path: Column) -> Column:
    """Whether a path lies below a folder of that name."""
    return F.contains(F.coalesce(path, F.lit("")), F.lit("/used_in_n1/"))


def json_list(text: Column) -> Column:
    """A list of texts from JSON that is a list, or a text with one in it, fences and prose around it dropped; else a
    text is its own only item. Blank and null give none."""
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    got = F.from_json(F.when(inner != "", inner), "array<string>")
    alone = F.when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.when(F.forall(got, lambda x: x.isNotNull()), got), alone, F.array().cast("array<string>"))


def listed_keys(record: Column, keys: list[str], defaults: dict[str, Column]) -> Column:
    """The entries of a map whose keys are listed, with defaults for those that are not there."""
    own = F.map_filter(F.coalesce(record, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(keys) & v.isNotNull())
    extra = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))]) if defaults else F.create_map().cast("map<string,string>")
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k)), own)


def no_overlap(a: list[str], b: list[str]) -> None:
    """Two sets of tool names share none, else ValueError."""
    if both := sorted(set(a) & set(b)):
        raise ValueError(f"tools of both: {', '.join(both)}")
