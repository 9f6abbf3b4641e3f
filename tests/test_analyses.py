"""Analyses of parsed facts, on literals."""

from pyspark.sql import functions as F

from gritstone.operators import analyses as A


def test_flit_layout_and_nesting(spark):
    rows = [("noc_flit_t", 0, "y", 8, 7, 0, ""), ("noc_flit_t", 1, "x_dest", 8, 31, 24, ""), ("noc_flit_t", 2, "tail", 0, 0, 0, "tail_t"), ("noc_flit_t", 3, "odd", 0, 0, 0, None), ("cfg_t", 0, "a", 1, 0, 0, "")]
    f = spark.createDataFrame(rows, "struct string, ordinal int, name string, bit_width int, msb int, lsb int, ref_type string")
    assert [r.layout for r in A.flit_layouts(f).collect()] == ["Flit structure 'noc_flit_t' layout: x_dest[31:24], y[7:0], tail(tail_t), odd(unknown width)"]
    assert A.flit_layouts(f.limit(0)).count() == 0
    links = [("a", "f", "b"), ("b", "f", "c"), ("c", "f", "d"), ("d", "f", "e"), ("e", "bit", "logic"), ("me", "f", "me"), ("p", "f", "q"), ("q", "f", "p")]
    got = {(r.struct, r.ref_type): r.truncated for r in A.nested_structs(spark.createDataFrame(links, "struct string, name string, ref_type string")).collect()}
    # In a circle of two, each is enclosed by the other, and so twice.
    assert got == {("a", "b"): False, ("b", "c"): False, ("c", "d"): True, ("d", "e"): False, ("me", "me"): False, ("p", "q"): True, ("q", "p"): True}


def test_settings_and_roles(spark):
    p = spark.createDataFrame([("m", "NUM_HARTS", " 8 "), ("m", "Num_Banks", "0x10"), ("m", "SRAM_TYPE", "\"hd'"), ("m", "LINE_SIZE", "0b101"), ("m", "OTHER", "1"), ("m", "CACHE_SIZE", "1K"), ("m", None, "1")], "module string, name string, value string")
    assert [(r.name, r.number) for r in A.settings(p, A.CPU_WORDS).collect()] == [("NUM_HARTS", 8)]
    assert {r.name: (r.number, r.text) for r in A.settings(p, A.L1_WORDS).collect()} == {"Num_Banks": (16, None), "SRAM_TYPE": (None, "hd"), "LINE_SIZE": (5, None), "CACHE_SIZE": (None, "1K")}
    m = spark.createDataFrame([("tt_overlay_noc_wrap",), ("tt_overlay_noc_wrapper",), ("x",), (None,)], "m string").select(A.role_of(F.col("m")).alias("r"))
    assert [r.r for r in m.collect()] == ["noc_interface", "noc_interface", None, None]


def test_sections(spark):
    d = spark.createDataFrame([(1, "# 😀 A \r\nx\n###### b  c\n####### d\n#e"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.start, r.title) for r in A.sections(d, "markdown").orderBy("start").collect()] == [(1, 0, "😀 A"), (1, 10, "b  c")]
    d = spark.createDataFrame([(1, "1 Intro\n\f 4.2\tElab \n4.\nCHAPTER\nchapters\n2024")], "doc_id int, text string")
    assert [(r.start, r.title) for r in A.sections(d, "pdf").orderBy("start").collect()] == [(0, "1 Intro"), (8, "4.2\tElab"), (23, "CHAPTER")]


def test_connectivity_uses_an_edge_once(spark):
    e = spark.createDataFrame([("a_in", "BINDS_TO", "n"), ("n", "READS", "a_in"), ("n", "DRIVES", "z_out"), ("a_in", "BINDS_TO", "n")], "src string, type string, dst string")
    assert [r.path for r in A.connectivity(e, "a_in", "z_out").collect()] == ["a_in -BINDS_TO-> n -DRIVES-> z_out"]
    assert A.connectivity(e, "a_in", "nothing").count() == 0
    assert [r.hops for r in A.connectivity(e, "n", "n").collect()] == [1, 1, 2, 2]  # a_in holds an n too; a third hop would use an edge again


def test_evidence_and_files(spark):
    e = spark.createDataFrame([("m", f"p{i:02}", "s", None) for i in range(12)], "module string, src string, dst string, direction string")
    k = spark.createDataFrame([("m", f"m / u{i:02}") for i in range(12)] + [("k", "k / u")], "module string, path string")
    got = {r.module: r.evidence.split("\n") for r in A.evidence_text(e, k, "EDC").collect()}
    assert got["k"] == ["[GRAPH EVIDENCE — EDC Section]", "- Hierarchy (1 paths):", "  - k / u"]
    assert len(got["m"]) == 1 + 1 + 10 + 1 + 5 and got["m"][1] == "- Summary: 12 bindings" and got["m"][2] == "  - p00 -> s ()" and got["m"][12] == "- Hierarchy (10 paths):"
    n = spark.createDataFrame([("r", ["a"], "a.v"), ("r", ["b"], "b.v"), ("r", ["a", "c"], "c.v"), ("r", ["a", "d"], None)], "root string, path array<string>, file string")
    assert A.source_files(n).first().files == ["a.v", "c.v", "b.v"]


def test_skip_ratio(spark):
    r = spark.createDataFrame([("a", True, 0), ("a", False, 0), ("b", False, 3), ("b", False, 1), ("b", False, 1), ("b", True, 0)], "k string, skipped boolean, nodes int")
    got = {x.k: (x.ratio, x.warn, x.mismatch) for x in A.skip_ratio(r, "k", F.col("skipped"), F.col("nodes")).collect()}
    assert got == {"a": (0.5, True, True), "b": (0.25, False, False)}
