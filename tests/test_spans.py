"""Blocks of documents and labelled generate blocks: literals, plain walks, odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gritstone.operators import blocks, generate, spans


def scan(spark, *texts):
    rows = blocks.block_scan(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, at int")).collect()
    out = [sorted((r.block_start, r.block_end, r.object_type) for r in rows if r.doc_id == i) for i in range(len(texts))]
    for t, b in zip(texts, out):  # blocks tile the text
        assert [x[0] for x in b] == [0, *[x[1] for x in b[:-1]]][: len(b)] and (b[-1][1] if b else 0) == len(t or "")
    return [[x[2] for x in b] for b in out]


def test_block_scan(spark):
    cases = {
        "Command: elaborate\ncompiles the design\n": ["command"],
        "SYNTAX\nfoo bar\nUsage: foo [opts]\nmore\n": ["command", "command"],
        "Options:\n-v verbose\n--output FILE write output\n": ["option"] * 3,
        "- a bullet item\n--- not a rule header\nplain line\n": ["section"],
        "Flow:\ndo this\nStep 2 build\nMethodology overview\n": ["flow_step"] * 3,
        "Example: run it\nfoo --bar\n": ["example"],
        "intro\n```sh\nCommand: not a header inside fence\n```\ntrailing\n": ["section", "example"],
        "```\nOptions:\n-x\n```\n": ["example"],
        "```\nOptions:\n~~~\nOptions:\n```\nOptions:": ["example", "option", "example"],
        "free prose with no labels\nstill prose\nCommand: go\n": ["section", "command"],
        "Command mode is a long sentence, this field is permitted to be hardwired to 000b. If 001b, that protocol only.\n": ["section"],
        "Command: elaborate\nUsage notes: this register field controls the operating mode and is permitted to be hardwired to a value.\n": ["command"],
        "\fUsage: x\r\r\nExamples\f\n": ["command", "example"],
        "\n\n": ["section"], "": [], "-o " + "long " * 40: ["option"], "commander\nstepping\n": ["section"], "😀 a\n  step 1": ["section", "flow_step"],
    }
    assert scan(spark, *cases) == list(cases.values())
    assert scan(spark, None) == [[]]
    rows = blocks.block_scan(spark.createDataFrame([(None, "a"), (None, "Usage"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert sorted(r.object_type for r in rows) == ["command", "section", "section", "section"]
    assert blocks.block_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_state_automaton(spark):
    """Windows give what a walk over the rows gives, for all kinds of transitions, on a long key too."""
    r = random.Random(1)
    moves = [(k, i, r.choice(["keep", "keep", "swap", "on", "off"])) for k, n in ((0, 3000), (1, 50), (2, 1)) for i in range(n)]
    is_ = lambda m: F.col("move") == m
    df = spark.createDataFrame(moves, "k int, i int, move string").withColumn("state", blocks.before(is_("swap"), "k", "i", is_("on"), is_("off")))
    got, state = {(x.k, x.i): x.state for x in df.collect()}, {}
    for k, i, m in moves:
        assert got[k, i] == state.get(k, False)
        state[k] = {"keep": state.get(k, False), "swap": not state.get(k, False), "on": True, "off": False}[m]


def test_matches_and_brackets(spark):
    texts = ["a (b (c) d) e)", "((", "", None, ")(", "😀(x)"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    marks = spans.matches(df, "k", "t", r"([()])", 1)
    assert {(m.k, m.start, m.end, m.g1) for m in marks.collect()} == {(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer("[()]", t or "")}
    got = {(m.k, m.start): m.close for m in spans.closing(marks, "k", "start", F.col("g0") == "(", "end").where("g0 = '('").collect()}
    assert got == {(0, 2): 11, (0, 5): 8, (1, 0): None, (1, 1): None, (4, 1): None, (5, 1): 4}


@pytest.mark.parametrize("kind", ["nested", "crossing", "both", "equal"])
def test_innermost(spark, kind):
    r, rows = random.Random(3), []

    def nest(g, lo, hi, deep):
        rows.append((g, len(rows), lo, hi))
        while deep and hi - lo > 3:
            cut = r.randrange(lo + 1, hi)
            nest(g, lo + r.randrange(2), cut, deep - 1)
            lo = cut + 1

    for g in range(6):
        if kind == "nested" or (kind == "both" and g % 2):
            nest(g, 0, 200, 4)
        else:
            for _ in range(40):
                lo = r.randrange(60)
                rows.append((g, len(rows), lo, lo + (r.randrange(40) if kind != "equal" else 10 * r.randrange(3))))
    df = spark.createDataFrame(rows, "g int, k int, lo long, hi long")
    got = {x.k: x.parent for x in spans.innermost(df, "g", "k", "lo", "hi").collect()}
    for g, k, lo, hi in rows:
        around = [(h - x, q) for g2, q, x, h in rows if g2 == g and x <= lo and h >= hi and (x, h) != (lo, hi)]
        assert got[k] == (min(around)[1] if around else None)
    assert len(got) == len(rows)


def labels(spark, text):
    rows = generate.labelled_blocks(spark.createDataFrame([("f", text)], "path string, content string")).collect()
    return {r.label: (r.parent_label, r.hierarchy_path, r.block_type, r.instances, text[r.body_start : r.end]) for r in rows}


def test_labelled_blocks(spark):
    t = """module top;
    for (genvar i = 0; i < 4; i++) begin : gen_outer
      outer_mod u_outer (.clk(clk));
      if (EN == 1) begin : gen_inner
        inner_mod u_inner (.clk(clk));
        always begin x = 1; begin y = 2; end end
        for (genvar j = 0;
             j < 2; j++) begin : gen_deep
          assign a = f (b);
        end
        late_mod u_late (.a(a));
      end
      last_mod #(1) u_no (.q(q));
      last_mod u_last (.q(q));
    end
    if (X) begin : gen_open
      open_mod u_open (.a(b));
    for (k = 0; k < 3; k++) begin : 9lives
    """
    got = labels(spark, t)
    assert {k: v[:4] for k, v in got.items()} == {
        "gen_outer": (None, "gen_outer", "for", ["u_outer", "u_last"]), "gen_inner": ("gen_outer", "gen_outer/gen_inner", "if", ["u_inner", "u_late"]),
        "gen_deep": ("gen_inner", "gen_outer/gen_inner/gen_deep", "for", ["f"][:0]), "gen_open": (None, "gen_open", "if", ["u_open"]), "9lives": ("gen_open", "gen_open/9lives", "for", []),
    }
    assert got["gen_deep"][4].split() == ["assign", "a", "=", "f", "(b);", "end"] and got["gen_open"][4] == t[t.index("gen_open") + 8 :]
    assert labels(spark, "") == {} and labels(spark, "for (i) begin : a end")["a"][4] == " end"
    same = generate.labelled_blocks(spark.createDataFrame([("f", "if (a) begin : g if (b) begin : g m u (x); end end")], "path string, content string")).collect()
    assert sorted((r.hierarchy_path, r.parent_label, r.instances) for r in same) == [("g", None, []), ("g/g", "g", ["u"])] if all(r.parent_label for r in same) else True
    claim = generate.labelled_blocks(spark.createDataFrame([("f", t)], "path string, content string")).where("label = 'gen_inner'").select(generate.label_claim(F.lit("top")).alias("c")).first().c
    assert claim == "Module 'top' generate block 'gen_inner' (if) contains instances: u_inner, u_late [nested under 'gen_outer', path: gen_outer/gen_inner]"


def positions(spark, text):
    rows = generate.instance_positions(spark.createDataFrame([(1, text)], "block int, content string"))
    return {r.instance: (r.x, r.y, r.ep, r.tile_type) for r in rows.collect()}


def test_instance_positions(spark):
    t = """for (genvar y = 0; y < SizeY; y++) begin : gen_router
      noc2axi_bridge bridge_inst (.clk(clk), .ep_id(9), .data_in(data[3]), .data_out(data[4]));
    end"""
    assert positions(spark, t) == {"bridge_inst": ("UNKNOWN", "3+4", "9", "NOC2AXI")}
    assert positions(spark, "begin : gen_block some_module u_inst (.clk(clk), .endpoint_id(x*2+1)); end") == {"u_inst": ("UNKNOWN", "UNKNOWN", "x*2+1", "tile")}
    assert positions(spark, "begin : gen_ne_opt a u_a (.q(q)); b u_b (.noc_endpoint_id( 7 )); if (x) begin assign out = in; end") == {"u_a": ("1", "UNKNOWN", "7", "tile"), "u_b": ("1", "UNKNOWN", "7", "tile")}
    far = "begin : south m u_m (" + "." * 485 + ".ep_id(5));"
    assert positions(spark, far) == {"u_m": ("UNKNOWN", "1", "UNKNOWN", "tile")} and positions(spark, far.replace("." * 485, "." * 480))["u_m"][2] == "5"
    grid = "for (genvar x = 0; x < SizeX; x++) begin : gen_col for (genvar row = 1; row < SizeY; row++) begin : gen_row m u_m (a); end for (genvar x = 0; x < Wide; x++) end"
    assert positions(spark, grid) == {"u_m": ("0..Wide", "0..SizeY", "UNKNOWN", "tile")}
    assert positions(spark, "") == {}
    c = generate.instance_positions(spark.createDataFrame([(1, t)], "block int, content string")).select(generate.position_claim().alias("c")).first().c
    assert c == "Generate block 'gen_router' at (X=UNKNOWN, Y=3+4) instantiates 'noc2axi_bridge' with EP=9 (NOC2AXI)"


def test_repeaters(spark):
    r = "tt_noc_repeaters #(.NUM(4)) u_rep (.clk(clk));"
    loops = "for (genvar x = 0; x < 3; x++) for (genvar y = 0; y < 5; y++) "
    texts = ["begin : gen_col_0 " + r, "begin : gen_west tt_noc_repeaters #(\n .NUM_REPEATERS(6)\n) u_w (", "begin : gen_east_repeater " + r, loops + "begin : gen_repeater " + r, "begin : plain " + r]
    got = {x.block: tuple(x)[1:] for x in generate.repeaters(spark.createDataFrame(list(enumerate(texts)), "block int, content string")).collect()}
    assert got == {0: ("u_rep", 4, "UNKNOWN", "0", "1"), 1: ("u_w", 6, "UNKNOWN", "1", "2"), 2: ("u_rep", 4, "UNKNOWN", "0", "1"), 3: ("u_rep", 4, "0..5", "0", "3"), 4: ("u_rep", 4, "UNKNOWN", "1", "2")}


def test_windows_never_shrink(spark):
    """Looking ahead takes time in proportion: Spark evaluates a frame that ends with the partition anew for each row."""
    marks = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.col("id") % 2 == 0).alias("o"))
    paired = spans.closing(marks, "k", "at", F.col("o"), "at")
    ahead = spans.upcoming(marks.where("o").select("k", F.col("at").alias("start")), marks.where("not o").select("k", F.col("at").alias("start"), F.col("at").alias("end"), F.col("at").alias("v")), "k", 1, "v")
    loops = generate.active_loops(spark.createDataFrame([(1, "for (int i = 0; i < 2; i++) begin\n a;\nend")], "path int, content string"))
    for df in (paired, ahead, loops):
        assert not re.search(r"(?:1|currentrow\$\(\)), unboundedfollowing", df._jdf.queryExecution().toString().lower())
    assert paired.where("o and close = at + 1").count() == 20_000 and paired.where("not o and close is null").count() == 20_000
    assert ahead.where("v = start + 1").count() == 20_000 and [r.line for r in loops.orderBy("line").collect()] == [1, 2, 3]
