"""Generate loops against a plain walk over the lines."""

import random
import re

from pyspark.sql import functions as F

from gritstone.operators import generate as G


def walk(text: str) -> dict:
    """Loops around each line that is not blank, by one pass with a stack."""
    depth, around, out = 0, [], {}
    for n, line in enumerate(text.split("\n"), 1):
        begins, ends = (len(re.findall(rf"\b{w}\b", line)) for w in ("begin", "end"))
        if m := re.search(G.LOOP, line):
            around.append((m[1], n, depth + begins))
        if around and line.strip():
            out[n] = [x[:2] for x in around]
        depth = max(0, depth + begins - ends)
        if ends:
            around = [x for x in around if x[2] <= depth]
    return out


def test_active_loops_equal_a_walk(spark):
    rng = random.Random(5)
    parts = ["for (genvar i = 0; i < 4; i++) begin : g", "for (j=N-1; j>=0; j--) begin end", "for (k = 0; k < 2; k++)", "if (a) begin", "end", "end else begin", "end end", "x = 1;", " ", "endmodule", "for (i = 0; j < 2; i++) begin"]
    texts = {i: "\n".join(rng.choices(parts, k=rng.randrange(0, 30))) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()) + [(99, None)], "path int, content string")
    got = {}
    for r in G.active_loops(df).collect():
        got.setdefault(r.path, {})[r.line] = [(x.variable, x.start_line) for x in r.loops]
    assert got == {i: w for i, t in texts.items() if (w := walk(t))}
    assert G.active_loops(df.limit(0)).count() == 0


def test_topology(spark):
    rows = [("assign x_de[y] = (y==0) ? top : x_de[y - 1]; assign r[N-1]=r[0];", "y", None), ("a[y+1]=b; assign ab[y] = 0;", "y", "x"), ("a[y+1]=b; c[y] = 0; p[x][y].q = 1;", "y", "x"), (None, "y", "x")]
    df = spark.createDataFrame(rows, "body string, p string, s string")
    got = [tuple(r) for r in df.select(*G.topology(F.col("body"), F.col("p"), F.col("s")).values()).collect()]
    # The name of a[y+1] does not stand before [y] in the second and third; a[y+1] is the first that y indexes at all.
    assert got == [("feedthrough", "x_de"), ("unknown", "a"), ("2D array", "p"), ("unknown", "unknown_signal")]


def test_harvest(spark):
    i = spark.createDataFrame([("m", "u: tt_edc1_serial_bus_demux"), ("m", "x"), ("m", None)], "module string, of string")
    assert [tuple(r) for r in G.harvest_bypasses(i).collect()] == [("m", "tt_edc1_serial_bus_demux", "demux_bypass")]
