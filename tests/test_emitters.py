"""Claims of all emitters on literals."""

import time

from pyspark.sql import functions as F

from gritstone.operators import emitters, rtl

PACKAGE = """package noc_pkg; // localparam int GONE = 1;
  localparam int SizeX = 2;
  localparam SizeY = 5;
  localparam logic [3:0] MASK = 4'hF; /* localparam X = 2; */
  localparam int SizeX = 3;
  parameter int DEPTH = WIDTH * 2;
  typedef enum logic [1:0] { IDLE, RUN = 2'd1, DONE } state_t;
  function automatic logic [3:0] pick(input logic [7:0] data, mask, int n);
    for (int i = 0; i < n; i++) if (data[i]) return data[i] & mask;
  endfunction
  static function void nop();
    x = 1;
  endfunction
  task automatic send(input logic [7:0] data, output int result, flag);
  endtask
endpackage
"""
MODULE = """module top #(parameter int W = 8, parameter D = f(W, 2), parameter logic [7:0] I = 8'hFF) (input clk);
  parameter X = 5;
  parameter W = 9;
  wire trinity_pkg::clock_t clock_routing_in[SizeX][ SizeY ];
  logic [31:0] some_noc_signal[4];
  reg foo edc_x[2];
  de_to_t6_t [3:0] de_to_t6_col[SizeX-1][2];
  logic [7:0] some_noc_signal[9];
  function int inside(int a); return a; endfunction
  sub #(.N(4), .M(W+1)) u_sub (.a(clk), .b({x, y}));
  if (EN) begin : gen_a
    sub u_in (.a(q));
  end
endmodule
"""


def test_claims(spark):
    files = spark.createDataFrame([("p.sv", PACKAGE), ("m.sv", MODULE), ("m.sv2", "plain text"), ("n.sv", None)], "path string, content string")
    rows = emitters.rtl_claims(files, rtl.parsed(files.where("path = 'm.sv'")), "pipe", ["de_to_t6_t"]).collect()
    said = {}
    for r in rows:
        said.setdefault((r.file_path, r.topic), set()).add(r.claim_text)
        assert (r.claim_type, r.pipeline_id, r.confidence_score) == ("structural", "pipe", 1.0) and len(r.claim_id) == 16
    assert len({r.claim_id for r in rows}) == len(rows)
    config = said["p.sv", "PackageConfig"]
    of = "Package 'noc_pkg' defines "
    assert {of + "3 localparam constants: SizeX = 3, SizeY = 5, MASK = 4'hF", of + "localparam SizeX = 3", of + "localparam SizeY = 5", of + "localparam MASK = 4'hF", of + "parameter DEPTH = WIDTH * 2", of + "typedef enum 'state_t' with 3 members: IDLE, RUN=2'd1, DONE"} <= config
    assert "Endpoint EP=4 at position (X=0, Y=4) is tile type NOC2AXI_NE_OPT" in config and not any("GONE" in c or " X = " in c for c in config)
    # the first size that stands in the text makes the grid
    assert "EP Index Table: 2×5=10 endpoints. EP0=(0,0) TENSIX, EP1=(0,1) TENSIX, EP2=(0,2) TENSIX, EP3=(0,3) DISPATCH_E, EP4=(0,4) NOC2AXI_NE_OPT, EP5=(1,0) TENSIX, EP6=(1,1) TENSIX, EP7=(1,2) TENSIX, EP8=(1,3) ROUTER, EP9=(1,4) NOC2AXI_ROUTER_NE_OPT" in config
    assert said["p.sv", "PackageFunction"] == {
        of + "function 'pick(logic data, logic mask, int n) → logic [3:0]' [automatic]. Summary: 1 loop(s); 1 conditional(s); returns data[i] & mask",
        of + "function 'nop() → void' [static]. Summary: 1 assignment(s)", of + "task 'send(input logic data, output int result, output int flag)' [automatic]",
    }
    assert said["m.sv", "TopLevelParameter"] == {f"Module 'top' defines parameter {x}" for x in ("W = 8", "D = f(W, 2)", "I = 8'hFF", "X = 5")}
    assert said["m.sv", "WireTopology"] == {
        "Wire 'clock_routing_in' of type 'trinity_pkg::clock_t' with dimensions [SizeX, SizeY] (SizeX×SizeY array) for clock distribution", "Wire 'some_noc_signal' with dimensions [4] (4 array) connects NoC interconnect",
        "Wire 'edc_x' with dimensions [2] (2 array) connects EDC ring connection", "Wire 'de_to_t6_col' of type 'de_to_t6_t' with dimensions [SizeX-1, 2] (SizeX-1×2 array) for dispatch-to-tensix feedthrough [references struct de_to_t6_t]",
    }
    assert said["m.sv", "InstanceParameter"] == {"Instance 'u_sub' overrides N=4", "Instance 'u_sub' overrides M=W+1"}
    assert {"Instance 'u_sub' of module 'sub' binds port 'a' to signal 'clk'", "Instance 'u_in' of module 'sub' binds port 'a' to signal 'q'"} <= said["m.sv", "PortBinding"]
    assert said["m.sv", "Hierarchy"] == {"Module 'top' generate block 'gen_a' (if) contains instances: u_in"}
    assert ("m.sv", "PackageFunction") not in said and not any(p in ("m.sv2", "n.sv") for p, _ in said)
    assert emitters.rtl_claims(files.limit(0), rtl.parsed(files.limit(0)), "pipe").count() == 0


def test_many_constants_and_long_bodies(spark):
    text = "package p; " + " ".join(f"localparam A{i} = {i};" for i in range(33)) + " function int f(); return " + "x + " * 20 + "y; endfunction function int g();\n" + "a;\n" * 21 + "endfunction function int h(); q ? a : b; endfunction function int k(); call(); endfunction endpackage"
    files = spark.createDataFrame([("p", text)], "path string, content string")
    said = {r.claim_text for r in emitters.rtl_claims(files, rtl.parsed(files), "x").collect()}
    assert any(c.startswith("Package 'p' defines 33 localparam constants: A0 = 0, ") and c.endswith("A29 = 29 ... and 3 more") for c in said)
    heads = {c.split("'")[3]: c.partition("'. Summary: ")[2] for c in said if " function " in c}
    assert heads == {"f() → int": "returns computed value", "g() → int": "", "h() → int": "ternary expression", "k() → int": "1 statement(s)"}


def test_grids(spark):
    cells, every = emitters.endpoint_grid(spark.createDataFrame([("a", 1, 3), ("b", 0, 4), ("c", 5, 4)], "k string, x int, y int"), "k", "x", "y")
    assert sorted((r.k, r.x, r.y, r.ep) for r in cells.collect()) == [("a", 0, y, y) for y in range(3)] + [("c", x, y, x * 4 + y) for x in range(5) for y in range(4)]
    assert {r.k: r.summary.partition(". ")[0] + r.summary[-10:] for r in every.collect()} == {"a": "EP Index Table: 1×3=3 endpoints,2) TENSIX", "c": "EP Index Table: 5×4=20 endpoints (10 more)"}
    assert cells.where("k = 'c' and ep = 19").select("tile_type").first()[0] == "UNKNOWN"
    assert cells.select(F.max("ep")).first()[0] == 19


def test_long_files(spark):
    """A file of many functions and instances takes time in proportion; heads before one end share its piece."""
    n = 3000
    package = "package p;\n" + "".join(f"function int f{i}(int a);\n return a{i};\nendfunction\n" for i in range(n))
    package += "function void q(int a);\nfunction int r();\nx = 1;\nendfunction\nmodule m;\nfunction int no();\nendfunction\nendmodule\nfunction int last();\nx = 1;"
    start = time.time()
    said = [r.claim_text for r in emitters.functions_and_tasks(spark.createDataFrame([("a", "p", package)], "path string, owner string, text string")).collect()]
    of = "Package 'p' defines function '"
    assert sorted(said) == sorted([f"{of}f{i}(int a) → int'. Summary: returns a{i}" for i in range(n)] + [of + "q(int a) → void'. Summary: 1 assignment(s)", of + "r() → int'. Summary: 1 assignment(s)", of + "last() → int'"])
    assert time.time() - start < 30
    start = time.time()
    module = "module m;\n" + "".join(f"sub #(.N({i})) u{i} (.a(s{i}), .b(t)) ;\n" for i in range(20_000)) + "endmodule\n"
    found = rtl.parse(module)[0]["instances"]
    assert [i["name"] for i in found] == [f"u{i}" for i in range(20_000)] and time.time() - start < 10
