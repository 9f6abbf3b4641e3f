"""Operators of the reference's kind, on literals."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gritstone.functions import text as T
from gritstone.functions.widths import WidthError, clog2, evaluate
from gritstone.operators import chunk, claims, graph, metrics, policy, rtl, search, verify
from gritstone.plans.verification import verified_answer
from gritstone.sources import files
from gritstone.streaming import ingest


def test_clog2_and_width_grammar():
    assert [clog2(n) for n in (1, 2, 3, 5, 12, 100, 1024)] == [0, 1, 2, 3, 4, 7, 10]
    assert evaluate("W*2-1", {"W": 8}) == 15 and evaluate("$clog2(12)<<1") == 8 and evaluate("-(3)+1") == -2
    assert evaluate("SizeX-1") == "SizeX-1"
    assert [evaluate(x) for x in ("1+", " (1", "__import__('os')")] == ["1+", "(1", "__import__('os')"]
    for bad in ("1/0", "$clog2(0)", "$clog2(0-3)"):
        with pytest.raises(WidthError):
            evaluate(bad)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n!?#", max_size=400), st.integers(5, 60))
def test_chunks_lose_nothing(text, size):
    assert "".join(chunk.by_lines(text, size)) == text
    assert all(c.strip() for c in chunk.by_reference(text, size, size // 4, size // 3))


def test_chunk_rules():
    assert chunk.by_rtl("A Module b ENDMODULE c", 12, 4) == ["A Module b ", "e b ENDMODULE", "DULE c"]
    assert chunk.by_rtl("x" * 30, 12, 4) == ["x" * 30] and chunk.by_rtl("ab task cd", 100) == ["ab task cd"] and chunk.by_rtl("", 5) == []
    assert chunk.by_spec("intro text\n  # One\nlong line here\n## Two\nend", 10) == ["intro text\n", "\n  # One\nlong line here\n", "  # One\n## Two\nend\n"]
    assert chunk.by_spec("a\n# b", 100) == ["a\n# b\n"]
    assert chunk.by_sentences("A  b.  C d.", 100) == ["A  b. C d."] and chunk.by_sentences("One two. Three four. Five.", 15, 2) == ["One two.", "One two.  Three four.", "Three four. Five."]
    assert chunk.by_sentences("a b c d e. f g.", 12, 2) == ["a b c d e.", "d e. f g."]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 20))
def test_packing_respects_the_limit(sizes, most):
    groups = chunk.pack(sizes, most)
    for g in set(groups):
        own = [s for s, x in zip(sizes, groups) if x == g]
        assert sum(own) <= most or len([s for s in own if s]) == 1


def test_rtl_facts():
    m = rtl.parse("""// module no (
    module top #(parameter W = 8) (input wire i_clk, input [W-1:0] i_d);
      wire t_t r[4][3];
      sub #(.P(3)) u (.a(f(i_d)), .a(x), .b({p, q[1]}), .c(m[2]));
      always_ff @(posedge i_clk) begin end
    endmodule""")[0]
    assert m["module"] == "top" and [p["width"] for p in m["ports"]] == [1, 8] and m["clocks"] == ["i_clk"]
    assert [(b["port"], b["expr"], b["kind"]) for b in m["instances"][0]["bindings"]] == [("a", "f(i_d)", "simple"), ("b", "{p, q[1]}", "concatenation"), ("c", "m[2]", "simple")]
    assert m["wires"][0]["dims"] == 2 and m["instances"][0]["overrides"] == [{"name": "P", "value": "3"}]
    assert rtl.enum_values("A, B = 5, C") == [{"name": "A", "value": 0}, {"name": "B", "value": 5}, {"name": "C", "value": 6}]
    assert [f["width"] for f in rtl.struct_fields("logic [7:0] x; logic [15:0] y;", {})] == [8, 16]


def test_paths_keep_diamonds_and_cut_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    got = graph.paths(spark.createDataFrame([("a",)], "id string"), e, 5)
    assert sorted("".join(r.path) for r in got.collect()) == ["ab", "abd", "ac", "acd"]


def test_claims(spark):
    c = spark.createDataFrame([("x", 1, "draft", "none", "t0"), ("y", 1, "verified", "approved", "t0"), ("y", 2, "deprecated", "approved", "t0")], "claim_id string, version int, status string, approval_status string, updated_at string")
    ch = spark.createDataFrame([("x", 1, "verified"), ("y", 2, "verified")], "claim_id string, expected_version int, new_status string")
    assert [(r.claim_id, r.version, r.status, r.approval_status) for r in claims.update_status(c, ch, F.lit("t1")).collect()] == [("x", 2, "verified", "pending_review")]
    assert claims.publishable(claims.latest(c)).count() == 0
    d = spark.createDataFrame([(1, "t", "a b c d"), (2, "t", "a b c d e"), (3, "t", "b c d e f"), (4, "u", "a b c d"), (5, "t", "")], "id int, g string, s string")
    assert {(r.a, r.b) for r in claims.pairs_alike(d, "g", "id", "s", 0.8).collect()} == {(1, 2)}


def test_text_functions(spark):
    r = spark.sql("SELECT 'a // x\n b /* c\n */ d' AS t, 'report it' AS q, 's' AS f, CAST(0 AS INT) AS p, '미확인' AS u, '0x1F' AS h").select(T.strip_comments(F.col("t")), T.query_type(F.col("q")), T.complete_citation(F.col("f"), F.col("f"), F.col("p"), F.lit(None).cast("string")), T.complete_citation(F.col("f"), F.col("u"), F.col("p"), F.col("f")), T.parse_int(F.col("h"))).first()
    assert list(r) == ["a \n b  d", "port_query", True, False, 31]


def test_verification_and_marks(spark):
    s = spark.sql("SELECT 'One. Two!' AS t").select(verify.marked(F.col("t"), F.array(F.lit("Two!")))).first()[0]
    assert s == "One. Two!" + T.UNSUPPORTED_MARK
    q = spark.createDataFrame([(1, ["a/b"]), (2, ["z/z"])], "question_id int, topics array<string>")
    c = spark.createDataFrame([("x", 1, "a/b", "verified", "approved", ["s1", "s2"]), ("y", 1, "a/b", "conflicted", "approved", ["s1"])], "claim_id string, version int, topic string, status string, approval_status string, evidence array<string>")
    assert {r.question_id: (r.claims, r.sources, r.conflict, r.fallback) for r in verified_answer(q, c).collect()} == {1: (1, 2, True, False), 2: (0, 0, False, True)}
    d = spark.createDataFrame([(1, "[FROM LLM] The east side is (0, 4). Fine."), (2, None)], "doc_id long, text string")
    assert [r.text for r in verify.scrub(d).orderBy("doc_id").collect()] == ["[FROM LLM] The east side is . Fine.", None]


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["top", "  a", "    b", "  c", "two"])], "g int, at int, line string")
    assert [(r.path, r.depth) for r in files.hierarchy_lines(lines, "g", "at", "line").orderBy("at").collect()] == [("top", 0), ("top.a", 1), ("top.a.b", 2), ("top.c", 1), ("two", 0)]
    (tmp_path / "rtl-sources" / "p1").mkdir(parents=True)
    (tmp_path / "rtl-sources" / "p1" / "a.sv").write_text("module m; endmodule")
    assert [(r.pipeline_id, r.content) for r in files.rtl_files(spark, str(tmp_path)).collect()] == [("p1", "module m; endmodule")]
    df = spark.createDataFrame([("p", "k1", 1), ("p", "k1", 2), ("q", "k2", 3)], "part string, k string, v int")
    files.upsert(spark, df, str(tmp_path / "t"), ["k"], "part")
    files.upsert(spark, df.where("part = 'q'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["k"], "part")
    assert {(r.k, r.part) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("k1", "p"), ("k2", "q")}
    with pytest.raises(ValueError):
        files.delete_where(df, part="")
    assert files.delete_where(df, part="p").count() == 1
    kinds = files.filelist(spark.createDataFrame([("// c",), ("+incdir+x",), ("-f a.f",), ("-sv",), ("a.v",), (" ",)], "line string"))
    assert sorted(r.kind for r in kinds.collect()) == ["comment", "file", "include", "list", "option"]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(f"2024-01-01 00:0{i % 10}:00", float(i)) for i in range(30)], "t string, v double").select(F.to_timestamp("t").alias("ts"), "v")
    e.write.parquet(str(tmp_path / "in"))
    q = ingest.run(ingest.tumbling(ingest.file_stream(spark, str(tmp_path / "in"), e.schema), "ts", "v"), str(tmp_path / "c"), "tumbled", "complete")
    q.awaitTermination(60)
    want = {r[0]: r[1] for r in e.groupBy(F.window("ts", "300 seconds").start.alias("s")).agg(F.sum("v")).collect()}
    assert {r["start"]: r.total for r in spark.table("tumbled").collect()} == want
    j = spark.createDataFrame([("a", "queued", 1), ("a", "done", 2), ("a", "running", 3), ("b", "running", 1)], "job_id string, status string, at int")
    assert {r.job_id: r.status for r in ingest.job_state(j).collect()} == {"a": "done", "b": "running"}


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, v double")
    assert list(metrics.percentiles(df, ["g"], "v").first()) == ["a", 5.0, 10.0, 10.0, 10]


def test_replies(spark):
    none = spark.createDataFrame([], "a int")
    assert (search.reply_state(none, True), search.reply_state(none, False)) == ("no_match", "not_found")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fixed_tables(spark):
    from gritstone.queries import _QUESTIONS

    rows = spark.createDataFrame(_QUESTIONS, "q string, want string")
    assert [r.got for r in rows.select(T.query_type(F.col("q")).alias("got")).collect()] == [w for _, w in _QUESTIONS]
    names = ["i_ai_clk", "o_EDC_x", "edc_err_irq", "npu_in_a", "reg_psel", "i_dm_clk", "i_noc_reset_n", "i_tensix_reset", "sfr_a", "iso_en", "data"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(T.port_class(F.col("n"))).collect()
    assert [r[0] for r in got] == ["AI_Clock_Reset", "EDC_APB", "EDC_APB", "AXI_Interface", "APB_Register", "DM_Clock_Reset", "NoC_Clock_Reset", "Tensix_Reset", "SFR_Memory_Config", "PRTN_Power", "Other"]
    p = rtl.parse("module m (input wire [7:0][3:0] i_d, output logic o, input reg_a, input wire [7:0] i_d); endmodule")[0]["ports"]
    assert [(x["name"], x["width"]) for x in p] == [("i_d", 32), ("o", 1), ("reg_a", 1)]


def test_hits_of_another_pipeline_raise(spark):
    hits = spark.createDataFrame([("tool-guide", "command"), ("tool-guide", "example"), ("other", "option")], "pipeline_id string, object_type string")
    assert claims.clean_hits(hits.where("pipeline_id = 'tool-guide'")).count() == 1
    with pytest.raises(Exception, match="hit of pipeline other"):
        claims.clean_hits(hits).collect()
    got = spark.createDataFrame([("",), (" a ",), ("x" * 257,), (None,)], "q string").select(claims.length_ok(F.col("q"))).collect()
    assert [r[0] for r in got] == [False, True, False, False]


def test_chunks_leave_as_they_come(spark):
    """A task holds the chunks of a megabyte or one text, not of a whole batch of texts."""

    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    texts = ["One two. " * 20_000, None, "", *["Three four. " * 50_000] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(chunk.chunks(Caught(), chunk.by_sentences).run(iter([batch])))
    assert len(out) > 3 and max(sum(map(len, b.column(2).to_pylist())) for b in out) < 2_000_000
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(k, i, c) for k, t in enumerate(texts) if t for i, c in enumerate(chunk.by_sentences(t))]
