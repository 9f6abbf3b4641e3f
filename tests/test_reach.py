"""Small operators on literals: files in, files out, shapes of claims and answers, windows on streams."""

import json

from pyspark.sql import functions as F

from gritstone.operators import claims, metrics, search, verify
from gritstone.sources import files
from gritstone.streaming import ingest


def test_texts_and_archives(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo\n")
    (tmp_path / "y.v").write_text("module y; endmodule")
    got = {r.path.rsplit("/", 1)[-1]: (r.content, r.document_type) for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"x.md": ("one\ntwo\n", "markdown"), "y.v": ("module y; endmodule", "rtl")}
    names = ["d/e/spec.md", "__MACOSX/d/spec.md", "d/.hidden.md", "d/x.unknown", "top.sv"]
    assert {r.name: r.flat for r in files.archive_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()} == {"d/e/spec.md": "d_e_spec.md", "top.sv": "top.sv"}


def test_sinks(spark, tmp_path):
    files.to_jsonl(spark.createDataFrame([("b", 1)], "z string, a int"), str(tmp_path / "j"))
    lines = [x for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == ['{"a":1,"z":"b"}'] and list(json.loads(lines[0])) == ["a", "z"]
    tree = spark.createDataFrame([("t.a", "m", ["c1", "c2"], [], ["r"])], "path string, module string, clocks array<string>, resets array<string>, memories array<string>")
    assert files.hierarchy_csv(tree).first().asDict() == {"Hierarchy": "t.a", "Module": "m", "Clock": "c1/c2", "Reset": "", "Memory_Instances": "r"}
    ids = [r[0] for r in spark.createDataFrame([("p", "f"), ("p", "f"), ("p", "g")], "a string, b string").select(files.point_id("a", "b")).collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 16 for i in ids)


def test_claims_and_evidence(spark):
    c = spark.createDataFrame([("x", "t", None), ("y", "t", "n1"), ("z", "u", None)], "claim_id string, topic string, variant string")
    assert [r.claim_id for r in claims.of_variant(c, "t", "default").collect()] == ["x"] and [r.claim_id for r in claims.of_variant(c, "t", "n1").collect()] == ["y"]
    assert {(r.version, r.status, r.approval_status) for r in claims.approved_from_parser(c).collect()} == {(1, "verified", "approved")}
    e = spark.createDataFrame([(None, None, 1.7), ("s", "strong", -2.0), ("s", "strong", None)], "source string, strength string, confidence double").select(F.struct("*").alias("c"))
    assert [tuple(r[0]) for r in e.select(verify.normalised_evidence(F.col("c"))).collect()] == [("unknown", "weak", 1.0), ("s", "strong", 0.0), ("s", "strong", 0.0)]


def test_shapes(spark):
    hits = spark.createDataFrame([("f", "v", 1, "s", 0.5), ("f", "v", 2, "s", 0.9), ("f", None, 3, "s", 1.0), ("f", "v", 4, "s", 0.7)], "source_file string, doc_version string, page int, section string, score double")
    assert [r.page for r in search.shaped(hits, [F.desc("score"), "page"], 2).collect()] == [2, 4]
    assert metrics.named_events(hits, F.col("source_file"), "f").first().n == 4


def test_sliding_windows_on_a_stream(spark, tmp_path):
    e = spark.createDataFrame([("u", f"2024-01-01 00:0{i}:30", float(i)) for i in range(8)], "user string, t string, v double").select("user", F.to_timestamp("t").alias("ts"), "v")
    e.write.parquet(str(tmp_path / "in"))
    ingest.run(ingest.sliding(ingest.file_stream(spark, str(tmp_path / "in"), e.schema), "ts", "user", "v"), str(tmp_path / "c"), "slid", "complete").awaitTermination(60)
    got = {r.start.strftime("%H:%M"): (r.largest, r.n) for r in spark.table("slid").collect()}
    assert len(got) == 12 and got["00:03"] == (7.0, 5) and got["00:07"] == (7.0, 1) and got["00:00"] == (4.0, 5)


def test_created_claims(spark):
    kind = "claim_id string, topic string, variant string, statement string, confidence double, evidence array<struct<source_chunk:string,chunk_hash:string,extraction_date:string>>, derived_from array<string>"
    ev = [("chunk", None, None), ("c2", "known", "2020")]
    words = "the clock of the block runs at one gigahertz"
    new = [("n1", "a/b", None, words, 0.5, ev, ["d"]), ("n2", "a/b", "v", "something else entirely here", 0.5, ev, None), ("n3", "ab", None, words, 2.0, [], None), ("o1", "a/b", None, words, 0.5, ev, None), ("n4", "a/b", None, words, 0.5, ev, None), ("n4", "a/b", None, words, 0.5, ev, None)]
    old = [("o1", "a/b", None, words + " now", 0.5, ev, [], 1, "draft"), ("o1", "a/b", None, words + " now", 0.5, ev, [], 2, "verified"), ("o2", "a/c", None, words, 0.5, ev, [], 1, "verified"), ("o3", "a/b", None, words, 0.5, ev, [], 1, "draft")]
    made, changed, refused = claims.create(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind + ", version int, status string"), F.lit("2024"))
    got = {r.claim_id: r for r in made.collect()}
    assert set(got) == {"n1", "n2"} and got["n1"].derived_from == ["d", "o1"] and got["n2"].derived_from == [] and got["n2"].topic_variant == "a/b#v" and got["n1"].variant == "default"
    assert (got["n1"].version, got["n1"].status, got["n1"].approval_status) == (1, "draft", "not_applicable") and len(got["n1"].evidence[0].chunk_hash) == 64
    assert got["n1"].evidence[0].extraction_date == "2024" and tuple(got["n1"].evidence[1]) == ("c2", "known", "2020")
    assert [(r.claim_id, r.version, r.status) for r in changed.collect()] == [("o1", 2, "conflicted")]
    assert {(r.claim_id, tuple(r.errors)) for r in refused.collect()} == {("n3", ("evidence", "confidence", "topic")), ("o1", ("claim_id",)), ("n4", ("claim_id",))}


def test_json_maps_and_names(spark):
    from gritstone.functions import text as T

    texts = ['["a", "b"]', 'Here: ```json\n["x"]\n``` done', "plain", "", None, "[not json", "[1, 2]", "[]"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.json_list(F.col("t"))).collect()]
    assert got == [["a", "b"], ["x"], ["plain"], [], [], ["[not json"], ["1", "2"], []]
    m = spark.createDataFrame([({"a": "1", "z": "2", "n": None},), (None,)], "m map<string,string>").select(T.listed_keys(F.col("m"), ["a", "n"], {"a": F.lit("d"), "t": F.lit(5)}))
    assert [r[0] for r in m.collect()] == [{"t": "5", "a": "1"}, {"a": "d", "t": "5"}]
    assert [r[0] for r in spark.createDataFrame([("x/used_in_n1/y",), ("used_in_n1",), (None,)], "p string").select(T.used_in_n1(F.col("p"))).collect()] == [True, False, False]
    T.no_overlap(["a"], ["b"])
    import pytest

    with pytest.raises(ValueError, match="a"):
        T.no_overlap(["a", "c"], ["b", "a"])


def test_dataflow_and_sub_records(spark):
    from gritstone.operators import rtl

    text = "module top #(parameter W = 8) (input a, input b);\n sub u1 (.i_x(d[7:0]), .out_y({p, q}), .z(e[3]));\nendmodule"
    m = rtl.parsed(spark.createDataFrame([("f", text)], "path string, content string"))
    assert {(r.child_port, r.parent_signal, r.direction, r.bit_width, r.width_mismatch) for r in rtl.dataflow(m).collect()} == {("i_x", "d", "input", 8, False), ("out_y", "{p, q}", "output", None, False), ("z", "e", "unknown", None, False)}
    assert rtl.sub_records(m, "p").count() == 0
    got = {r.sub_record_type: (r.parsed_summary, r.instance_list, r.parameter_list) for r in rtl.sub_records(m, "p", 2).collect()}
    assert got["instance_hierarchy"] == ("Module 'top' instance hierarchy: sub u1", "sub u1", "") and got["parameter_config"] == ("Module 'top' parameter configuration: W=8", "", "W=8") and "2 total ports" in got["port_summary"][0]
