"""Providers and the search that uses them."""

import numpy as np
from pyspark.sql import functions as F

from gritstone.plans import providers as V
from gritstone.plans.rtl_search import fingerprint, rtl_search


def test_embedding(spark):
    texts = ["a bb a", "", None, "x" * 150, "y" * 1000, "zz top"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.embedded(F.col("t"), lambda: V.WordEmbedder(8, 120)).alias("v")).orderBy("i").collect()]
    model = V.WordEmbedder(8)
    assert np.allclose(got[0], model.embed([texts[0]])[0]) and got[1] == [0.0] * 8 and got[2] is None and np.allclose(got[5], model.embed(["zz top"])[0])
    assert np.allclose(got[3], model.embed(["x" * 105])[0])  # one cut makes it short enough
    assert got[4] is None  # three do not


def test_embed_text(spark):
    rows = [("h", "p", "", 1, None), ("", "p" * 9000, "c", 1, None), (None, "", None, 7, "d"), ("", "", "", None, None)]
    df = spark.createDataFrame(rows, "hdd_content string, parsed_summary string, claim_text string, n int, _id string")
    assert [r[0] for r in df.select(V.embed_text(df.columns)).collect()] == ["h", "p" * 8000, "n: 7", "(empty)"]


def test_topics(spark):
    class Broken(V.KeywordJudge):
        def topics(self, texts):
            raise OSError

    known = ["soc/clock", "ucie/phy", "flat", "noc/router", "edc/ring"]
    df = spark.createDataFrame([("the Clock of the phy, flat",), ("router ring clock phy",), (None,), ("",)], "q string")
    assert [r[0] for r in df.select(V.topics(F.col("q"), lambda: V.KeywordJudge(known))).collect()] == [["soc/clock", "ucie/phy"], ["soc/clock", "ucie/phy", "noc/router"], [], []]
    assert [r[0] for r in df.select(V.topics(F.col("q"), lambda: Broken(known))).collect()] == [[]] * 4
    assert V.KeywordJudge(known).score(["clock phy", ""]).tolist() == [0.4, 0.0]
    assert spark.range(1).select(V.FixedClock("2024-01-02 03:04:05").now().cast("string")).first()[0] == "2024-01-02 03:04:05"


def test_grounding_prompt():
    rules = {"strict": "only these", "hybrid": "mark what is inferred"}
    assert V.grounding_prompt("free", [("a", "b")], rules) == ""
    assert V.grounding_prompt("strict", [("a", "b"), (None, None)], rules) == "only these\n  - claim_id: a | statement: b\n  - claim_id: unknown_1 | statement: \n"
    assert V.grounding_prompt("other", [], rules) == "mark what is inferred\n"


INDEX = "id int, analysis_type string, pipeline_id string, module_name string, sub_record_type string, claim_text string, topic string, hdd_section_title string, edge_type string, src string, dst string, file_path string, used_in_n1 boolean, raw_text string"


def test_search_end_to_end(spark):
    rec = lambda i, text, kind="other", n1=False, **k: (i, kind, k.get("p", "p"), k.get("m"), k.get("sub"), k.get("claim"), "t", None, None, None, None, k.get("path"), n1, text)
    rows = [rec(1, "clock port"), rec(2, "clock port", n1=True, path="a/x.v"), rec(3, "clock port", path="b/x.v"), rec(4, "clock reset", "claim", claim="c" * 300), rec(5, "clock port", "claim", claim="c" * 200 + "d"), rec(6, "other words here", "module_parse", m="m"), rec(7, "clock port", p="q"), rec(8, None)]
    ix = spark.createDataFrame(rows, INDEX)
    ix = ix.withColumn("embedding", V.embedded(F.col("raw_text"), V.WordEmbedder))
    got = rtl_search(ix, ["clock port", "", "  "], V.WordEmbedder, "id", 3, pipeline_id="p").orderBy("rank").collect()
    # 2 weighs double and takes its file's place from 3; 5 stands for 4, whose claim begins alike; 7 is filtered, 8 has no vector
    assert [(r.id, r.score, r.rank, r.query_type) for r in got] == [(2, 2.0, 1, "port_query"), (1, 1.0, 2, "port_query"), (5, 1.0, 3, "port_query")]
    assert rtl_search(ix, ["clock port"], V.WordEmbedder, "id", 1).collect()[0].id == 2
    keys = {r.id: r.f for r in ix.select("id", fingerprint().alias("f")).collect()}
    assert keys[2] == keys[3] == "other::x.v" and keys[4] == keys[5] and keys[6] == "mp:m:module_parse:"
    assert rtl_search(ix.limit(0), ["clock"], V.WordEmbedder, "id").count() == 0
