"""The archive's operators, on literals."""

import pytest

from gritstone.operators import archive as A


def test_listing_and_search(spark):
    o = spark.createDataFrame([(k,) for k in ("documents/a/s/x/y.md", "documents/a/", "documents/a/z.md", "documents/b/s/q.md", "other/a/s/x.md", None)], "key string")
    rows = lambda df: [tuple(r) for r in df.orderBy("key").collect()]
    assert rows(A.listing(o, "a")) == [("documents/a/s/x/y.md", "x/y.md", "a", "s"), ("documents/a/z.md", "z.md", "", "")]
    assert len(rows(A.listing(o, "", "s"))) == 3 and rows(A.listing(o, "a", most=1)) == []
    h = spark.createDataFrame([("u1", "t", "codebeamer", 1.0), ("u2", "t", "archive_md", None), ("u0", "t", "archive_md", 1.0)], "uri string, topic string, source string, score double")
    assert [r.uri for r in A.search(h, "t").collect()] == ["u0", "u1", "u2"] and A.search(h, "t", "codebeamer").count() == 1
    with pytest.raises(ValueError):
        A.search(h, source="elsewhere")


def test_answers_and_status(spark):
    kind = "id int, citations array<struct<text:string,references:array<struct<uri:string>>>>, response_time_ms int"
    r = spark.createDataFrame([(1, [("t", [("a",), ("b",)]), ("t", None), ("t", [("a",)])], 30001), (2, [], 30000), (3, None, None)], kind)
    assert [(x.uris, x.citation_count, x.no_citation, x.slow) for x in A.answers(r, "id").orderBy("id").collect()] == [(["a", "b", "a"], 3, False, True), ([], 0, True, False), (None, 0, True, False)]
    assert A.index_status(spark.createDataFrame([("", "m")], "version string, model string")).first() == ("unknown", None, "m")
    assert A.extraction_outcome(spark.createDataFrame([], "status string")).first() == (0, 0, 0, 0)
