"""Queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import analyses, archive, blocks, chunk, claims, emitters, generate, graph, metrics, policy, records, rejects, rtl, search, spans, verify
from .plans.providers import WordEmbedder, embedded
from .plans.rtl_search import rtl_search as searched
from .sources import files
from .streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"


@query(f"""SELECT vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_PROBE_SQL}), 6) AS score
FROM embeddings WHERE label <> 0 ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk_filtered(spark, d):
    e = table(spark, d, "embeddings").where("label <> 0")
    return search.vector_topk(e, F.col("embedding"), PROBE, 20, "vec_id").select("vec_id", "label", "score")


@query(f"""WITH s AS (SELECT vec_id, label, vec_id % 7 = 0 AS flagged, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_PROBE_SQL}), 6) AS score FROM embeddings),
b AS (SELECT *, round(CASE WHEN flagged THEN score * 2 ELSE score END, 6) AS boosted FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY label, lang ORDER BY boosted DESC, flagged DESC, vec_id) AS n FROM b JOIN documents ON doc_id = vec_id)
SELECT vec_id, label, lang, flagged, boosted FROM r WHERE n = 1 ORDER BY boosted DESC, flagged DESC, vec_id LIMIT 20""")
def search_boost_dedup(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(x) for x in PROBE])
    s = e.select("vec_id", "label", F.round(T.cosine(F.transform("embedding", lambda x: x.cast("double")), q), 6).alias("score"))
    s = search.boost(s, F.col("vec_id") % 7 == 0, "vec_id")
    s = s.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    order = [F.desc("boosted"), F.desc("flagged"), "vec_id"]
    return search.first_by(s, ["label", "lang"], order).orderBy(*order).limit(20).select("vec_id", "label", "lang", "flagged", "boosted")


#: Questions with their class, by literals; the second column is what each must give.
_QUESTIONS = [
    ("which input has the AXI bus", "port_query"), ("reset of the block", "port_query"), ("모듈 트리 보기", "hierarchy_query"), ("every instance of x", "hierarchy_query"), ("SizeX of the grid", "config_query"),
    ("localparam list", "config_query"), ("ring between routers", "connectivity_query"), ("데이터 연결", "connectivity_query"), ("what is this", "general_query"), ("", "general_query"),
]
_QUESTION_SQL = ", ".join(f"({i}, '{q}', '{c}')" for i, (q, c) in enumerate(_QUESTIONS))


@query(f"""WITH t AS (SELECT conv_id, turn, id, lower(concat_ws(' ', q, text)) AS t FROM conversations, (VALUES {_QUESTION_SQL}) v(id, q, c) WHERE (conv_id + turn) % {len(_QUESTIONS)} = id)
SELECT conv_id, turn, id, CASE WHEN regexp_matches(t, '포트|port|input|output|인터페이스|axi|apb|clock|reset|clk') THEN 'port_query' WHEN regexp_matches(t, '인스턴스|계층|hierarchy|instantiate|모듈 트리|instance|sub-module') THEN 'hierarchy_query'
WHEN regexp_matches(t, '파라미터|parameter|localparam|설정|크기|size') THEN 'config_query' WHEN regexp_matches(t, '연결|topology|ring|chain|routing|generate|feedthrough') THEN 'connectivity_query' ELSE 'general_query' END AS query_type FROM t""")
def query_type_classify(spark, d):
    """Each turn of the conversations, with a question of known class before it."""
    known = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(_QUESTIONS)], "id int, q string")
    c = table(spark, d, "conversations").withColumn("id", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_QUESTIONS))).cast("int"))
    return c.join(F.broadcast(known), "id").select("conv_id", "turn", "id", T.query_type(F.concat_ws(" ", "q", "text")).alias("query_type"))


@query(f"""WITH t AS (SELECT conv_id, turn, lower(concat_ws(' ', q, text)) AS t, ['claim', 'module_parse', 'hdd_section', 'x'][conv_id % 4 + 1] AS kind FROM conversations, (VALUES {_QUESTION_SQL}) v(id, q, c) WHERE (conv_id + turn) % {len(_QUESTIONS)} = id),
c AS (SELECT conv_id, turn, kind, CASE WHEN regexp_matches(t, '포트|port|input|output|인터페이스|axi|apb|clock|reset|clk') THEN [4.0, 0.5, 2.0] WHEN regexp_matches(t, '인스턴스|계층|hierarchy|instantiate|모듈 트리|instance|sub-module') THEN [1.5, 3.0, 2.0]
WHEN regexp_matches(t, '파라미터|parameter|localparam|설정|크기|size') THEN [4.0, 1.0, 2.0] WHEN regexp_matches(t, '연결|topology|ring|chain|routing|generate|feedthrough') THEN [4.0, 1.0, 2.0] ELSE [3.0, 1.0, 2.0] END AS w FROM t)
SELECT conv_id, turn, kind, coalesce(w[list_position(['claim', 'module_parse', 'hdd_section'], kind)], 1.0)::DOUBLE AS boost FROM c""")
def dynamic_boost(spark, d):
    """The weight of a kind of record for the class of each turn."""
    known = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(_QUESTIONS)], "id int, q string")
    c = table(spark, d, "conversations").withColumn("id", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_QUESTIONS))).cast("int")).join(F.broadcast(known), "id")
    kind = F.get(F.array(*map(F.lit, ("claim", "module_parse", "hdd_section", "x"))), (F.col("conv_id") % 4).cast("int"))
    return c.select("conv_id", "turn", kind.alias("kind"), T.boost_of(T.query_type(F.concat_ws(" ", "q", "text")), kind).alias("boost"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))"
_PAIRS = """WITH t AS MATERIALIZED (SELECT doc_id, {g} AS g, {tok} AS t FROM documents),
p AS (SELECT a.g, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND len(a.t) >= {least} * len(b.t) AND len(b.t) >= {least} * len(a.t) AND len(a.t) > 0)
SELECT g, a, b, round(i / (na + nb - i)::DOUBLE, 6) AS score FROM p WHERE i / (na + nb - i)::DOUBLE >= {least}"""


@query(_PAIRS.format(g="lang", tok=_TOK, least=0.9))
def near_duplicate_docs(spark, d):
    return claims.pairs_alike(table(spark, d, "documents").withColumnRenamed("lang", "g"), "g", "doc_id", "text", 0.9)


@query(_PAIRS.format(g="source", tok=_TOK, least=0.7))
def contradiction_pairs(spark, d):
    return claims.pairs_alike(table(spark, d, "documents").withColumnRenamed("source", "g"), "g", "doc_id", "text", 0.7)


@query("""SELECT claim_id, version, o_orderkey AS claim FROM (SELECT o_custkey AS claim_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def claim_latest_version(spark, d):
    v = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("claim"), v.cast("long").alias("version"))
    return claims.latest(o).select("claim_id", "version", "claim")


_STATUS = "CASE {c} WHEN 'O' THEN 'draft' WHEN 'F' THEN 'verified' ELSE 'conflicted' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_STATUS.format(c='o_orderstatus')} AS old, {_STATUS.format(c="lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")} AS new, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
SELECT o_orderkey, old, new, (old, new) IN ({', '.join(str(t) for t in claims.TRANSITIONS)}) AS legal FROM s WHERE nxt IS NOT NULL""")
def claim_transition_check(spark, d):
    status = lambda c: F.when(c == "O", "draft").when(c == "F", "verified").otherwise("conflicted")
    o = table(spark, d, "orders").withColumn("nxt", F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("nxt is not null")
    return claims.legal(o.select("o_orderkey", status(F.col("o_orderstatus")).alias("old"), status(F.col("nxt")).alias("new")), "old", "new")


@query("""SELECT doc_id, round(1 - (0.4 * quality + 0.4 * (1 - toxic) + 0.2 * s), 4) AS risk, CASE WHEN round(1 - (0.4 * quality + 0.4 * (1 - toxic) + 0.2 * s), 4) < 0.3 THEN 'verified' WHEN round(1 - (0.4 * quality + 0.4 * (1 - toxic) + 0.2 * s), 4) < 0.7 THEN 'pending' ELSE 'conflicted' END AS verdict
FROM (SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, ((length(text) BETWEEN 10 AND 500)::INT + 1 + (n_chars > 100)::INT) / 3.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id))""")
def cross_check_risk(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    s3 = claims.rule_score(F.col("text"), F.concat(F.col("source"), F.lit("/"), F.col("lang")), F.col("n_chars") > 100)
    r = claims.risk(F.col("quality").cast("double"), 1 - F.col("toxic").cast("double"), s3)
    return j.select("doc_id", r.alias("risk"), claims.verdict(r).alias("verdict"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars % 5 < 1 THEN 'evidence' END, CASE WHEN NOT (n_chars / 1000.0 BETWEEN 0 AND 1) THEN 'confidence' END, CASE WHEN doc_id % 3 = 0 THEN 'topic' END, CASE WHEN NOT (length(text) BETWEEN 10 AND 500) THEN 'statement' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""")
def claim_validation(spark, d):
    topic = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat_ws("/", "source", "lang"))
    e = claims.errors(F.col("text"), topic, F.col("n_chars") / 1000.0, F.col("n_chars") % 5)
    return table(spark, d, "documents").select("doc_id", F.array_join(e, ",").alias("errors"))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY) / count(*)::DOUBLE, 4) AS stale FROM orders GROUP BY 1")
def kpi_stale_ratio(spark, d):
    old = F.count_if(F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00' - INTERVAL 30 DAYS"))
    n = F.count(F.lit(1))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(n.alias("n"), metrics.share(old, n).alias("stale"))


@query("SELECT source, count(*) AS total, count(*) FILTER (length(text) > 0) AS with_text, round(count(*) FILTER (length(text) > 0) / count(*)::DOUBLE, 4) AS ratio FROM documents GROUP BY 1")
def parser_contribution(spark, d):
    return metrics.contribution(table(spark, d, "documents"), "source", "text")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (r = greatest(1, ceil(0.5 * n))) AS p50, max(value) FILTER (r = greatest(1, ceil(0.95 * n))) AS p95, max(value) FILTER (r = greatest(1, ceil(0.99 * n))) AS p99, max(n) AS n FROM r GROUP BY 1""")
def latency_percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT event_id, user_id, count(*) OVER w AS n, round(max(value) OVER w, 4) AS largest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)""")
def rolling_5min(spark, d):
    return metrics.rolling(table(spark, d, "events"), "user_id", "ts", "value", "event_id")


@query("""WITH b AS (SELECT floor(epoch(ts) / 300)::BIGINT AS bucket, round(sum(value), 4) AS total FROM events GROUP BY 1), c AS (SELECT *, (total > 100)::INT AS breach FROM b)
SELECT bucket, total, breach, sum(breach) OVER (ORDER BY bucket RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS alarm FROM c""")
def alarm_breach_windows(spark, d):
    return metrics.alarm_windows(table(spark, d, "events"), "ts", "value", 100, 2)


@query("""WITH g AS (SELECT *, (ts - lag(ts) OVER w > INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def session_gap(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    e = table(spark, d, "events").withColumn("fresh", F.when(before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0))
    return e.withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[GROUNDED from claim:' || conv_id || '] ' || replace(text, '. ', '. [INFERRED] ') WHEN 1 THEN replace(text, '. ', '. [GROUNDED] ') || ' [INFERRED] end' ELSE text END AS t FROM conversations WHERE text IS NOT NULL),
n AS (SELECT conv_id, turn, len(regexp_extract_all(t, '\[GROUNDED')) AS n_grounded, len(regexp_extract_all(t, '\[INFERRED')) AS n_inferred FROM a), r AS (SELECT *, round(coalesce(n_inferred::DOUBLE / nullif(n_inferred + n_grounded, 0), 0), 4) AS inferred_ratio FROM n)
SELECT *, inferred_ratio > 0.5 AS warn FROM r""")
def grounding_ratio(spark, d):
    """Turns as answers, with marks where sentences begin."""
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[GROUNDED from claim:"), F.col("conv_id").cast("string"), F.lit("] "), F.replace("text", F.lit(". "), F.lit(". [INFERRED] "))))
    t = t.when(F.col("turn") % 3 == 1, F.concat(F.replace("text", F.lit(". "), F.lit(". [GROUNDED] ")), F.lit(" [INFERRED] end"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", *[c.alias(n) for n, c in T.grounding(t).items()])


@query("""WITH s AS (SELECT conv_id, trim(unnest(regexp_extract_all(text, '[^.!?。\\n]+[.!?。]*'))) AS s FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, count(*) FILTER (length(s) % 3 > 0) AS supported, count(*) FILTER (length(s) % 3 = 0) AS unsupported, count(*) AS total FROM s WHERE regexp_matches(s, '[\\p{L}\\p{N}]') GROUP BY 1""")
def sentence_coverage(spark, d):
    s = verify.answer_sentences(table(spark, d, "conversations"), "conv_id", "text")
    return metrics.coverage(s.withColumn("evidence_count", F.length("sentence") % 3), "conv_id", "evidence_count")


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS t FROM benchmark),
w AS (SELECT item_id, unnest(t) AS w, len(t) AS n FROM b), d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))) AS w FROM documents)
SELECT doc_id, item_id, count(*) AS common FROM w JOIN d USING (w) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n""")
def benchmark_overlap(spark, d):
    b = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    w = b.select("item_id", F.explode("t").alias("w"), F.size("t").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w"))
    return docs.join(w, "w").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("common")).where("common >= 0.8 * n").drop("n")


@query("""SELECT r_name || '.' || n_name || '.' || s_name AS path, 2::BIGINT AS depth FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def hierarchy_paths(spark, d):
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")).unionByName(s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("src"), F.col("s_name").alias("dst")))
    return graph.paths(r.select(F.col("r_name").alias("id")), e, 2).where("depth = 2").select(F.array_join("path", ".").alias("path"), "depth")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def roots_anti_join(spark, d):
    return graph.roots(table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 5000"), "n_nationkey", "s_nationkey")


_EDGES = """SELECT DISTINCT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst FROM lineitem
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"""


@query(f"""WITH e AS ({_EDGES}) SELECT a.src AS root, c.dst AS at, 3::BIGINT AS depth, count(*) AS n FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src LIKE 'p%' GROUP BY ALL""")
def signal_trace(spark, d):
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    name = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    parts = li.select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst")).distinct()
    e = parts.unionByName(o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))).unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")))
    return graph.paths(parts.select(F.col("src").alias("id")).distinct(), e, 3).where("depth = 3").groupBy("root", "at", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_nationkey AS from_domain, c_nationkey AS to_domain, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2""")
def clock_crossings(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    dom = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("domain")).unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("domain")))
    return graph.crossings(e, dom).groupBy("from_domain", "to_domain").agg(F.count(F.lit(1)).alias("n"))


_LI = "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem"


@query(f"""WITH e AS ({_LI}), g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, id LIMIT 100)
SELECT id, degree, (SELECT count(*) FROM e WHERE e.src IN (SELECT id FROM g) AND e.dst IN (SELECT id FROM g)) AS inner_edges FROM g""")
def graph_degree_truncate(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    nodes, kept = graph.truncate_by_degree(e, 100)
    return nodes.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("inner_edges"))))


@query("""SELECT l_partkey, l_suppkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, arg_max(l_shipdate, l_orderkey * 10 + l_linenumber) AS l_shipdate FROM lineitem GROUP BY 1, 2""")
def graph_upsert(spark, d):
    return graph.upsert_nodes(table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_partkey", "l_suppkey"], "seq", ["l_quantity", "l_shipdate"])


@query("""WITH a AS (SELECT p_partkey, p_size AS old FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS new FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, old, new, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN old IS NOT DISTINCT FROM new THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def variant_delta(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return graph.variant_delta(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 4 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))), "p_partkey", "p_size")


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
u AS (SELECT id, 0 AS level FROM e WHERE id LIKE 'c%' UNION SELECT e.parent, level + 1 FROM u JOIN e ON e.id = u.id WHERE level < 5)
SELECT id, min(level)::BIGINT AS level FROM u WHERE level > 0 GROUP BY 1""")
def stale_propagation(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    e = c.select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent")).unionByName(n.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent")))
    return graph.ancestors(c.select(name("c", "c_custkey").alias("id")), e)


@query("""WITH s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)
SELECT e.event_id, e.user_id, s.value AS section FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_section(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    s = e.join(F.broadcast(first), "event_type", "left_semi").groupBy("user_id", "ts").agg(F.max("value").alias("section"))
    return metrics.asof(e, s, "user_id", "ts", "section", "event_id").select("event_id", "user_id", "section")


@query("""WITH m AS (SELECT *, sum((event_type = (SELECT max(event_type) FROM events))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scope, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END AS opened FROM events)
SELECT event_id, last_value(opened IGNORE NULLS) OVER (PARTITION BY user_id, scope ORDER BY ts, event_id) AS owner FROM m""")
def scope_carry_forward(spark, d):
    e = table(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.crossJoin(F.broadcast(ends))
    return metrics.carry_forward(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == F.col("lo"), F.col("event_id")), F.col("event_type") == F.col("hi"), "owner").select("event_id", "owner")


@query("SELECT event_id, ts AS block_start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2100-01-01') AS block_end FROM events")
def block_tiling(spark, d):
    return metrics.tiles(table(spark, d, "events"), "user_id", "ts", F.expr("TIMESTAMP_NTZ '2100-01-01 00:00:00'"), "event_id").select("event_id", F.col("ts").alias("block_start"), "block_end")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS lo, epoch(o_orderdate)::BIGINT // 86400 + (o_orderkey % 400) AS hi FROM orders)
SELECT a.o_orderkey, (SELECT arg_min(b.o_orderkey, (b.hi - b.lo) * 100000000 + b.o_orderkey) FROM b WHERE b.o_custkey = a.o_custkey AND b.lo <= a.lo AND b.hi >= a.hi AND b.o_orderkey <> a.o_orderkey AND (b.lo < a.lo OR b.hi > a.hi)) AS parent FROM b a""")
def innermost_interval(spark, d):
    lo = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    b = table(spark, d, "orders").select("o_orderkey", "o_custkey", lo.alias("lo"), (lo + F.col("o_orderkey") % 400).alias("hi"))
    return spans.innermost(b, "o_custkey", "o_orderkey", "lo", "hi")


_PATHS = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'documents/soc/ucie/phy_spec.md' WHEN 1 THEN 'documents/soc/' || p_brand || '/sub/Top-OVERVIEW.v' WHEN 2 THEN 'x.md' WHEN 3 THEN 'a/b/_guide.pdf'
WHEN 4 THEN 'rtl/noc/' || p_size || '/tt_edc_top.svh' WHEN 5 THEN 'rtl\\fpu\\mem_' || p_size || '.vhd' WHEN 6 THEN 'team/kind/plain.name.tcl' ELSE 'team/' || p_type END AS path FROM part"""


def _paths(spark, d) -> DataFrame:
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 8
    cases = [F.lit("documents/soc/ucie/phy_spec.md"), F.concat(F.lit("documents/soc/"), "p_brand", F.lit("/sub/Top-OVERVIEW.v")), F.lit("x.md"), F.lit("a/b/_guide.pdf"), F.concat(F.lit("rtl/noc/"), F.col("p_size").cast("string"), F.lit("/tt_edc_top.svh")), F.concat(F.lit("rtl\\fpu\\mem_"), F.col("p_size").cast("string"), F.lit(".vhd")), F.lit("team/kind/plain.name.tcl")]
    path = F.concat(F.lit("team/"), "p_type")
    for i, c in enumerate(cases):
        path = F.when(kind == i, c).otherwise(path)
    return table(spark, d, "part").select(k, path.alias("path"))


@query(f"""WITH p AS ({_PATHS}) SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ucie/phy' WHEN 1 THEN string_split(path, '/')[3] || '/sub/Top' WHEN 2 THEN '' WHEN 3 THEN 'b' WHEN 4 THEN 'noc/' || string_split(path, '/')[3] || '/tt_edc_top' WHEN 5 THEN '' WHEN 6 THEN 'kind/plain.name' ELSE '' END AS topic FROM p""")
def topic_from_path(spark, d):
    return _paths(spark, d).select("p_partkey", T.topic_from_path(F.col("path")).alias("topic"))


@query(f"""WITH p AS ({_PATHS}) SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'markdown' WHEN 1 THEN 'rtl' WHEN 2 THEN 'markdown' WHEN 3 THEN 'pdf' WHEN 4 THEN 'rtl' WHEN 5 THEN 'rtl' WHEN 6 THEN 'script' ELSE 'other' END AS document_type FROM p""")
def document_type_map(spark, d):
    return _paths(spark, d).select("p_partkey", T.document_type(F.col("path")).alias("document_type"))


@query(f"""WITH p AS ({_PATHS}) SELECT p_partkey, CASE p_partkey % 8 WHEN 4 THEN 'EDC,NoC' WHEN 5 THEN 'FPU,Memory' ELSE 'unclassified' END AS topics FROM p""")
def topic_classify(spark, d):
    name = F.regexp_extract("path", r"([^/\\\\]+)\.[^.]*$", 1)
    return _paths(spark, d).select("p_partkey", F.array_join(T.topics_of(F.col("path"), name), ",").alias("topics"))


_CELLS = ["sram_macro", "boot_rom", "rf_macro", "alu"]
_INST = "'u_' || s_suppkey || '_' || (s_suppkey % 64 + 1) || 'x' || (s_suppkey % 8 + 1)"


def rendered(spark, d) -> DataFrame:
    """Verilog made from the tables: a module a nation, with a parameter, ports, and an instance a supplier."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    inst = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.format_string("  %s #(.DEPTH(%d)) u_%d_%dx%d (.i_ai_clk(i_ai_clk), .i_data({a, b}), .o_q(q[%d]));", F.element_at(F.array(*[F.lit(c) for c in _CELLS]), (F.col("s_suppkey") % 4 + 1).cast("int")), F.col("s_suppkey"), F.col("s_suppkey"), F.col("s_suppkey") % 64 + 1, F.col("s_suppkey") % 8 + 1, F.col("s_suppkey")))).alias("i"))
    j = n.join(inst, n.n_nationkey == inst.s_nationkey, "left")
    head = F.format_string("// nation %d\nmodule m_%d #(parameter WIDTH = %d, parameter TWICE = WIDTH*2) (\n  input wire i_ai_clk,\n  input i_noc_reset_n,\n  input wire [WIDTH-1:0][1:0] i_reg_data,\n  output [TWICE-1:0] o_edc_flit,\n  inout io_pad\n);\n", F.col("n_nationkey"), F.col("n_nationkey"), F.col("n_nationkey") + 1)
    return j.select(F.format_string("rtl-sources/n1_20260101/m_%d.v", F.col("n_nationkey")).alias("path"), F.concat(head, F.array_join(F.coalesce("i", F.array()), "\n"), F.lit("\n  assign o_edc_flit = i_reg_data; /* end */\nendmodule\n")).alias("content"))


@query("SELECT 'm_' || n_nationkey AS module, 5::BIGINT AS ports, 2::BIGINT AS params, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS instances FROM nation")
def rtl_parse_modules(spark, d):
    return rtl.parsed(rendered(spark, d)).select("module", *[F.size(c).cast("long").alias(c) for c in ("ports", "params", "instances")])


@query("SELECT 'm_' || s_nationkey AS src, ['sram_macro', 'boot_rom', 'rf_macro', 'alu'][s_suppkey % 4 + 1] AS dst, " + _INST + " AS instance FROM supplier")
def rtl_instances(spark, d):
    return rtl.hierarchy_edges(rtl.parsed(rendered(spark, d)))


@query("SELECT 'm_' || n_nationkey AS module, unnest(['WIDTH', 'TWICE']) AS name, unnest([(n_nationkey + 1)::VARCHAR, 'WIDTH*2']) AS value FROM nation")
def rtl_params(spark, d):
    return rtl.parsed(rendered(spark, d)).select("module", F.explode("params").alias("p")).select("module", "p.name", "p.value")


@query("""SELECT 'm_' || n_nationkey AS module, unnest(['i_ai_clk', 'i_noc_reset_n', 'i_reg_data', 'o_edc_flit', 'io_pad']) AS port, unnest(['input', 'input', 'input', 'output', 'inout']) AS direction, unnest([1, 1, 2 * (n_nationkey + 1), 2 * (n_nationkey + 1), 1])::BIGINT AS width, unnest(['AI_Clock_Reset', 'NoC_Clock_Reset', 'APB_Register', 'EDC_APB', 'Other']) AS class FROM nation""")
def port_classify(spark, d):
    return rtl.ports(rtl.parsed(rendered(spark, d))).drop("path")


@query(f"""SELECT 'm_' || s_nationkey AS module, {_INST} AS instance, unnest(['i_ai_clk', 'i_data', 'o_q']) AS port, unnest(['i_ai_clk', '{{a, b}}', 'q[' || s_suppkey || ']']) AS expr, unnest(['simple', 'concatenation', 'simple']) AS kind FROM supplier""")
def port_bindings(spark, d):
    return rtl.port_bindings(rtl.parsed(rendered(spark, d))).drop("path", "target")


@query(f"SELECT 'm_' || s_nationkey AS parent, {_INST} AS instance, s_suppkey % 64 + 1 AS depth, s_suppkey % 8 + 1 AS width, ['SRAM', 'ROM', 'RF'][s_suppkey % 4 + 1] AS type FROM supplier WHERE s_suppkey % 4 < 3")
def sram_inventory(spark, d):
    return rtl.sram_inventory(rtl.parsed(rendered(spark, d))).drop("cell")


@query("SELECT type, count(*) AS n FROM (SELECT 'PORT_CONNECTS_TO' AS type FROM supplier, range(3) UNION ALL SELECT 'ASSIGNS_TO' FROM nation) GROUP BY 1")
def signal_path_edges(spark, d):
    return graph.breakdown(rtl.signal_edges(rtl.parsed(rendered(spark, d))), "type")


_TILE = "CASE " + " ".join(f"WHEN x = {a} AND y = {b} THEN '{k}'" for (a, b), k in emitters.TILES.items()) + " WHEN y <= 2 THEN 'TENSIX' ELSE 'UNKNOWN' END"


@query(f"""WITH s AS (SELECT p_partkey, p_size % 5 AS nx, p_partkey % 7 AS ny FROM part), c AS (SELECT p_partkey, ny, unnest(range(0, nx * ny)) AS ep FROM s WHERE nx > 0 AND ny > 0), g AS (SELECT p_partkey, ep // ny AS x, ep % ny AS y, ep FROM c)
SELECT p_partkey, x, y, ep, {_TILE} AS tile_type FROM g""")
def endpoint_grid(spark, d):
    """A grid a part."""
    sizes = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("nx"), (F.col("p_partkey") % 7).alias("ny"))
    return emitters.endpoint_grid(sizes, "p_partkey", "nx", "ny")[0]


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_size + 3) * 2 - 1 WHEN 1 THEN ceil(log2(p_size))::BIGINT WHEN 2 THEN p_size << 2 WHEN 3 THEN NULL ELSE p_size // 2 + 16 END AS width,
CASE p_partkey % 5 WHEN 3 THEN 'SizeX-' || p_size ELSE '' END AS unresolved FROM part""")
def bitwidth_eval(spark, d):
    """Width expressions in text, evaluated with W = p_size."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("(W+3)*2-1", "$clog2(W)", "W << 2", "SizeX-%d", "W/2 + 8'h10")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.replace(form, F.lit("%d"), F.col("p_size").cast("string")).alias("expr"))
    return rtl.widths(rows, "expr", "p_size").select("p_partkey", "width", "unresolved")


@query("""WITH d AS (SELECT DISTINCT s_nationkey AS g, 'k' || s_suppkey % 4 AS d FROM supplier) SELECT a.g, a.d AS a, b.d AS b FROM d a JOIN d b ON a.g = b.g AND a.d < b.d""")
def cdc_pairs(spark, d):
    return rtl.cdc_pairs(table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.concat(F.lit("k"), (F.col("s_suppkey") % 4).cast("string")).alias("d")), "g", "d")


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) // 2 AS mid FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))
SELECT s_suppkey, CASE WHEN i < mid THEN 'segment_a' WHEN i = mid THEN 'u_turn' ELSE 'segment_b' END AS part FROM r""")
def edc_ring(spark, d):
    return graph.ring(table(spark, d, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "part")


#: Rules that a configuration made from a part breaks, how often, by what of it.
_BROKEN = {
    ("function_timeout_900", "warn"): "k % 50 * 20 > 900", ("function_timeout_600", "warn"): "k % 50 * 20 > 600", ("function_memory", "warn"): "size * 100 > 3008", ("memory_for_short", "warn"): "size * 100 >= 2048 AND k % 50 * 20 <= 60",
    ("bucket_versioning", "deny"): "k % 2 = 1", ("bucket_name", "warn"): "k % 5 = 0", ("ingress_open", "deny"): "k % 4 = 0",
} | {(n, "deny"): "true" for n in ("function_log_group", "bucket_encryption", "trail_missing", "providers_pinned", "budget_required")} | {
    (n, "warn"): "true" for n in ("function_tracing", "reserved_concurrency", "lifecycle_policy", "lifecycle_tiering", "bucket_tiering", "bucket_classes", "alarms_missing", "two_providers", "budget_advised", "estimate")
}


@query("WITH p AS (SELECT p_partkey AS k, p_size AS size FROM part), r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{level}' AS level, count(*) FILTER ({test})::BIGINT AS n FROM p" for (n, level), test in _BROKEN.items()) + """
UNION ALL SELECT 'required_tags', 'deny', sum(3 + CASE WHEN k % 3 = 0 THEN 2 ELSE 3 END)::BIGINT FROM p UNION ALL SELECT unnest(['cost_tag_CostCenter', 'cost_tag_Environment']), 'deny', 2 * count(*)::BIGINT FROM p) SELECT * FROM r WHERE n > 0""")
def policy_eval(spark, d):
    """A configuration a part: a function, a bucket, a security group."""
    k, f = F.col("p_partkey"), lambda x, y, c: F.when(c, F.lit(x)).otherwise(F.lit(y))
    form = '{"resource":{"aws_lambda_function":{"fn_%d":{"memory_size":%d,"timeout":%d,"tags":{%s}}},"aws_s3_bucket":{"%s-%d":{"versioning":[{"enabled":%s}]}},"aws_security_group":{"g":{"ingress":[{"cidr_blocks":["10.0.0.0/8","%s"],"from_port":%d}]}}}}'
    text = F.format_string(form, k, F.col("p_size") * 100, k % 50 * 20, f('"Project":"p"', "", k % 3 == 0), f("Bucket", "bucket", k % 5 == 0), k, f("true", "false", k % 2 == 0), f("0.0.0.0/0", "10.1.0.0/16", k % 4 == 0), F.col("p_size"))
    found = policy.violations(table(spark, d, "part").select(k.alias("plan"), text.alias("config")))
    return found.groupBy("rule", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id::VARCHAR AS query_id, event_type AS query_text, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'vector' END AS search_type, (event_id % 1000)::INT AS response_time_ms, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id % 7)::INT END AS citation_count FROM events""")
def bi_query_log(spark, d):
    from .sources.files import bi_rows

    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("query_text"), F.when(F.col("event_id") % 3 != 0, "vector").alias("search_type"), (F.col("event_id") % 1000).cast("string").alias("response_time_ms"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("event_id") % 7).cast("string")).alias("citation_count"))
    return bi_rows(e)


@query("""WITH c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY 1, 2), m AS (SELECT lang, max(c) AS top, sum(c)::BIGINT AS n FROM c GROUP BY 1) SELECT lang, n, round(top / n::DOUBLE, 4) AS dominant, n < 2 OR top / n::DOUBLE < 0.8 AS diverse FROM m""")
def claim_diversity(spark, d):
    return metrics.diversity(table(spark, d, "documents"), "source", "lang")


@query("SELECT page_id, page_id % 9 < 6 AS valid FROM pages")
def uri_valid(spark, d):
    """Each of the six schemes, then an unknown one, one without an id and one with a space."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("rag://", "rtl://", "graph://", "claim://", "job://", "index://", "ftp://", "rag://", "rtl://a ")]), (F.col("page_id") % 9 + 1).cast("int"))
    uri = F.when(F.col("page_id") % 9 == 7, form).otherwise(F.concat(form, F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", T.valid_uri(uri).alias("valid"))


@query("SELECT doc_id, contains(lower(text), 'token') AS hit, regexp_matches(text, '(?i)\\blatest\\b') AS latest FROM documents WHERE contains(lower(text), 'token') OR contains(lower(source), 'token')")
def text_should_search(spark, d):
    return search.should(table(spark, d, "documents"), "token", ["text", "source"]).select("doc_id", F.contains(F.lower("text"), F.lit("token")).alias("hit"), T.unresolved_latest(F.col("text")).alias("latest"))


#: The end of a chunker in SQL: x.out has the chunks that are full, x.now the last.
_CHUNKED = "SELECT doc_id, generate_subscripts({all}, 1) - 1 AS chunk, unnest({all}) AS part FROM r"
_SPACE = r"[\s\x0b\x1c-\x1f]+"


@query(r"""WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+'), lambda s: {'now': s, 'out': []::VARCHAR[]}) AS l FROM documents WHERE text <> ''),
r AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN length(a.now) + length(b.now) > 2000 THEN {'now': b.now, 'out': list_append(a.out, a.now)} ELSE {'now': a.now || b.now, 'out': a.out} END) AS x FROM p) """ + _CHUNKED.format(all="list_append(x.out, x.now)"))
def chunk_lines(spark, d):
    return chunk.chunks(table(spark, d, "documents"), chunk.by_lines)


@query(rf"""WITH p AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.!?]){_SPACE}', '\1' || chr(1), 'g'), chr(1)), lambda s: {{'now': s || ' ', 'out': []::VARCHAR[]}}) AS l FROM documents WHERE text <> ''),
r AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN length(a.now) + length(b.now) - 1 > 1000 THEN {{'now': (CASE WHEN len(list_filter(regexp_split_to_array(a.now, '{_SPACE}'), lambda w: w <> '')) > 100 THEN array_to_string(list_filter(regexp_split_to_array(a.now, '{_SPACE}'), lambda w: w <> '')[-100:], ' ') ELSE a.now END) || ' ' || b.now, 'out': list_append(a.out, a.now)}} ELSE {{'now': a.now || b.now, 'out': a.out}} END) AS x FROM p),
t AS (SELECT doc_id, list_transform(list_append(x.out, x.now), lambda c: regexp_replace(c, '^{_SPACE}|{_SPACE}$', '', 'g')) AS c FROM r) """ + _CHUNKED.format(all="c").replace("FROM r", "FROM t"))
def chunk_sentences(spark, d):
    return chunk.chunks(table(spark, d, "documents"), chunk.by_sentences)


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
e(doc_id, pos, stop, k) AS (SELECT doc_id, 0::BIGINT, NULL::BIGINT, 0 FROM t UNION ALL
  SELECT t.doc_id, CASE WHEN c.stop >= n THEN NULL ELSE greatest(e.pos + 1, c.stop - 200) END, c.stop, k + 1 FROM e JOIN t USING (doc_id), LATERAL (SELECT CASE WHEN e.pos + 3000 >= n THEN n WHEN contains(substr(text, e.pos + 2701, 300), chr(10)) AND e.pos + 3000 - instr(reverse(substr(text, e.pos + 2701, 300)), chr(10)) > e.pos THEN e.pos + 3001 - instr(reverse(substr(text, e.pos + 2701, 300)), chr(10)) ELSE e.pos + 3000 END AS stop) c WHERE e.pos IS NOT NULL),
c AS (SELECT a.doc_id, a.k, substr(text, a.pos + 1, b.stop - a.pos) AS part FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN t ON t.doc_id = a.doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk, part FROM c WHERE regexp_matches(part, '[^\\s\\x0b\\x1c-\\x1f]')""")
def chunk_reference(spark, d):
    return chunk.chunks(table(spark, d, "documents"), chunk.by_reference)


@query("""WITH p AS (SELECT doc_id, list_transform(string_split(regexp_replace(replace(text, '. ', '.' || chr(10) || 'EndModule; task t;' || chr(10) || 'module '), '(?i)(module|endmodule|function|endfunction|task|endtask)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: {'now': s, 'out': []::VARCHAR[]}) AS l FROM documents WHERE text <> ''),
r AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN length(a.now) + length(b.now) > 2000 THEN {'now': CASE WHEN a.now = '' THEN '' ELSE a.now[-200:] END || b.now, 'out': CASE WHEN a.now = '' THEN a.out ELSE list_append(a.out, a.now) END} ELSE {'now': a.now || b.now, 'out': a.out} END) AS x FROM p) """ + _CHUNKED.format(all="(CASE WHEN x.now = '' THEN x.out ELSE list_append(x.out, x.now) END)"))
def chunk_rtl(spark, d):
    text = F.replace("text", F.lit(". "), F.lit(".\nEndModule; task t;\nmodule "))
    return chunk.chunks(table(spark, d, "documents").select("doc_id", text.alias("text")), chunk.by_rtl)


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, '. ', '.' || chr(10) || '  ## Part of '), chr(10)), lambda s: {'now': s || chr(10), 'head': CASE WHEN starts_with(trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '#') THEN s ELSE '' END, 'out': []::VARCHAR[]}) AS l FROM documents WHERE text <> ''),
r AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN b.head <> '' AND length(a.now) > 1500 THEN {'now': a.head || chr(10) || b.now, 'head': b.head, 'out': list_append(a.out, a.now)} ELSE {'now': a.now || b.now, 'head': CASE WHEN b.head <> '' THEN b.head ELSE a.head END, 'out': a.out} END) AS x FROM l) """ + _CHUNKED.format(all="list_append(x.out, x.now)"))
def chunk_spec(spark, d):
    text = F.replace("text", F.lit(". "), F.lit(".\n  ## Part of "))
    return chunk.chunks(table(spark, d, "documents").select("doc_id", text.alias("text")), chunk.by_spec)


@query("""SELECT 'total' AS kind, '' AS value, count(*) AS n FROM supplier WHERE s_suppkey % 4 < 3
UNION ALL SELECT 'type', ['SRAM', 'ROM', 'RF'][s_suppkey % 4 + 1], count(*) FROM supplier WHERE s_suppkey % 4 < 3 GROUP BY 2 UNION ALL SELECT 'subsystem', 'Other', count(*) FROM supplier WHERE s_suppkey % 4 < 3""")
def sram_summary(spark, d):
    return rtl.sram_summary(rtl.sram_inventory(rtl.parsed(rendered(spark, d))))


_PORTS = ["i_ai_clk", "i_ai_reset_n", "o_edc_apb_sel", "npu_in_data", "NPU_OUT_data", "i_reg_psel", "ISO_EN", "SFR_ctl", "io_a", "io_b", "i_tensix_reset"]


@query("""WITH c AS (SELECT n_nationkey AS k, unnest(['AI_Clock_Reset', 'EDC_APB', 'AXI_Interface', 'APB_Register', 'PRTN_Power', 'SFR_Memory_Config', 'Tensix_Reset', 'PortSummary']) AS category,
unnest(['2 AI_Clock_Reset ports: i_ai_clk, i_ai_reset_n', '1 EDC_APB ports: o_edc_apb_sel', '2 AXI_Interface ports: npu_in_data, NPU_OUT_data', '1 APB_Register ports: i_reg_psel', '1 PRTN_Power ports: ISO_EN', '1 SFR_Memory_Config ports: SFR_ctl', '1 Tensix_Reset ports: i_tensix_reset',
'11 total ports: AI_Clock_Reset(2), EDC_APB(1), AXI_Interface(2), APB_Register(1), PRTN_Power(1), SFR_Memory_Config(1), Tensix_Reset(1), Other(2)']) AS t FROM nation),
f AS (SELECT 'top_' || k AS module, category, 'Module ' || chr(39) || 'top_' || k || chr(39) || ' has ' || t AS claim_text FROM c)
SELECT *, substr(sha256('p1:' || module || '.v:port:' || category || ':' || substr(claim_text, 1, 80)), 1, 16) AS claim_id FROM f""")
def port_claims(spark, d):
    name = F.format_string("top_%d", F.col("n_nationkey"))
    body = ",\n".join(f"  input {p}" for p in _PORTS)
    files = table(spark, d, "nation").select(F.concat(name, F.lit(".v")).alias("path"), F.concat(F.lit("module "), name, F.lit(f" (\n{body}\n);\nendmodule\n")).alias("content"))
    small = files.select(F.concat(F.lit("few_"), "path").alias("path"), F.lit("module few (input i_ai_clk);\nendmodule\n").alias("content"))
    return rtl.port_claims(rtl.parsed(files.unionByName(small)), "p1").select("module", "category", "claim_text", "claim_id")


def _records(spark, d) -> DataFrame:
    """A module record a nation, with two ports and an instance a supplier; a binding and a clock claim a customer."""
    n, s, c = (table(spark, d, x) for x in ("nation", "supplier", "customer"))
    mod, none = (lambda k: F.concat(F.lit("m_"), F.col(k).cast("string"))), (lambda kind: F.lit(None).cast(kind))
    inst = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("u_"), F.col("s_suppkey").cast("string")).alias("instance_name"), F.lit("sub").alias("module_type"), none("string").alias("generate_scope"), none("string").alias("hier_path"))).alias("instance_list"))
    port = lambda name, way: F.struct(F.lit(name).alias("name"), F.lit(way).alias("direction"), F.lit("").alias("bit_width"))
    modules = n.join(inst, n.n_nationkey == inst.s_nationkey, "left").select(F.lit("module_parse").alias("analysis_type"), F.lit("p").alias("pipeline_id"), mod("n_nationkey").alias("module_name"), F.array(port("i_flit", "input"), port("o_flit", "output")).alias("port_list"), "instance_list")
    way = F.element_at(F.array(*[F.lit(x) for x in ("input", "output", "inout", "")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    base = [F.lit("claim").alias("analysis_type"), F.lit("p").alias("pipeline_id"), mod("c_nationkey").alias("module_name")]
    signal = F.when(F.col("c_custkey") % 10 > 0, F.concat(F.lit("s_"), (F.col("c_custkey") % 50).cast("string")))
    binds = c.select(*base, F.lit("PortBinding").alias("topic"), F.concat(F.lit("p_"), (F.col("c_custkey") % 7).cast("string")).alias("port_name"), signal.alias("signal_name"), way.alias("direction"))
    clocks = c.where("c_custkey % 3 = 0").select(*base, F.lit("ClockDomain").alias("topic"), signal.alias("signal_name"), F.concat(F.lit("k_"), (F.col("c_custkey") % 2).cast("string")).alias("clock_domain"))
    out = modules
    for df in (binds, clocks, spark.createDataFrame([], records.RECORD)):
        out = out.unionByName(df, allowMissingColumns=True)
    return out


_RECORDS = """WITH m AS (SELECT 'm_' || n_nationkey AS m FROM nation), p AS (SELECT m, unnest(['i_flit', 'o_flit']) AS p FROM m), i AS (SELECT 'm_' || s_nationkey AS m, 'u_' || s_suppkey AS u FROM supplier),
b AS (SELECT 'm_' || c_nationkey AS m, 'p_' || c_custkey % 7 AS p, 's_' || c_custkey % 50 AS s, ['input', 'output', 'inout', ''][c_custkey % 4 + 1] AS way FROM customer WHERE c_custkey % 10 > 0),
k AS (SELECT 'm_' || c_nationkey AS m, 's_' || c_custkey % 50 AS s, 'k_' || c_custkey % 2 AS k FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 3 = 0)"""


@query(_RECORDS + """ SELECT label, key FROM (SELECT 'ModuleDef' AS label, m AS key FROM m UNION SELECT 'PortDef', m || '/' || p FROM p UNION SELECT 'PortInstance', m || '/' || p FROM p UNION SELECT 'Instance', m || '/' || u FROM i
UNION SELECT 'PortInstance', m || '/' || p FROM b UNION SELECT 'Signal', m || '/' || s FROM b UNION SELECT 'Signal', m || '/' || s FROM k UNION SELECT 'ClockDomain', k FROM k)""")
def graph_nodes(spark, d):
    return records.nodes(_records(spark, d)).select("label", "key")


@query(_RECORDS + """ SELECT type, src, dst, count(*) AS n FROM (SELECT 'DEFINES' AS type, m AS src, m || '/' || p AS dst FROM p UNION ALL SELECT 'HAS_PORT', m, m || '/' || p FROM p UNION ALL SELECT 'INSTANCE_OF', m || '/' || u, 'sub' FROM i
UNION ALL SELECT 'BINDS_TO', m || '/' || p, m || '/' || s FROM b UNION ALL SELECT 'DRIVES', m || '/' || p, m || '/' || s FROM b WHERE way IN ('output', 'inout') UNION ALL SELECT 'READS', m || '/' || s, m || '/' || p FROM b WHERE way IN ('input', 'inout')
UNION ALL SELECT 'BELONGS_TO', m || '/' || s, k FROM k) GROUP BY ALL""")
def graph_edges(spark, d):
    return records.edges(_records(spark, d)).groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(_RECORDS + """ SELECT t AS type, CASE t WHEN 'DEFINES' THEN (SELECT count(*) FROM p) WHEN 'BINDS_TO' THEN (SELECT count(*) FROM b) ELSE 0 END AS n, t = 'NO_SUCH' AS missing FROM unnest(['DEFINES', 'BINDS_TO', 'NO_SUCH']) x(t)""")
def graph_export_check(spark, d):
    return records.export_check(records.edges(_records(spark, d)), ["DEFINES", "BINDS_TO", "NO_SUCH"])


def _versions(spark, d) -> DataFrame:
    """Orders as versions of claims by customer."""
    status = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "verified").otherwise("conflicted")
    v = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    evidence = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("claim_id"), v.alias("version"), F.concat(F.lit("t/"), F.col("o_orderpriority")).alias("topic"), status.alias("status"), F.lit("pending_review").alias("approval_status"), F.col("o_orderkey").cast("string").alias("statement"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), evidence.alias("evidence"), F.col("o_orderdate").alias("updated_at"))


_VERSIONS = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders)"


@query(_VERSIONS + " SELECT o_custkey AS claim_id, v AS version, 't/' || o_orderpriority AS topic, o_orderkey::VARCHAR AS statement, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, least(o_orderkey % 4, 3)::INT AS evidence_count FROM o WHERE back = 1 AND o_orderstatus = 'F'")
def verified_claims(spark, d):
    return claims.verified_of(_versions(spark, d))


@query(_VERSIONS + " SELECT o_custkey AS claim_id, v + 1 AS version, CASE WHEN o_custkey % 2 = 0 THEN 'verified' ELSE 'draft' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS approval_status FROM o WHERE back = 1 AND o_orderstatus = 'F'")
def claim_review(spark, d):
    v = _versions(spark, d)
    decided = table(spark, d, "customer").select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 2 == 0, "approved").otherwise("rejected").alias("decision"))
    return claims.reviewed(v, decided, F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'")).select("claim_id", "version", "status", "approval_status")


@query("SELECT DISTINCT 't/' || o_orderpriority AS topic FROM orders")
def claim_topics(spark, d):
    return claims.topics(_versions(spark, d))


@query("SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders")
def supersession(spark, d):
    return claims.superseded(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate").select("o_orderkey", "superseded_by")


@query("""WITH m AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'tt_fds_' || p_partkey || '_reg_top' WHEN p_partkey % 3 = 1 THEN 'x_reg_inner_' || p_partkey ELSE 'core_' || p_partkey END AS name FROM part),
f AS (SELECT *, p_partkey % 3 = 1 AS reg, count(*) FILTER (p_partkey % 3 <> 1) OVER (PARTITION BY p_brand) AS n FROM m) SELECT p_partkey, name FROM f WHERE NOT reg OR n < 60""")
def claim_targets(spark, d):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("tt_fds_"), k, F.lit("_reg_top"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x_reg_inner_"), k)).otherwise(F.concat(F.lit("core_"), k))
    return claims.claim_targets(table(spark, d, "part").select("p_partkey", "p_brand", name.alias("name")), "p_brand", "name", 60).select("p_partkey", "name")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN page_id % 2 = 1 AND (page_id % 300) >= 200 WHEN 2 THEN false ELSE true END AS vision FROM pages""")
def diagram_pages(spark, d):
    """A sparse page, short labels, prose and a blank page, beside page_id % 300 drawings."""
    page = F.element_at(F.array(F.lit("few signs"), F.lit("\n".join(["label " + str(i) for i in range(40)])), F.lit("\n".join(["a line of prose that is long enough"] * 9)), F.lit(" \n \n")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", T.needs_vision(page, F.col("page_id") % 300).alias("vision"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS success, count(*) FILTER (o_orderstatus = 'P') AS errors, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 200 ELSE 207 END AS status FROM orders")
def batch_outcome(spark, d):
    return metrics.batch_outcome(table(spark, d, "orders"), F.col("o_orderstatus") != "P")


@query("SELECT l_returnflag, (floor(sum(l_quantity::DECIMAL(20,4) * l_tax::DECIMAL(12,6)) * 100) / 100)::DECIMAL(20,2) AS cost FROM lineitem GROUP BY 1")
def service_cost(spark, d):
    return metrics.cost(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_tax")


@query("""SELECT n_nationkey, CASE WHEN n_name IS NULL THEN 'chip' WHEN c > 3 THEN 'subsystem' ELSE 'block' END AS kind FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def section_type(spark, d):
    c = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    n = table(spark, d, "nation")
    return n.join(c, n.n_nationkey == c.s_nationkey, "left").select("n_nationkey", T.section_type(F.col("n_name"), F.coalesce("c", F.lit(0))).alias("kind"))


@query("SELECT 'm_' || n_nationkey AS module, 'module m_' || n_nationkey || chr(10) || 'parameters: WIDTH, TWICE' || chr(10) || 'ports: input i_ai_clk, output o_scan_clk, input rst_n' AS summary, 'i_ai_clk,o_scan_clk' AS clocks, 'rst_n' AS resets, 'u_sram,u_fifo' AS memories, 1 AS clock_in, 1 AS clock_out FROM nation")
def module_summary(spark, d):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    m = table(spark, d, "nation").select(F.format_string("m_%d", F.col("n_nationkey")).alias("module"), arr("WIDTH", "TWICE").alias("params"), arr("input i_ai_clk", "output o_scan_clk", "input rst_n").alias("ports"), arr("u_sram: x", "u_core: y", "u_fifo: z").alias("inst"))
    join = lambda c: F.array_join(c, ",")
    return m.select("module", T.summary_of(F.col("module"), F.col("params"), F.col("ports"), F.array().cast("array<string>")).alias("summary"), join(T.signals(F.col("ports"), "clock")).alias("clocks"), join(T.signals(F.col("ports"), "reset")).alias("resets"), join(T.memories(F.col("inst"))).alias("memories"), *[c.alias(n) for n, c in T.clock_ports(F.col("ports")).items()])


@query("""WITH f AS (SELECT 'o' || l_orderkey || ['_flit_t', '_header_t', '_payload_t', '_t'][l_orderkey % 4 + 1] AS struct, l_linenumber AS o, 'f' || l_linenumber AS name, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 8 END AS w, l_partkey % 5 * 8 + 7 AS msb, l_partkey % 5 * 8 AS lsb, l_linenumber % 2 = 0 AS ref, l_orderkey FROM lineitem),
t AS (SELECT *, CASE WHEN w > 0 THEN name || '[' || msb || ':' || lsb || ']' WHEN ref THEN name || '(x_t)' ELSE name || '(unknown width)' END AS t FROM f WHERE l_orderkey % 4 < 3)
SELECT struct, 'Flit structure ''' || struct || ''' layout: ' || string_agg(t, ', ' ORDER BY w = 0, CASE WHEN w > 0 THEN -msb END, o, t) AS layout FROM t GROUP BY struct""")
def flit_layout(spark, d):
    """A struct an order, a field a line of it; a quarter of the structs are no flits."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("_flit_t", "_header_t", "_payload_t", "_t")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    odd = F.col("l_linenumber") % 3 == 0
    f = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), ends).alias("struct"), F.col("l_linenumber").alias("ordinal"), F.format_string("f%d", "l_linenumber").alias("name"), F.when(odd, 0).otherwise(8).alias("bit_width"), (F.col("l_partkey") % 5 * 8 + 7).alias("msb"), (F.col("l_partkey") % 5 * 8).alias("lsb"), F.when(F.col("l_linenumber") % 2 == 0, "x_t").alias("ref_type"))
    return analyses.flit_layouts(f)


@query("""SELECT 'r_' || n_regionkey AS struct, 'f_' || n_nationkey AS name, 'n_' || n_nationkey AS ref_type, false AS truncated FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'n_' || s_nationkey, 'f_' || s_suppkey, 's_' || s_suppkey, false FROM supplier UNION ALL SELECT 's_' || s_suppkey, 'tail', 'leaf', true FROM supplier UNION ALL SELECT 'leaf', 'last', 'end', false""")
def struct_nesting(spark, d):
    """Regions hold nations, nations suppliers, every supplier one struct that holds another, all as structs."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    of = lambda p, c: F.concat(F.lit(p + "_"), F.col(c).cast("string"))
    f = n.select(of("r", "n_regionkey").alias("struct"), of("f", "n_nationkey").alias("name"), of("n", "n_nationkey").alias("ref_type"))
    f = f.unionByName(s.select(of("n", "s_nationkey").alias("struct"), of("f", "s_suppkey").alias("name"), of("s", "s_suppkey").alias("ref_type")))
    f = f.unionByName(s.select(of("s", "s_suppkey").alias("struct"), F.lit("tail").alias("name"), F.lit("leaf").alias("ref_type")))
    return analyses.nested_structs(f.unionByName(spark.createDataFrame([("leaf", "last", "end"), ("end", "bit", "logic")], "struct string, name string, ref_type string")))


#: Parameters with what each must give: kept as a setting of the chip, its axis, of the processors, of the cache.
_PARAMS = [("SizeX", "4", True, "x"), ("SizeY", "0x10", True, "y"), ("MODE", "1", False, None), ("NUM_CORES", "0X1f", True, None), ("ECC_TYPE", '"secded"', False, None), ("BANK_WIDTH", "010", True, None), ("ISA_EXTENSIONS", "'rv64'", False, None)]


def _params(spark, d) -> DataFrame:
    known = spark.createDataFrame([(i, n, v) for i, (n, v, *_) in enumerate(_PARAMS)], "id int, name string, value string")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("module"), (F.col("p_partkey") % len(_PARAMS)).cast("int").alias("id"))
    return p.join(F.broadcast(known), "id").select("module", "name", "value")


@query("SELECT p_partkey AS module, name, value, axis FROM part, (VALUES " + ", ".join(f"({i}, '{n}', '{v.replace(chr(39), chr(39) * 2)}', {'NULL' if a is None else repr(a)})" for i, (n, v, k, a) in enumerate(_PARAMS) if k) + f") v(id, name, value, axis) WHERE p_partkey % {len(_PARAMS)} = id")
def chip_config(spark, d):
    return analyses.chip_config(_params(spark, d))


@query(f"SELECT p_partkey AS module, k AS kind, number, t AS text FROM part, (VALUES (3, 'cpu', 31, NULL), (6, 'cpu', NULL, 'rv64'), (4, 'l1', NULL, 'secded'), (5, 'l1', NULL, '010')) v(id, k, number, t) WHERE p_partkey % {len(_PARAMS)} = id")
def overlay_settings(spark, d):
    p = _params(spark, d)
    both = [analyses.settings(p, words).withColumn("kind", F.lit(kind)) for kind, words in (("cpu", analyses.CPU_WORDS), ("l1", analyses.L1_WORDS))]
    return both[0].unionByName(both[1]).select("module", "kind", F.col("number").cast("int").alias("number"), "text")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'idma' WHEN 1 THEN 'fds' WHEN 2 THEN 'noc_interface' ELSE NULL END AS role FROM part""")
def module_roles(spark, d):
    """A whole name, two that go on, one that only holds a known name, one unknown."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("tt_idma_wrapper", "tt_fds_wrapper_", "tt_overlay_noc_wrapper", "my_tt_rocc_accel", "tt_overlay")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 5 == 1, F.concat(name, F.col("p_partkey").cast("string"))).otherwise(name)
    return table(spark, d, "part").select("p_partkey", analyses.role_of(name).alias("role"))


@query("""SELECT event_type, round(count(*) FILTER (value < 20) / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (value < 20) / count(*)::DOUBLE > 0.30 AS warn, false AS mismatch FROM events GROUP BY 1
UNION ALL SELECT 'none', 1.0, true, true""")
def skip_ratios(spark, d):
    """Events under a value are skipped; the kind ``none`` has one event and no node."""
    e = table(spark, d, "events").select("event_type", "value", F.lit(1).alias("nodes")).unionByName(spark.createDataFrame([("none", 0.0, 0)], "event_type string, value double, nodes int"))
    return analyses.skip_ratio(e, "event_type", F.col("value") < 20, F.col("nodes"))


_LINES = """l AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS raw FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM t)),
p AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"""


@query(f"""WITH t AS (SELECT doc_id, '## Part ' || doc_id || '  ' || chr(10) || replace(text, '. ', '.' || chr(10)) || chr(10) || '####### no' || chr(10) || '#no' || chr(10) || '# last' || chr(13) AS t FROM documents), {_LINES}
SELECT doc_id, start, regexp_extract(rtrim(raw, chr(13)), '(?s)^#{{1,6}}[ \\t]+(\\S.*?)[ \\t]*\\z', 1) AS title FROM p WHERE regexp_matches(rtrim(raw, chr(13)), '(?s)^#{{1,6}}[ \\t]+\\S')""")
def markdown_sections(spark, d):
    text = F.concat(F.lit("## Part "), F.col("doc_id").cast("string"), F.lit("  \n"), F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\n####### no\n#no\n# last\r"))
    return analyses.sections(table(spark, d, "documents").select("doc_id", text.alias("text")), "markdown")


@query(f"""WITH t AS (SELECT doc_id, '4.2 Part ' || doc_id || chr(10) || chr(12) || 'Appendix A ' || chr(10) || replace(text, '. ', '.' || chr(10)) || chr(10) || '4.2.' || chr(10) || 'sections x' || chr(10) || ' 7  last ' AS t FROM documents), {_LINES}, c AS (SELECT doc_id, start, trim(raw, chr(12)) AS line FROM p)
SELECT doc_id, start, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS title FROM c WHERE regexp_matches(line, '(?s)^[ \\t]*[0-9]+(\\.[0-9]+)*[ \\t]+\\S') OR regexp_matches(line, '(?is)^[ \\t]*(chapter|section|appendix)\\b')""")
def pdf_sections(spark, d):
    text = F.concat(F.lit("4.2 Part "), F.col("doc_id").cast("string"), F.lit("\n\fAppendix A \n"), F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\n4.2.\nsections x\n 7  last "))
    return analyses.sections(table(spark, d, "documents").select("doc_id", text.alias("text")), "pdf")


@query("""WITH e AS (SELECT upper(p_type) || '_' || p_partkey AS source, 'HAS_BRAND' AS relationship, p_brand AS target FROM part), t AS (SELECT DISTINCT lower(p_type) AS t FROM part ORDER BY 1 LIMIT 2)
SELECT 'part/' || t AS topic, source, relationship, target FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY source, relationship, target) AS n FROM e JOIN t ON contains(source, upper(t))) WHERE n <= 20""")
def topic_neighbourhood(spark, d):
    """Two topics, after the first two types of parts."""
    p = table(spark, d, "part")
    topics = [f"part/{r[0]}" for r in p.select(F.lower("p_type").alias("t")).distinct().orderBy("t").limit(2).collect()]
    e = p.select(F.concat(F.upper("p_type"), F.lit("_"), F.col("p_partkey").cast("string")).alias("source"), F.lit("HAS_BRAND").alias("relationship"), F.col("p_brand").alias("target"))
    return analyses.topic_neighbourhood(e, topics).select("topic", "source", "relationship", "target")


@query("""SELECT 3 AS hops, 's_' || s_suppkey || ' -BINDS_TO-> n_' || n_nationkey || ' -READS-> r_' || n_regionkey || ' -DRIVES-> out_' || n_regionkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey ORDER BY path LIMIT 10""")
def connectivity_path(spark, d):
    """From suppliers over nations and regions to their ends."""
    n = table(spark, d, "nation")
    of = lambda p, c: F.concat(F.lit(p + "_"), F.col(c).cast("string"))
    e = table(spark, d, "supplier").select(of("s", "s_suppkey").alias("src"), F.lit("BINDS_TO").alias("type"), of("n", "s_nationkey").alias("dst"))
    e = e.unionByName(n.select(of("n", "n_nationkey").alias("src"), F.lit("READS").alias("type"), of("r", "n_regionkey").alias("dst")))
    e = e.unionByName(n.select(of("r", "n_regionkey").alias("src"), F.lit("DRIVES").alias("type"), of("out", "n_regionkey").alias("dst")))
    return analyses.connectivity(e, "s_", "out_")


@query("""WITH e AS (SELECT c_nationkey AS m, c_name AS s, c_mktsegment AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_mktsegment, c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer),
b AS (SELECT m, any_value(c) AS c, string_agg('  - ' || s || ' -> ' || g || ' (input)', chr(10) ORDER BY n) AS t FROM e WHERE n <= 10 GROUP BY m),
k AS (SELECT s_nationkey AS m, s_name AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n, least(10, count(*) OVER (PARTITION BY s_nationkey)) AS c FROM supplier),
h AS (SELECT m, '- Hierarchy (' || any_value(c) || ' paths):' || chr(10) || string_agg('  - top / ' || p, chr(10) ORDER BY n) AS t FROM k WHERE n <= 5 GROUP BY m)
SELECT coalesce(b.m, h.m) AS module, '[GRAPH EVIDENCE — noc Section]' || coalesce(chr(10) || '- Summary: ' || c || ' bindings' || chr(10) || b.t, '') || coalesce(chr(10) || h.t, '') AS evidence FROM b FULL JOIN h ON b.m = h.m""")
def graph_evidence(spark, d):
    e = table(spark, d, "customer").select(F.col("c_nationkey").alias("module"), F.col("c_name").alias("src"), F.col("c_mktsegment").alias("dst"), F.lit("input").alias("direction"))
    k = table(spark, d, "supplier").select(F.col("s_nationkey").alias("module"), F.concat(F.lit("top / "), F.col("s_name")).alias("path"))
    return analyses.evidence_text(e, k, "noc")


@query("""SELECT n_regionkey AS root, string_agg('s_' || s_suppkey || '.v', ',' ORDER BY n_name, s_name) AS files FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def hierarchy_sources(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    leaves = j.select(F.col("n_regionkey").alias("root"), F.array("n_name", "s_name").alias("path"), F.format_string("s_%d.v", "s_suppkey").alias("file"))
    inner = table(spark, d, "nation").select(F.col("n_regionkey").alias("root"), F.array("n_name").alias("path"), F.lit("").alias("file"))
    return analyses.source_files(leaves.unionByName(inner)).select("root", F.array_join("files", ",").alias("files"))


@query("""SELECT s_suppkey, unnest([2, 4, 5, 6, 7]) AS line, unnest(['x=0..' || s_suppkey || ':g_x@2'] || list_transform([1, 2, 3], lambda i: 'x=0..' || s_suppkey || ':g_x@2 y=1..5:@4') || ['x=0..' || s_suppkey || ':g_x@2']) AS loops FROM supplier
UNION ALL SELECT s_suppkey, unnest([9, 10]), unnest(['z=0..2:@9', 'z=0..2:@9']) FROM supplier WHERE s_suppkey % 2 = 0""")
def generate_contexts(spark, d):
    """Two nested loops with a blank line, then in every other file a loop that nothing closes."""
    tail = F.when(F.col("s_suppkey") % 2 == 0, F.lit("end\nfor (z = 0; z < 2; z++) begin\n q[z] = 1;")).otherwise("endmodule")
    head = F.format_string("module m;\nfor (genvar x = 0; x < %d; x++) begin : g_x\n \n  for (int y = 1; y < 5; y += 2) begin\n    assign a[x][y] = b;\n  end\nend\n", "s_suppkey")
    f = table(spark, d, "supplier").select("s_suppkey", F.concat(head, tail).alias("content"))
    shown = F.transform("loops", lambda x: F.concat(x["variable"], F.lit("="), x["lower_bound"], F.lit(".."), x["upper_bound"], F.lit(":"), x["label"], F.lit("@"), x["start_line"].cast("string")))
    return generate.active_loops(f, "s_suppkey").select("s_suppkey", "line", F.array_join(shown, " ").alias("loops"))


#: Bodies of blocks with loop variables y and x (x missing where marked so), and what each must give.
_BODIES = [("assign de[y] = (y == 0) ? src : de[y-1];", 1, "feedthrough", "de"), ("assign nxt[N-1] = a; assign b = nxt[0];", 1, "ring", "nxt"), ("assign c[x][y+1] = c[x][y];", 1, "daisy-chain", "c"), (".o(bus[x][y + 1]), .i(bus[x][y])", 1, "daisy-chain", "bus"), ("assign f[x][y] = 1;", 1, "2D array", "f"), ("assign f[x][y] = 1;", 0, "unknown", "unknown_signal"), ("u (.d(g[ y ][ x ].v))", 1, "2D array", "g"), ("assign h[y] = 1;", 0, "unknown", "h"), ("", 0, "unknown", "unknown_signal")]


@query("SELECT p_partkey, pattern, signal FROM part, (VALUES " + ", ".join(f"({i}, '{p}', '{s}')" for i, (_, _, p, s) in enumerate(_BODIES)) + f") v(id, pattern, signal) WHERE p_partkey % {len(_BODIES)} = id")
def generate_topology(spark, d):
    known = spark.createDataFrame([(i, b, "x" if two else None) for i, (b, two, *_) in enumerate(_BODIES)], "id int, body string, second string")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(_BODIES)).cast("int").alias("id")).join(F.broadcast(known), "id")
    return p.select("p_partkey", *[c.alias(n) for n, c in generate.topology(F.col("body"), F.lit("y"), F.col("second")).items()])


@query("""SELECT 'm_' || s_nationkey AS module, CASE s_suppkey % 3 WHEN 0 THEN 'tt_edc1_serial_bus_mux' ELSE 'TT_EDC1_serial_bus_demux' END AS bypass_module, CASE s_suppkey % 3 WHEN 0 THEN 'mux_bypass' ELSE 'demux_bypass' END AS type, count(*) AS n FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY ALL""")
def harvest_bypass(spark, d):
    of = F.element_at(F.array(F.lit("u_a: tt_edc1_serial_bus_mux"), F.lit("u_b: TT_EDC1_serial_bus_demux_x"), F.lit("alu")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    i = table(spark, d, "supplier").select(F.format_string("m_%d", "s_nationkey").alias("module"), of.alias("of"))
    return generate.harvest_bypasses(i).groupBy("module", "bypass_module", "type").agg(F.count(F.lit(1)).alias("n"))


_OBJECTS = "(SELECT 'documents/' || ['soc', 'ai'][p_partkey % 2 + 1] || '/' || CASE p_partkey % 3 WHEN 0 THEN 'spec/' WHEN 1 THEN 'code/a/' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_partkey || '.md' END AS key FROM part)"


@query(f"""WITH k AS (SELECT key FROM {_OBJECTS} WHERE starts_with(key, 'documents/soc/') ORDER BY key LIMIT 100), p AS (SELECT key, string_split(substr(key, 11), '/') AS s FROM k WHERE NOT ends_with(key, '/'))
SELECT key, CASE len(s) WHEN 1 THEN s[1] WHEN 2 THEN s[2] ELSE array_to_string(s[3:], '/') END AS filename, CASE WHEN len(s) >= 3 THEN s[1] ELSE '' END AS team, CASE WHEN len(s) >= 3 THEN s[2] ELSE '' END AS category FROM p""")
def archive_listing(spark, d):
    k = F.col("p_partkey")
    team = F.when(k % 2 == 0, "soc/").otherwise("ai/")
    kind = F.when(k % 3 == 0, "spec/").when(k % 3 == 1, "code/a/").otherwise("")
    name = F.when(k % 7 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(".md")))
    return archive.listing(table(spark, d, "part").select(F.concat(F.lit("documents/"), team, kind, name).alias("key")), "soc")


@query("""SELECT 'd/' || doc_id AS uri, round(n_chars / 7.0::DOUBLE, 6) AS score FROM documents WHERE lang = 'en' ORDER BY score DESC, uri LIMIT 20""")
def archive_search(spark, d):
    h = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("uri"), F.col("lang").alias("topic"), F.lit(T.SOURCES[0]).alias("source"), F.round(F.col("n_chars") / 7, 6).alias("score"))
    return archive.search(h, "en", T.SOURCES[0]).select("uri", "score")


@query("""SELECT CASE page_id % 3 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 'old' ELSE 'unknown' END AS index_version, CASE WHEN page_id % 2 = 0 THEN url END AS last_updated_at, 'unknown' AS embedding_model, count(*) AS n FROM pages GROUP BY ALL""")
def index_status(spark, d):
    k = F.col("page_id")
    r = table(spark, d, "pages").select(F.when(k % 3 == 0, F.concat(F.lit("v"), k.cast("string"))).otherwise("").alias("index_version"), F.when(k % 3 == 1, "old").alias("version"), F.when(k % 2 == 0, F.col("url")).alias("updated_at"), F.lit("").alias("model"))
    return archive.index_status(r).groupBy("index_version", "last_updated_at", "embedding_model").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, coalesce(string_agg('l' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_quantity < 25), '') AS uris, count(*) FILTER (l_quantity < 25) AS citation_count, count(*) FILTER (l_quantity < 25) = 0 AS no_citation, any_value(o_totalprice) > 30000 AS slow
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def cited_answers(spark, d):
    """A reply an order, a citation a line of it, whose reference is there for small quantities."""
    ref = F.when(F.col("l_quantity") < 25, F.array(F.struct(F.format_string("l%d", "l_linenumber").alias("uri"))))
    c = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.lit("t").alias("text"), ref.alias("references")).alias("c")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("citations"))
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("response_time_ms")).join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return archive.answers(r, "o_orderkey").withColumn("uris", F.coalesce(F.array_join("uris", ","), F.lit("")))


@query("SELECT count(*) AS total_files, count(*) FILTER (o_orderstatus = 'F') AS success_count, count(*) FILTER (o_orderstatus = 'O') AS skipped_count, count(*) FILTER (o_orderstatus = 'P') AS error_count FROM orders")
def extraction_outcome(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "skipped").when(F.col("o_orderstatus") == "P", "error")
    return archive.extraction_outcome(table(spark, d, "orders").select(s.alias("status")))


#: C6 in SQL over (doc_id, text): lines, parity of the fences before each, headers, blocks up to the next header.
_BLOCKS = r"""l AS (SELECT doc_id, length(text) AS total, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM t WHERE length(text) > 0),
c AS (SELECT *, regexp_replace(regexp_replace(raw, '\r+$', ''), '^\f+|\f+$', '', 'g') AS line FROM l),
k AS (SELECT *, regexp_matches(line, '^[ \t]*(?:`{3,}|~{3,})') AS fence, CASE WHEN regexp_matches(line, '(?i)^[ \t]*(?:command|syntax|usage)\b') THEN 'command' WHEN regexp_matches(line, '(?i)^[ \t]*(?:options|arguments)\b') THEN 'option'
  WHEN regexp_matches(line, '^[ \t]*-{1,2}[A-Za-z]') THEN 'dash' WHEN regexp_matches(line, '(?i)^[ \t]*(?:flow|methodology|procedure|step)\b') THEN 'flow_step' WHEN regexp_matches(line, '(?i)^[ \t]*examples?\b') THEN 'example' END AS word, length(trim(line, chr(9) || ' ' || chr(13) || chr(11) || chr(12))) <= 80 AS short FROM c),
f AS (SELECT *, sum(length(raw) + 1) OVER w - length(raw) - 1 AS start, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
h AS (SELECT *, coalesce(CASE WHEN inside THEN NULL WHEN fence THEN 'example' WHEN word = 'dash' THEN 'option' WHEN short THEN word END, CASE WHEN ln = 1 THEN 'section' END) AS kind FROM f)
SELECT doc_id, start::BIGINT AS block_start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY ln), total)::BIGINT AS block_end, kind AS object_type FROM h WHERE kind IS NOT NULL"""


@query("WITH t AS (SELECT doc_id, text FROM documents), " + _BLOCKS)
def block_scan(spark, d):
    return blocks.block_scan(table(spark, d, "documents"))


#: Words of a document, five a line, under line beginnings that its number and the line's choose.
_MARKS = ["", "Command: ", "  -o", "```", "Step 2 ", "prose of ", "~~~~ sh ", "Examples of ", "options: ", "- "]


@query("WITH t AS (SELECT doc_id, array_to_string(list_transform(range(0, (len(w) + 4) // 5), lambda i: (" + str(_MARKS) + ")[(doc_id + 3 * i) % 10 + 1] || array_to_string(w[5 * i + 1 : 5 * i + 5], ' ') || repeat(' long', CASE WHEN i % 4 = 0 THEN 15 ELSE 0 END)), chr(10)) AS text FROM (SELECT doc_id, string_split(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL)), " + _BLOCKS)
def block_scan_marked(spark, d):
    marks = F.array(*map(F.lit, _MARKS))
    w = F.split(F.translate("text", "\n\r", "  "), " ")

    def line(i):
        long = F.when(i % 4 == 0, F.lit(" long" * 15)).otherwise("")
        return F.concat(F.get(marks, ((F.col("doc_id") + 3 * i) % 10).cast("int")), F.array_join(F.slice("w", 5 * i + 1, 5), " "), long)

    t = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w"))
    return blocks.block_scan(t.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") + 4) / 5).cast("int") - 1), line), "\n").alias("text")))


def _generated(spark, d) -> DataFrame:
    """A file a nation: a loop with an instance of its own, a condition and a loop inside, suppliers in both."""
    k = F.col("s_suppkey")
    inst = F.concat(F.lit("    mac u_"), k.cast("string"), F.lit(" (.clk(c));\n    begin x = 1; end\n"))
    odd = F.transform(F.array_sort(F.collect_list(F.when(k % 2 == 1, F.struct("s_suppkey", inst.alias("i"))))), lambda x: x["i"])
    even = F.transform(F.array_sort(F.collect_list(F.when(k % 2 == 0, F.struct("s_suppkey", inst.alias("i"))))), lambda x: x["i"])
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(odd, "").alias("odd"), F.array_join(even, "").alias("even"))
    text = F.concat(F.lit("module m;\nfor (genvar x = 0; x < 4; x++) begin : gen_x\n  if (EN) begin : gen_if\n"), "even", F.lit("  end\n  row u_top (.a(b));\n  for (genvar y = 0;\n y < 2; y++)  begin : gen_y\n"), "odd", F.lit("  end\n  tail u_last (.a(b));\nend\nif (Z) begin : alone\n  z u_z (.a(b));\nend\nendmodule\n"))
    return g.select(F.col("s_nationkey").alias("path"), text.alias("content"))


@query("""WITH g AS (SELECT s_nationkey AS path, coalesce(string_agg('u_' || s_suppkey, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 1), '') AS odd, coalesce(string_agg('u_' || s_suppkey, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 0), '') AS even FROM supplier GROUP BY 1)
SELECT path, 'gen_x' AS label, NULL AS parent_label, 'gen_x' AS hierarchy_path, 'for' AS block_type, 'u_top,u_last' AS instances FROM g UNION ALL SELECT path, 'gen_if', 'gen_x', 'gen_x/gen_if', 'if', even FROM g
UNION ALL SELECT path, 'gen_y', 'gen_x', 'gen_x/gen_y', 'for', odd FROM g UNION ALL SELECT path, 'alone', NULL, 'alone', 'if', 'u_z' FROM g""")
def generate_labels(spark, d):
    b = generate.labelled_blocks(_generated(spark, d))
    return b.select("path", "label", "parent_label", "hierarchy_path", "block_type", F.array_join("instances", ",").alias("instances"))


#: A block a supplier: its loops and label by the key, an endpoint port at a distance by the key.
_TAGS = ["gen_router[3]", "gen_ne_opt", "noc2axi_a", "south_b", "plain"]


@query("""WITH s AS (SELECT s_suppkey AS k, (s_suppkey * 37) % 700 AS far, ['gen_router', 'gen_ne_opt', 'noc2axi_a', 'south_b', 'plain'][s_suppkey % 5 + 1] AS label, ['x', 'row', ''][s_suppkey % 3 + 1] AS v FROM supplier)
SELECT k AS block, label, 'u_' || k AS instance, 'mac' AS module_type, CASE WHEN v = 'x' THEN '0..W' || k WHEN label = 'gen_ne_opt' THEN '1' ELSE 'UNKNOWN' END AS x,
CASE WHEN v = 'row' AND label = 'gen_router' THEN '3+4' WHEN v = 'row' THEN '0..W' || k WHEN label = 'south_b' THEN '1' ELSE 'UNKNOWN' END AS y,
CASE WHEN length('mac u_' || k || ' (') + far + length('.ep_id(' || k || ')') <= 500 THEN k::VARCHAR ELSE 'UNKNOWN' END AS ep, CASE WHEN label = 'noc2axi_a' THEN 'NOC2AXI' WHEN label = 'gen_router' THEN 'router' ELSE 'tile' END AS tile_type FROM s""")
def instance_positions(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    label = F.get(F.array(*[F.lit(t.split("[")[0]) for t in _TAGS]), (k % 5).cast("int"))
    v = F.get(F.array(F.lit("x"), F.lit("row"), F.lit("")), (k % 3).cast("int"))
    loop = F.when(v == "", F.concat(F.lit("if (EN) begin : "), label)).otherwise(F.concat(F.lit("for (genvar "), v, F.lit(" = 0; "), v, F.lit(" < W"), n, F.lit("; "), v, F.lit("++) begin : "), label))
    text = F.concat(loop, F.lit("\n mac u_"), n, F.lit(" ("), F.repeat(F.lit("."), (k * 37 % 700).cast("int")), F.lit(".ep_id("), n, F.lit("));\n assign a = b[3] + b[ 4 ];\nend\n"))
    return generate.instance_positions(table(spark, d, "supplier").select(k.alias("block"), text.alias("content")))


@query("WITH RECURSIVE d AS MATERIALIZED (" + _PAIRS.format(g="lang", tok=_TOK, least=0.7) + """), t AS (SELECT a AS id FROM d UNION SELECT b FROM d),
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id * 7919 % 1009 DESC, id) AS n FROM t), e AS (SELECT least(x.n, y.n) AS lo, greatest(x.n, y.n) AS hi FROM d JOIN o x ON x.id = a JOIN o y ON y.id = b),
l AS MATERIALIZED (SELECT o.n, coalesce(list(lo ORDER BY lo) FILTER (lo IS NOT NULL), []) AS lo FROM o LEFT JOIN e ON hi = o.n GROUP BY o.n),
k(n, gone, won) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL SELECT l.n, CASE WHEN len(list_filter(lo, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, l.n) ELSE gone END, list_filter(lo, lambda x: NOT list_contains(gone, x))[1] FROM k JOIN l ON l.n = k.n + 1)
SELECT x.id AS doc_id, y.id AS "by" FROM k JOIN o x ON x.n = k.n JOIN o y ON y.n = k.won""")
def retired_duplicates(spark, d):
    """Near duplicates of a language, newest first: what a kept newer one resembles goes."""
    docs = table(spark, d, "documents").withColumn("made", F.col("doc_id") * 7919 % 1009)
    return claims.retired(docs.withColumnRenamed("lang", "g"), "g", "doc_id", "text", 0.7, "made", [-F.col("made")])


_GRAPH = """n AS MATERIALIZED (SELECT 'r' || r_regionkey AS id, 'chip_' || r_regionkey AS name, 'Module' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'block_' || n_nationkey, 'Module' FROM nation
  UNION ALL SELECT 'p' || s_suppkey, 'port_' || s_suppkey, 'Port' FROM supplier UNION ALL SELECT 's' || p_partkey, 'net_' || p_partkey, 'Signal' FROM part),
w AS MATERIALIZED (SELECT DISTINCT 'p' || l_suppkey AS src, 's' || l_partkey AS dst FROM lineitem WHERE l_partkey % 10 = l_suppkey % 10 UNION ALL SELECT 's' || p_partkey, 's' || (p_partkey // 2) FROM part WHERE p_partkey > 0)"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Regions instantiate nations, whose ports are suppliers, which meet parts; parts meet the part of half their number."""
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = [("region", "r", "chip_", "r_regionkey", "Module"), ("nation", "n", "block_", "n_nationkey", "Module"), ("supplier", "p", "port_", "s_suppkey", "Port"), ("part", "s", "net_", "p_partkey", "Signal")]
    n = reduce(DataFrame.unionByName, [table(spark, d, t).select(name(p, k).alias("id"), name(q, k).alias("name"), F.lit(kind).alias("type")) for t, p, q, k, kind in nodes])
    met = table(spark, d, "lineitem").where("l_partkey % 10 = l_suppkey % 10").select("l_suppkey", "l_partkey").distinct()
    half = table(spark, d, "part").where("p_partkey > 0").withColumn("half", F.floor(F.col("p_partkey") / 2))
    edges = [(table(spark, d, "nation"), "r", "n_regionkey", "n", "n_nationkey", "INSTANTIATES"), (table(spark, d, "supplier"), "n", "s_nationkey", "p", "s_suppkey", "HAS_PORT"), (met, "p", "l_suppkey", "s", "l_partkey", "CONNECTS_TO"), (half, "s", "p_partkey", "s", "half", "CONNECTS_TO")]
    return n, reduce(DataFrame.unionByName, [t.select(name(p, a).alias("src"), name(q, b).alias("dst"), F.lit(kind).alias("type")) for t, p, a, q, b, kind in edges])


def _exported(spark, d, scope, root, signal="", depth=3, most=graph.EXPORT_NODES):
    nodes, edges, meta = graph.export(*_graph(spark, d), scope, root, depth, signal, most)
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "id", "left").select("id", "label", "type", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(meta["edge_count"]).cast("long").alias("edges"), F.lit(meta["truncated"]).alias("truncated"))


_DEGREES = "g AS MATERIALIZED (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1)"
_EXPORTED = "SELECT v.id, v.label, v.type, coalesce(g.degree, 0)::BIGINT AS degree, (SELECT count(*) FROM e) AS edges, {truncated} AS truncated FROM v LEFT JOIN g ON g.id = v.id"


@query("WITH " + _GRAPH + """, c AS (SELECT 'block_' || n_nationkey AS child, 'p' || s_suppkey AS p FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2),
e0 AS MATERIALIZED (SELECT DISTINCT 'chip_2' AS a, child AS b FROM c UNION ALL SELECT DISTINCT child, child || '.net_' || substr(w.dst, 2) FROM c JOIN w ON w.src = c.p),
v0 AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e0 UNION ALL SELECT b FROM e0) GROUP BY 1), v1 AS MATERIALIZED (SELECT id FROM v0 ORDER BY degree DESC, id LIMIT 60),
e AS MATERIALIZED (SELECT a, b FROM e0 WHERE a IN (SELECT id FROM v1) AND b IN (SELECT id FROM v1)), """ + _DEGREES + ", v AS (SELECT id, CASE WHEN contains(id, '.') THEN split_part(id, '.', 2) ELSE id END AS label, CASE WHEN contains(id, '.') THEN 'Signal' ELSE 'Module' END AS type FROM v1) " + _EXPORTED.format(truncated="(SELECT count(*) FROM v0) > 60"))
def graph_export_chip(spark, d):
    return _exported(spark, d, "chip", "chip_2", most=60)


@query("WITH " + _GRAPH + """, p AS (SELECT 'p' || s_suppkey AS p FROM supplier WHERE s_nationkey = 3), e AS MATERIALIZED (SELECT 'block_3' AS a, 'block_3.port_' || substr(p, 2) AS b FROM p UNION ALL SELECT DISTINCT 'block_3.port_' || substr(p, 2), 'block_3.net_' || substr(w.dst, 2) FROM p JOIN w ON w.src = p.p), """ + _DEGREES + """,
v AS (SELECT id, CASE WHEN contains(id, '.') THEN split_part(id, '.', 2) ELSE id END AS label, CASE WHEN contains(id, '.net_') THEN 'Signal' WHEN contains(id, '.') THEN 'Port' ELSE 'Module' END AS type FROM g) """ + _EXPORTED.format(truncated="false"))
def graph_export_module(spark, d):
    return _exported(spark, d, "module", "block_3", most=1_000_000)


@query("WITH RECURSIVE " + _GRAPH + """, p AS (SELECT 'p' || s_suppkey AS p FROM supplier WHERE s_nationkey = 3 AND contains('port_' || s_suppkey, '7') AND 'p' || s_suppkey IN (SELECT src FROM w)),
h(id, depth) AS (SELECT p, 0 FROM p UNION SELECT w.dst, depth + 1 FROM h JOIN w ON w.src = h.id WHERE depth < 4),
x AS (SELECT DISTINCT w.src AS a, w.dst AS b FROM w JOIN h ON h.id = w.src AND depth < 4 UNION ALL SELECT 'n3', p FROM p), e AS MATERIALIZED (SELECT na.name AS a, nb.name AS b FROM x JOIN n na ON na.id = a JOIN n nb ON nb.id = b), """ + _DEGREES + """,
v AS (SELECT name AS id, name AS label, type FROM n WHERE id IN (SELECT id FROM h) OR (id = 'n3' AND EXISTS (SELECT 1 FROM p))) """ + _EXPORTED.format(truncated="false"))
def graph_export_signal(spark, d):
    return _exported(spark, d, "signal", "block_3", "7", 4, 1_000_000)


@query("""WITH c AS (SELECT 't' || p_partkey % 3 AS topic, replace(CASE p_partkey % 4 WHEN 0 THEN 'The Module "Unit ' || p_partkey % 60 || ' top" is here' WHEN 1 THEN 'port "p' || p_partkey % 40 || '-in" of it' WHEN 2 THEN 'see "P' || p_partkey % 30 || '-x" or "q"' ELSE 'Signal "sig_' || p_partkey % 20 || '" and Module "Unit 7 b"' END, '"', chr(39)) AS s, p_partkey % 10 / 10.0::DOUBLE AS confidence, 'd' || p_partkey % 7 AS created_at FROM part),
d AS (SELECT conv_id, turn, 't' || conv_id % 3 AS topic, '{MODULE_UNIT_' || conv_id % 70 || '}' AS a, '{PORT_P' || turn % 45 || '}' AS b, '{SIGNAL_SIG_' || (conv_id + turn) % 25 || '}' AS c FROM conversations),
k AS (SELECT DISTINCT topic, unnest([a, b, c]) AS token FROM d), p AS (SELECT topic, token, regexp_extract(token, '\\{([A-Z]+)_', 1) AS kind, lower(regexp_extract(token, '_(.*)\\}', 1)) AS part FROM k),
n1 AS (SELECT p.topic, token, CASE kind WHEN 'MODULE' THEN regexp_extract(s, '[Mm]odule\\s+\\x27([^\\x27]+)\\x27', 1) WHEN 'PORT' THEN regexp_extract(s, '[Pp]ort\\s+\\x27([^\\x27]+)\\x27', 1) ELSE regexp_extract(s, '[Ss]ignal\\s+\\x27([^\\x27]+)\\x27', 1) END AS name, part, confidence, created_at FROM p JOIN c ON c.topic = p.topic),
f AS (SELECT topic, token, name FROM n1 WHERE name <> '' AND contains(replace(lower(name), ' ', '_'), part) QUALIFY row_number() OVER (PARTITION BY topic, token ORDER BY confidence DESC, created_at DESC, name) = 1),
n3 AS (SELECT p.topic, token, unnest(regexp_extract_all(s, '\\x27([^\\x27]+)\\x27', 1)) AS name, part, confidence, created_at FROM p JOIN c ON c.topic = p.topic),
g AS (SELECT topic, token, name FROM n3 WHERE contains(replace(replace(lower(name), ' ', '_'), '-', '_'), part) QUALIFY row_number() OVER (PARTITION BY topic, token ORDER BY confidence DESC, created_at DESC, name) = 1),
r AS (SELECT topic, token, coalesce(f.name, g.name, '<!-- NAME_RESOLUTION_FAILED: ' || token || ' -->') AS name, f.name IS NULL AND g.name IS NULL AS lost FROM k LEFT JOIN f USING (topic, token) LEFT JOIN g USING (topic, token))
SELECT conv_id, turn, x.name || ' has ' || y.name || ' on ' || z.name || ', ' || x.name AS text, (x.lost::INT + y.lost::INT + z.lost::INT)::INT AS unresolved FROM d JOIN r x ON x.topic = d.topic AND x.token = a JOIN r y ON y.topic = d.topic AND y.token = b JOIN r z ON z.topic = d.topic AND z.token = c""")
def placeholder_names(spark, d):
    """Answers with placeholders against claims on parts."""
    k = F.col("p_partkey")
    m = lambda n: (k % n).cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit("The Module 'Unit "), m(60), F.lit(" top' is here"))).when(k % 4 == 1, F.concat(F.lit("port 'p"), m(40), F.lit("-in' of it"))).when(k % 4 == 2, F.concat(F.lit("see 'P"), m(30), F.lit("-x' or 'q'"))).otherwise(F.concat(F.lit("Signal 'sig_"), m(20), F.lit("' and Module 'Unit 7 b'")))
    c = table(spark, d, "part").select(F.concat(F.lit("t"), m(3)).alias("topic"), said.alias("statement"), (k % 10 / 10).alias("confidence"), F.concat(F.lit("d"), m(7)).alias("created_at"))
    token = lambda kind, n: F.concat(F.lit("{" + kind), n.cast("string"), F.lit("}"))
    a, b, z = token("MODULE_UNIT_", F.col("conv_id") % 70), token("PORT_P", F.col("turn") % 45), token("SIGNAL_SIG_", (F.col("conv_id") + F.col("turn")) % 25)
    t = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("topic"), F.concat(a, F.lit(" has "), b, F.lit(" on "), z, F.lit(", "), a).alias("text"))
    return verify.resolve_placeholders(t, c, key="k").select("k.conv_id", "k.turn", "text", F.size("unresolved").alias("unresolved"))


#: Events as moves of jobs; every seventh tells an older time.
_MOVES = """j AS MATERIALIZED (SELECT event_id % 499 AS job_id, event_id AS seq, ['queued', 'running', 'done', 'failed', 'lost'][(event_id // 499 + event_id % 3 + event_id % 5 // 4) % 5 + 1] AS status, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END AS at, event_type AS result, CASE WHEN event_id % 11 = 0 THEN 'e' || event_id END AS error FROM events)"""


@query("WITH " + _MOVES + """, p AS (SELECT * FROM j WHERE status = 'queued' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1),
a AS (SELECT j.* FROM j JOIN p USING (job_id) WHERE j.seq > p.seq AND j.at >= p.at), f0 AS (SELECT * FROM a WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1),
r AS (SELECT a.* FROM a LEFT JOIN f0 USING (job_id) WHERE a.status = 'running' AND (f0.seq IS NULL OR a.seq < f0.seq) QUALIFY row_number() OVER (PARTITION BY a.job_id ORDER BY a.seq) = 1),
e AS (SELECT a.* FROM a JOIN r USING (job_id) WHERE a.status IN ('done', 'failed') AND a.seq > r.seq AND a.at >= r.at QUALIFY row_number() OVER (PARTITION BY a.job_id ORDER BY a.seq) = 1),
x AS (SELECT * FROM e UNION ALL SELECT * FROM f0 WHERE job_id NOT IN (SELECT job_id FROM r)), m AS (SELECT job_id, count(*) AS n FROM j GROUP BY 1)
SELECT m.job_id, coalesce(x.status, r.status, p.status) AS status, p.at AS created_at, coalesce(x.at, r.at, p.at) AS updated_at, CASE WHEN x.job_id IS NOT NULL THEN x.result WHEN r.job_id IS NOT NULL THEN r.result ELSE p.result END AS result, CASE WHEN x.job_id IS NOT NULL THEN x.error WHEN r.job_id IS NOT NULL THEN r.error ELSE p.error END AS error,
(p.job_id IS NOT NULL)::BIGINT + (r.job_id IS NOT NULL)::BIGINT + (x.job_id IS NOT NULL)::BIGINT AS accepted, n - ((p.job_id IS NOT NULL)::BIGINT + (r.job_id IS NOT NULL)::BIGINT + (x.job_id IS NOT NULL)::BIGINT) AS rejected
FROM m LEFT JOIN p USING (job_id) LEFT JOIN r ON r.job_id = m.job_id LEFT JOIN x ON x.job_id = m.job_id""")
def job_states(spark, d):
    k = F.col("event_id")
    status = F.get(F.array(*[F.lit(s) for s in ("queued", "running", "done", "failed", "lost")]), ((F.floor(k / 499) + k % 3 + F.floor(k % 5 / 4)) % 5).cast("int"))
    at = F.when(k % 7 == 0, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts"))
    e = table(spark, d, "events").select((k % 499).alias("job_id"), k.alias("seq"), status.alias("status"), at.alias("at"), F.col("event_type").alias("result"), F.when(k % 11 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("error"))
    return jobs.job_table(e)


@query("""WITH f AS (SELECT 'd' || doc_id AS file_path, text, CASE WHEN text IS NULL THEN 'ValueError: no content' WHEN doc_id % 10 = 3 THEN 'SyntaxError: module never ends' END AS reason FROM documents)
SELECT 'row' AS kind, file_path, len(string_split(text, ' '))::BIGINT AS n, NULL AS reason FROM f WHERE reason IS NULL UNION ALL SELECT 'reject', file_path, NULL, reason FROM f WHERE reason IS NOT NULL""")
def parse_log(spark, d):
    """Documents as files, of which one in ten never ends: rows and rejects of one pass."""
    end = F.when(F.col("doc_id") % 10 == 3, "").otherwise("\nendmodule")
    files_ = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.concat("text", end).alias("content"))

    def parse(text: str) -> list[tuple]:
        body = text.removesuffix("\nendmodule")
        if body == text:
            raise SyntaxError("module never ends")
        return [(len(body.split(" ")),)]

    rows, bad, _ = rejects.parsed(files_, parse, "n long", F.current_timestamp())
    return rows.select(F.lit("row").alias("kind"), "file_path", "n", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(F.lit("reject").alias("kind"), "file_path", F.lit(None).cast("long").alias("n"), "reason"))


_ASKED = ["which port has the clock", "la data de les modules et plus", "x"]
_VECTOR = "list_transform(range(0, 16), lambda i: len(list_filter(list_transform(list_filter(string_split(lower({t}), ' '), lambda w: w <> ''), lambda w: (31 * unicode(w) + length(w)) % 16), lambda b: b = i))::DOUBLE)"


@query(f"""WITH q AS (SELECT n, question, {_VECTOR.format(t='question')} AS v FROM (VALUES {', '.join(f"({n}, '{q}')" for n, q in enumerate(_ASKED))}) x(n, question)),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, lang, ['claim', 'hdd_section', 'module_parse', 'signal_path_edge', 'other'][doc_id % 5 + 1] AS kind, {_VECTOR.format(t="coalesce(text, '')")} AS v FROM documents WHERE lang = 'fr'),
s AS (SELECT n, question, doc_id, kind, text, lang, round(list_cosine_similarity(d.v, q.v), 6) AS score FROM d, q WHERE list_sum(d.v) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, doc_id) AS r, CASE kind WHEN 'claim' THEN 'claim:' || substr(text, 1, 200) WHEN 'hdd_section' THEN 'hdd:' || lang || ':' || substr(text, 1, 4) WHEN 'module_parse' THEN 'mp:m' || doc_id % 50 WHEN 'signal_path_edge' THEN 'spe:' || doc_id % 30 || doc_id % 20 ELSE 'other:m' || doc_id % 50 || 'f' || doc_id % 40 END AS same FROM s QUALIFY r <= 30),
b AS (SELECT *, doc_id % 7 = 0 AS used, round(CASE WHEN doc_id % 7 = 0 THEN score * 2 ELSE score END, 6) AS boosted FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY n, same ORDER BY boosted DESC, used DESC, r) AS k FROM b)
SELECT question, CASE n WHEN 0 THEN 'port_query' ELSE 'general_query' END AS query_type, row_number() OVER (PARTITION BY n ORDER BY boosted DESC, used DESC, r)::INT AS rank, doc_id, boosted AS score FROM o WHERE k = 1 QUALIFY rank <= 10""")
def rtl_search(spark, d):
    """Questions against documents as records of five kinds, vectors by the default provider."""
    k, s = F.col("doc_id"), lambda c: c.cast("string")
    text = F.coalesce("text", F.lit(""))
    kind = F.get(F.array(*map(F.lit, ("claim", "hdd_section", "module_parse", "signal_path_edge", "other"))), (k % 5).cast("int"))
    index = table(spark, d, "documents").select(
        "doc_id", "lang", kind.alias("analysis_type"), text.alias("claim_text"), F.col("lang").alias("topic"), F.substring(text, 1, 4).alias("hdd_section_title"), F.concat(F.lit("m"), s(k % 50)).alias("module_name"), F.lit("").alias("sub_record_type"),
        F.lit("e").alias("edge_type"), s(k % 30).alias("src"), s(k % 20).alias("dst"), F.concat(F.lit("a/f"), s(k % 40)).alias("file_path"), (k % 7 == 0).alias("used_in_n1"), embedded(text, WordEmbedder).alias("embedding"),
    )
    return searched(index, _ASKED, WordEmbedder, "doc_id", 10, lang="fr").select("question", "query_type", "rank", "doc_id", "score")


@query("""WITH g AS (SELECT s_nationkey AS n, count(*) AS c, count(*) FILTER (s_suppkey % 2 = 0) AS even FROM supplier GROUP BY 1)
SELECT 'pkg' || n AS module_name, 'PackageConfig' AS topic, 1 + c + 2 + c AS n FROM g UNION ALL SELECT 'pkg' || n, 'PackageFunction', c FROM g UNION ALL SELECT 'm' || n, 'TopLevelParameter', 1 + even FROM g
UNION ALL SELECT 'm' || n, 'WireTopology', c FROM g UNION ALL SELECT 'm' || n, 'InstanceParameter', c FROM g UNION ALL SELECT 'm' || n, 'PortBinding', c FROM g UNION ALL SELECT 'm' || n, 'Hierarchy', 1 FROM g""")
def rtl_claim_table(spark, d):
    """A package and a module a nation, with a constant, a function, a wire and an instance a supplier."""
    n = F.col("s_suppkey").cast("string")
    say = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    each = {
        "constants": say("localparam int A", n, " = ", n, ";\ntypedef enum logic { P", n, ", Q } e", n, "_t;\n"), "functions": say("function int f", n, "(int a);\n return a;\nendfunction\n"),
        "params": F.when(F.col("s_suppkey") % 2 == 0, say("parameter B", n, " = ", n, ";\n")).otherwise(""), "wires": say("wire x_t w", n, "[4][", n, "];\n"), "inst": say("sub #(.N(", n, ")) u", n, " (.a(s", n, "));\n"),
    }
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(*[F.array_join(F.collect_list(c), "").alias(k) for k, c in each.items()])
    k = F.col("s_nationkey").cast("string")
    package = say("package pkg", k, ";\n", F.col("constants"), "parameter W = 2;\n parameter V = 3;\n", F.col("functions"), "endpackage\n")
    module = say("module m", k, " #(parameter H = 1) (input clk);\n", F.col("params"), F.col("wires"), F.col("inst"), "if (E) begin : g\nend\nendmodule\n")
    files = g.select(F.explode(F.array(F.struct(say("p", k).alias("path"), package.alias("content")), F.struct(say("m", k).alias("path"), module.alias("content")))).alias("f")).select("f.*")
    modules = files.where("path like 'm%'")
    return emitters.rtl_claims(files, rtl.parsed(modules), "pipe").groupBy("module_name", "topic").agg(F.count(F.lit(1)).alias("n"))


_NEW = """t AS MATERIALIZED (SELECT doc_id, text, lang || '/' || doc_id % 2 AS topic, doc_id % 4 = 0 AND length(text) BETWEEN 10 AND 500 AS fresh, doc_id % 4 <> 0 AND doc_id % 3 <> 1 AS old FROM documents WHERE lang IS NOT NULL),
w AS MATERIALIZED (SELECT *, {tok} AS t FROM t), p AS (SELECT a.doc_id AS n, b.doc_id AS o FROM w a JOIN w b ON a.fresh AND b.old AND a.topic = b.topic AND len(a.t) > 0 AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE >= 0.7)""".format(tok=_TOK)


@query("WITH " + _NEW + """ SELECT 'new' AS kind, doc_id, 'draft' AS status, coalesce((SELECT string_agg(o::VARCHAR, ',' ORDER BY o::VARCHAR) FROM p WHERE n = doc_id), '') AS against, sha256(text) AS hash FROM t WHERE fresh
UNION ALL SELECT DISTINCT 'old', o, 'conflicted', '', '' FROM p UNION ALL SELECT 'refused', doc_id, '', 'statement', '' FROM t WHERE doc_id % 4 = 0 AND NOT fresh""")
def claims_created(spark, d):
    """Every fourth document is a new claim of its language's topics; two thirds of the others stand verified."""
    e = F.array(F.struct(F.col("text").alias("source_chunk"), F.lit(None).cast("string").alias("chunk_hash"), F.lit(None).cast("string").alias("extraction_date")))
    docs = table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("claim_id"), F.concat("lang", F.lit("/"), (F.col("doc_id") % 2).cast("string")).alias("topic"), F.lit(None).cast("string").alias("variant"), F.col("text").alias("statement"), F.lit(0.5).alias("confidence"), e.alias("evidence"), F.array().cast("array<string>").alias("derived_from"))
    k = F.col("claim_id")
    old = docs.where(k % 4 != 0).withColumns({"version": F.lit(1), "status": F.when(k % 3 == 1, "draft").otherwise("verified")})
    made, changed, refused = claims.create(docs.where(k % 4 == 0), old, F.lit("2024-01-01"))
    out = made.select(F.lit("new").alias("kind"), k.alias("doc_id"), "status", F.array_join("derived_from", ",").alias("against"), F.col("evidence")[0]["chunk_hash"].alias("hash"))
    out = out.unionByName(changed.select(F.lit("old").alias("kind"), k.alias("doc_id"), "status", F.lit("").alias("against"), F.lit("").alias("hash")))
    return out.unionByName(refused.select(F.lit("refused").alias("kind"), k.alias("doc_id"), F.lit("").alias("status"), F.array_join("errors", ",").alias("against"), F.lit("").alias("hash")))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'verified' END AS status, [o_orderkey - 1, o_orderkey - 7] AS f FROM orders), g AS (SELECT o_orderkey AS k FROM c WHERE status = 'deprecated' AND o_orderkey % 2 = 0)
SELECT o_orderkey AS claim_id, 'conflicted' AS status FROM c WHERE status <> 'deprecated' AND (f[1] IN (SELECT k FROM g) OR f[2] IN (SELECT k FROM g))""")
def claims_cascade(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k.alias("claim_id"), F.lit(1).alias("version"), F.when(F.col("o_orderstatus") == "P", "deprecated").otherwise("verified").alias("status"), F.array(k - 1, k - 7).alias("derived_from"))
    return claims.cascade(c, c.where("status = 'deprecated' and claim_id % 2 = 0")).select("claim_id", "status")


@query("SELECT 't' || o_custkey % 50 AS topic, bool_and(o_orderkey % 9 > 0) AS open FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def publish_gates(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")).alias("topic"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("draft").alias("status"), F.when(k % 9 > 0, "approved").otherwise("pending_review").alias("approval_status"))
    return claims.publish_gate(o)


@query(_VERSIONS + " SELECT o_custkey AS claim_id, array_to_string((['a', 'b', 'c'])[1:o_orderkey % 4], ',') AS evidence, least(o_orderkey % 4, 3)::INT AS evidence_count FROM o WHERE back = 1")
def claim_evidence(spark, d):
    return claims.evidence_of(_versions(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT n_nationkey AS module_name, coalesce((SELECT string_agg(DISTINCT 'p' || s_suppkey % 4, ',' ORDER BY 'p' || s_suppkey % 4) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 3 = 0), '') AS ports FROM nation")
def modules_with_ports(spark, d):
    p = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("module_name"), F.concat(F.lit("p"), (F.col("s_suppkey") % 4).cast("string")).alias("port"))
    return records.with_ports(table(spark, d, "nation").select(F.col("n_nationkey").alias("module_name")), p).withColumn("ports", F.array_join("ports", ","))


@query("SELECT s_suppkey, s_nationkey AS module_name FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 97 = 0)")
def automatic_claims(spark, d):
    by_hand = table(spark, d, "customer").where("c_custkey % 97 = 0").select(F.col("c_nationkey").alias("module_name"))
    return records.without_manual(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("module_name")), by_hand)


@query("""WITH x AS (SELECT 's' || s_suppkey AS id, 'n' || n_nationkey AS b, 'r' || n_regionkey AS c, s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT id, CASE WHEN s_suppkey % 5 = 0 THEN 'own' WHEN n_nationkey % 2 = 0 THEN 'block' ELSE 'chip' END AS topic FROM x WHERE s_suppkey % 5 = 0 OR n_nationkey % 2 = 0 OR n_regionkey % 2 = 0""")
def inherited_topics(spark, d):
    """A supplier below its nation and region, of which every other has a topic."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    tree = s.select(name("s", "s_suppkey").alias("id"), F.array(name("r", "n_regionkey"), name("n", "n_nationkey"), name("s", "s_suppkey")).alias("path"))
    t = [("supplier", "s", "s_suppkey", 5, "own"), ("nation", "n", "n_nationkey", 2, "block"), ("region", "r", "r_regionkey", 2, "chip")]
    return graph.inherited_topic(tree, reduce(DataFrame.unionByName, [table(spark, d, x).where(F.col(k) % m == 0).select(name(p, k).alias("id"), F.lit(topic).alias("topic")) for x, p, k, m, topic in t]))


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, l_returnflag AS type FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def edges_with_both_ends(spark, d):
    nodes = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return graph.upsert_edges(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type")), nodes)


@query("""SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, length(substr(text, 1, 300))::INT AS cut, (length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1)::INT AS line, CASE WHEN doc_id % 3 = 0 THEN 'manual_upload' ELSE 'archive_md' END AS source FROM documents""")
def text_measures(spark, d):
    """Tokens, a cut to a hundred, the line of an offset and the source of each document."""
    source = F.when(F.col("doc_id") % 3 == 0, "elsewhere").otherwise(T.SOURCES[0])
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.length(T.truncate_tokens(F.col("text"), 100)).alias("cut"), T.line_of(F.col("text"), F.lit(500)).alias("line"), T.valid_source(source).alias("source"))


@query("SELECT page_id, url FROM pages WHERE page_id > 17 AND lower(split_part(url, ':', 1)) = 'http' ORDER BY page_id LIMIT 25")
def page_of_pages(spark, d):
    """The page of 25 rows after a key, of rows whose scheme is asked for in other letters."""
    p = table(spark, d, "pages").withColumn("scheme", F.split("url", ":")[0])
    return search.page_after(search.same_metadata(p, scheme="HTTP", lang=None), "page_id", 17, 25).select("page_id", "url")


@query("""SELECT '## ' || o_orderpriority || ' (' || count(*) || ')' || chr(10) || array_to_string(list_transform(list_sort(list(DISTINCT 'c' || o_custkey))[1:20], lambda x: '- ' || x), chr(10)) AS markdown, o_orderpriority FROM orders GROUP BY o_orderpriority""")
def priority_report(spark, d):
    return files.markdown_report(table(spark, d, "orders").select("o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("line")), "o_orderpriority", "line")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def keys_to_backfill(spark, d):
    return files.backfill(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT event_type AS error, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def dead_letters(spark, d):
    """Each event as a message that came twice."""
    m = table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("event_type").alias("error"), F.col("user_id").alias("key"))
    return files.drained(m.unionByName(m))


@query("SELECT conv_id, turn, turn % 5 <> 0 AND NOT (regexp_matches(text, '(?i)\\blatest\\b')) AND NOT (conv_id % 2 = 0 AND turn % 3 = 0) AS publish FROM conversations WHERE text IS NOT NULL")
def publishable_answers(spark, d):
    """Answers that still name a version ``latest``, or hold an unsupported part of an answered question, stay."""
    text = F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" the LATEST one"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", verify.may_publish(text, (F.col("conv_id") % 2 == 0).cast("int"), F.col("turn") % 3 == 0).alias("publish"))


@query(f"""SELECT 'm_' || s_nationkey AS module, {_INST} AS instance, unnest(['i_ai_clk', '{{a, b}}', 'q']) AS parent_signal, ['sram_macro', 'boot_rom', 'rf_macro', 'alu'][s_suppkey % 4 + 1] AS child_module, unnest(['i_ai_clk', 'i_data', 'o_q']) AS child_port, unnest(['input', 'input', 'output']) AS direction FROM supplier""")
def dataflow_connections(spark, d):
    return rtl.dataflow(rtl.parsed(rendered(spark, d))).select("module", "instance", "parent_signal", "child_module", "child_port", "direction")


@query("""WITH n AS (SELECT n_nationkey AS k, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS c FROM nation)
SELECT 'm_' || k AS module_name, 'parameter_config' AS sub_record_type, 'Module ''m_' || k || ''' parameter configuration: WIDTH=' || (k + 1) || ', TWICE=WIDTH*2' AS said FROM n UNION ALL SELECT 'm_' || k, 'instance_hierarchy', 'Module ''m_' || k || ''' instance hierarchy' FROM n WHERE c > 0
UNION ALL SELECT 'm_' || k, 'port_summary', 'Module ''m_' || k || ''' has ' || x FROM n, unnest(['1', '1', '1', '1', '5 total ports']) y(x)""")
def sub_records(spark, d):
    """Of modules of five ports or more; the beginnings of what records of ports and instances say."""
    r = rtl.sub_records(rtl.parsed(rendered(spark, d)), "n1", 5)
    total = F.when(F.contains("parsed_summary", F.lit(" total ports: ")), F.regexp_extract("parsed_summary", "^(.*ports):", 1)).otherwise(F.regexp_extract("parsed_summary", r"^(.* has \d+) ", 1))
    said = F.when(F.col("sub_record_type") == "port_summary", total).when(F.col("sub_record_type") == "instance_hierarchy", F.split("parsed_summary", ": ")[0]).otherwise(F.col("parsed_summary"))
    return r.select("module_name", "sub_record_type", said.alias("said"))


@query("""SELECT event_id, 'event_type=' || event_type || ',k=' || CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') ELSE 'none' END AS fields FROM events""")
def log_records(spark, d):
    """The listed fields of each event's properties, others dropped, absent ones by default."""
    e = table(spark, d, "events")
    record = F.map_concat(F.when(F.col("event_id") % 3 == 0, F.from_json("props", "map<string,string>")).otherwise(F.create_map().cast("map<string,string>")), F.create_map(F.lit("secret"), F.lit("x"), F.lit("event_type"), F.col("event_type")))
    m = T.listed_keys(record, ["k", "event_type"], {"k": F.lit("none")})
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("fields"))
