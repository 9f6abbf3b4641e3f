"""Retirement of near duplicates, placeholders and graph exports against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gritstone.operators import claims, graph, verify


def walk(order, at, pairs):
    """The greedy pass: firsts in order, seconds in order; what went as a second counts no more."""
    gone, out = set(), set()
    alike = {frozenset(p) for p in pairs}
    for x, i in enumerate(order):
        if i in gone:
            continue
        for j in order[x + 1 :]:
            if j in gone or frozenset((i, j)) not in alike:
                continue
            older = j if at[i] >= at[j] else i
            if older == j:
                gone.add(j)
            out.add(older)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_retire(spark, seed):
    r = random.Random(seed)
    n = 25
    at = {i: r.randrange(n if seed % 2 else 5) for i in range(n)}
    place = {i: r.random() for i in range(n)}
    pairs = [p for p in ((a, b) for a in range(n) for b in range(a)) if r.random() < (0.08, 0.15, 0.3, 0.9)[seed]]
    got = claims.retire(spark.createDataFrame(pairs, "a int, b int"), spark.createDataFrame([(i, at[i], place[i]) for i in range(n)], "k int, made int, place double"), "k", "made", [F.col("place")])
    assert {x.k for x in got.collect()} == walk(sorted(range(n), key=place.get), at, pairs)


def test_retire_chain(spark):
    """A~B, B~C, not A~C: newest first C stays, B goes to C, and A, whose only newer copy is gone, stays."""
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "a string, b string")
    rows = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "k string, made int")
    chain = lambda order: {(x.k, x.by) for x in claims.retire(pairs, rows, "k", "made", order).collect()}
    assert chain([-F.col("made")]) == {("B", "C")}
    assert chain([F.col("made")]) == {("A", "B"), ("B", "C")}  # oldest first each meets a newer one that still stands
    assert claims.retire(pairs.limit(0), rows, "k", "made", [F.col("made")]).count() == 0


def test_containing(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab_") for _ in range(n))
    names, parts = [(g, word(r.randrange(7)), i) for g in "xy" for i in range(40)], [(g, word(r.randrange(5))) for g in "xyz" for _ in range(30)]
    got = verify.containing(spark.createDataFrame(set(parts), "g string, part string"), spark.createDataFrame(names, "g string, name string, i int"), ["g"])
    assert {(x.g, x.part, x.name, x.i) for x in got.collect()} == {(g, p, n, i) for g, p in parts for h, n, i in names if g == h and p and p in n}


def test_placeholders(spark):
    said = [("t", "Module 'UCIe Top' holds Port 'ucie_clk'", 0.5, "2"), ("t", "module 'ucie_top_b'", 0.9, "1"), ("t", "Module 'ucie_top_a'", 0.9, "1"), ("t", "Module 'old ucie_top'", 0.9, "0"), ("t", "about 'noc-rst' and 'noc_rst_x'", None, None), ("u", "Instance 'u_dma'", 0.1, "3")]
    c = spark.createDataFrame(said, "topic string, statement string, confidence double, created_at string")
    found = spark.createDataFrame([("{INSTANCE_ALU}", 2, "m2", ["ualu"], []), ("{INSTANCE_ALU}", 1, "m1", ["x", " u_ALU_0 "], []), ("{SIGNAL_ZZ}", 1, "", [], []), ("{SIGNAL_ZZ}", 2, "mod", [], [])], "token string, rank int, module_name string, instances array<string>, ports array<string>")
    texts = [(1, "t", "{MODULE_UCIE_TOP} and {PORT_UCIE} {MODULE_UCIE_TOP}"), (2, "t", "{SIGNAL_NOC_RST} {INSTANCE_ALU} {SIGNAL_ZZ} {INSTANCE_NONE}"), (3, "u", "{INSTANCE_DMA} {MODULE_UCIE_TOP} {OTHER_X} {MODULE_}"), (4, "t", None), (5, None, "{PORT_A}"), (6, "t", "plain")]
    docs = spark.createDataFrame(texts, "doc_id int, topic string, text string")
    got = {x.doc_id: (x.text, x.unresolved) for x in verify.resolve_placeholders(docs, c, found).collect()}
    lost = verify.UNRESOLVED
    assert got == {
        1: ("ucie_top_a and ucie_clk ucie_top_a", []), 2: (f"noc-rst u_ALU_0 mod {lost % '{INSTANCE_NONE}'}", ["{INSTANCE_NONE}"]),
        3: (f"u_dma {lost % '{MODULE_UCIE_TOP}'} {{OTHER_X}} {{MODULE_}}", ["{MODULE_UCIE_TOP}"]), 4: (None, []), 5: (lost % "{PORT_A}", ["{PORT_A}"]), 6: ("plain", []),
    }
    assert verify.resolve_placeholders(docs.limit(0), c).count() == 0 and {x.text for x in verify.resolve_placeholders(docs, c.limit(0)).where("doc_id = 6").collect()} == {"plain"}


def test_export(spark):
    names = {"m": ("top", "Module"), "c1": ("a", "Module"), "c2": ("b", "Module"), **{f"p{i}": (f"port{i}", "Port") for i in range(4)}, **{f"s{i}": (f"net{i}", "Signal") for i in range(6)}}
    edges = [("m", "c1", "INSTANTIATES"), ("m", "c2", "INSTANTIATES"), ("m", "p0", "HAS_PORT"), ("m", "p1", "HAS_PORT"), ("c1", "p2", "HAS_PORT"), ("c1", "p3", "HAS_PORT")]
    edges += [(a, b, "CONNECTS_TO") for a, b in [("p0", "s0"), ("s0", "s1"), ("s1", "s2"), ("s2", "s0"), ("s2", "s3"), ("p2", "s4"), ("p3", "s4"), ("p3", "s5")]]
    n = spark.createDataFrame([(k, *v) for k, v in names.items()], "id string, name string, type string")
    e = spark.createDataFrame(edges, "src string, dst string, type string")

    def run(*args, **more):
        a, b, meta = graph.export(n, e, *args, **more)
        b = b.collect()
        assert len({x.id for x in b}) == len(b) == meta["edge_count"] and a.count() == meta["node_count"]
        return {(x.id, x.type) for x in a.collect()}, {(x.source, x.target, x.label) for x in b}, meta

    a, b, _ = run("chip", "top")
    assert a == {("top", "Module"), ("a", "Module"), ("b", "Module"), ("a.net4", "Signal"), ("a.net5", "Signal")}
    assert b == {("top", "a", "INSTANTIATES"), ("top", "b", "INSTANTIATES"), ("a", "a.net4", "CONNECTS_TO"), ("a", "a.net5", "CONNECTS_TO")}
    a, b, _ = run("module", "top")
    assert a == {("top", "Module"), ("top.port0", "Port"), ("top.port1", "Port"), ("top.net0", "Signal")} and ("top.port0", "top.net0", "CONNECTS_TO") in b and len(b) == 3
    a, b, meta = run("signal", "top", signal="port", depth=2)
    assert {x for x, _ in a} == {"top", "port0", "net0", "net1"} and b == {("top", "port0", "HAS_PORT"), ("port0", "net0", "CONNECTS_TO"), ("net0", "net1", "CONNECTS_TO")}
    a, b, meta = run("signal", "top", signal="0", depth=99)
    assert meta["depth"] == 10 and {x for x, _ in a} == {"top", "port0", "net0", "net1", "net2", "net3"} and len(b) == 6
    a, b, meta = run("chip", "top", most=2)
    assert meta["truncated"] and {x for x, _ in a} == {"a", "top"} and b == {("top", "a", "INSTANTIATES")}
    assert run("chip", "nowhere")[2]["node_count"] == 0
    assert graph.export(None, None, "chip", "top") == (None, None, {"scope": "chip", "root_module": "top", "depth": 3, "node_count": 0, "edge_count": 0, "fallback": True, "truncated": False})
    for bad in (("all", "top"), ("chip", ""), ("signal", "top")):
        with pytest.raises(ValueError, match="scope"):
            graph.export(n, e, *bad)


def test_reached_meets_each_node_once(spark):
    """A grid has more paths than anyone can list."""
    e = [(x * 20 + y, (x + a) * 20 + y + b) for x in range(20) for y in range(20) for a, b in ((0, 1), (1, 0)) if x + a < 20 and y + b < 20]
    got = {r.id: r.depth for r in graph.reached(spark.createDataFrame([(0,)], "id int"), spark.createDataFrame(e, "src int, dst int"), 9).collect()}
    assert got == {x * 20 + y: x + y for x in range(20) for y in range(20) if x + y <= 9}


def _join_rows(plan):
    """Rows out of each join of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        kids = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        kids = [plan.plan()]
    else:
        kids = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in kind else []
    return own + [n for k in kids for n in _join_rows(k)]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_few_candidates(spark, least):
    """Rows that share words but are not alike are told apart where postings meet; none that is alike is lost."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.sample(words, r.choice([30, 60, 120]))) for _ in range(300)]
    for t in r.sample(texts, 60):  # near copies at all distances
        w = t.split()
        texts.append(" ".join(w[: len(w) - r.randint(0, len(w) // 2)] + r.sample(words, r.randint(0, 9))))
    texts += [texts[0], texts[0].upper(), "", " ", None, "w1", "W1", "w2"]
    rows = [(i % 2 if i < 360 else 0, i, t) for i, t in enumerate(texts)] + [(None, 900, "w1"), (None, 901, "w1")]
    df = claims.pairs_alike(spark.createDataFrame(rows, "g int, id int, s string"), "g", "id", "s", least)
    got = {(x.a, x.b): (x.g, x.score) for x in df.collect()}
    sets = [(g, i, set((t or "").lower().split())) for g, i, t in rows if g is not None]
    want = {(i, j): (g, round(len(a & b) / len(a | b), 6)) for g, i, a in sets for h, j, b in sets if g == h and i < j and a and b and len(a & b) / len(a | b) >= least}
    assert got == want and len(want) >= 5
    # The pairs that meet are at most those alike, once a shared word, and a few by chance.
    assert max(_join_rows(df._jdf.queryExecution().executedPlan())) < 60 * len(want) + 400


@pytest.mark.parametrize("least", [0.6, 0.8, 0.85])
def test_small_sets_at_the_limit(spark, least):
    """A set that only gains words has neighbours broken too, even where it may lose none."""
    r = random.Random(11)
    texts = []
    for i in range(60):
        w = [f"w{i}_{k}" for k in range(r.randint(2, 12))]
        texts += [" ".join(w), *(" ".join([*w, *(f"x{i}_{m}" for m in range(m))]) for m in (1, 2, 3))]
    words = [set(t.split()) for t in texts]
    got = {(x.a, x.b) for x in claims.pairs_alike(spark.createDataFrame(list(enumerate(texts)), "id int, s string").withColumn("g", F.lit(1)), "g", "id", "s", least).collect()}
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and len(a & b) / len(a | b) >= least}


@pytest.mark.parametrize("least, at_once", [(0.3, 20_000), (0.5, 40), (0.7, 40), (0.9, 20_000)])
def test_crowds(spark, monkeypatch, least, at_once):
    """Copies are compared once a class and the sets of a crowd move to few places; pairs and retirement are those of all rows."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    sets = [base] * 40 + [[w for w in base if r.random() > 0.06] + [f"x{i}"] for i in range(60)] + [r.sample([f"v{i}" for i in range(200)], r.randint(1, 40)) for _ in range(40)]
    texts = [" ".join(r.sample(s, len(s))) for s in sets]
    rows = [(i % 7 == 0, i, t, r.randrange(9)) for i, t in enumerate(texts)]
    kept = {}
    plain = claims.stored
    monkeypatch.setattr(claims, "AT_ONCE", at_once)
    monkeypatch.setattr(claims, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    df = spark.createDataFrame(rows, "g boolean, id int, s string, made int")
    got = {(x.a, x.b): (x.g, x.score) for x in claims.pairs_alike(df, "g", "id", "s", least).collect()}
    words = [set(t.split()) for t in texts]
    score = lambda i, j: len(words[i] & words[j]) / len(words[i] | words[j])
    want = {(i, j): (g, round(score(i, j), 6)) for g, i, _, _ in rows for h, j, _, _ in rows if g == h and i < j and score(i, j) >= least}
    assert got == want
    firsts = {(g, frozenset(words[i])) for g, i, _, _ in rows}
    assert kept["near"].count() <= 61 * 60 // 2 + 400  # the crowd with one of the copies; all rows of it have 4,950 pairs
    assert kept["wants"].count() <= (3 if at_once > 40 else 14) * len(firsts)
    monkeypatch.setattr(claims, "stored", plain)
    copies, pairs = claims.classes_alike(df, "g", "id", "s", least, order=[-F.col("made")])
    gone = claims.retire_copies(claims.retire(pairs, df, "id", "made", [-F.col("made")]), copies, "id")
    every = claims.retire(spark.createDataFrame([(a, b) for a, b in want], "a int, b int"), df, "id", "made", [-F.col("made")])
    assert sorted(map(tuple, gone.collect())) == sorted(map(tuple, every.collect()))


@pytest.mark.parametrize("least", [0.6, 0.7, 0.9])
def test_sets_are_cut_as_the_larger_asks(spark, least):
    """Parts of sets meet and bits tell long ones apart; no pair at the limit is lost, on either side of a cut."""
    r = random.Random(2)
    texts = []
    for n in (50, 63, 64, 70, 180, 255, 256, 300, 500, 512, 730, 1023, 1024, 1100):
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        texts.append(base)
        for _ in range(8):  # a number of words that keeps the pair near the limit
            lost = r.randint(0, int((1 - least) * n))
            room = int((n - lost) / least) - n
            texts.append(base[lost:] + [f"x{r.randrange(10**9)}" for _ in range(max(0, room - r.randint(0, 1)))])
    words = [set(t) for t in texts]
    rows = [(i, " ".join(r.sample(t, len(t)))) for i, t in enumerate(texts)]
    got = {(x.a, x.b) for x in claims.pairs_alike(spark.createDataFrame(rows, "id int, s string").withColumn("g", F.lit(1)), "g", "id", "s", least).collect()}
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and len(a & b) / len(a | b) >= least}
    assert got == want and len(want) > 60


def test_crowds_meet_the_rows_that_stay(spark, monkeypatch):
    """Rows that a newest few retire do not meet each other: pairs of a crowd grow with its rows, not with their square."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    sets = [[w for w in base if r.random() > 0.04] + [f"x{i}"] for i in range(300)]  # a crowd
    sets += [r.sample([f"v{i}" for i in range(90)], r.randint(20, 60)) for _ in range(120)] + [sets[4], sets[9]]
    r.shuffle(sets)
    rows = [(i % 17 == 0, i, " ".join(s), r.randrange(50)) for i, s in enumerate(sets)]
    monkeypatch.setattr(claims, "LOOKED", 1)
    monkeypatch.setattr(claims, "EARLY", 12)
    kept, plain = [], claims.stored
    monkeypatch.setattr(claims, "stored", lambda df, name: (kept.append((name, plain(df, name))), kept[-1][1])[1])
    df, newest = spark.createDataFrame(rows, "g boolean, id int, s string, made int"), [-F.col("made")]
    got = sorted(map(tuple, claims.retired(df, "g", "id", "s", 0.7, "made", newest).collect()))
    monkeypatch.setattr(claims, "stored", plain)
    words = [set(s) for s in sets]
    alike = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and rows[i][0] == rows[j][0] and len(a & b) / len(a | b) >= 0.7]
    want = claims.retire(spark.createDataFrame(alike, "a int, b int"), df, "id", "made", newest)
    assert got == sorted(map(tuple, want.collect()))
    crowd = [i for i, t in enumerate(words) if "v" not in {w[0] for w in t}]
    met = sum(x.where(F.col("a").isin(crowd) & F.col("b").isin(crowd)).count() for name, x in kept if name == "near")
    assert met < 1500 and len(set(alike) & {(i, j) for i in crowd for j in crowd}) > 30_000
