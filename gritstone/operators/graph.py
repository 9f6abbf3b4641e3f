"""Property graph as two tables, nodes (id, label, props) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def upsert_nodes(rows: DataFrame, keys: list[str], order: str, props: list[str]) -> DataFrame:
    """One row a key; of each property the latest value that is not null; rows without a key are skipped."""
    whole = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return whole.groupBy(*keys).agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in props])


def upsert_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Both ends must exist; one row an edge."""
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    kept = edges.join(ids, edges["src"] == ids["_id"], "left_semi")
    return kept.join(ids, kept["dst"] == ids["_id"], "left_semi").dropDuplicates(["src", "dst", "type"])


def roots(modules: DataFrame, instances: DataFrame, name: str, target: str) -> DataFrame:
    """Defined but never instantiated."""
    return modules.join(instances.select(F.col(target).alias(name)).distinct(), name, "left_anti").select(name)


def paths(start: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """All paths of 1..most hops from start (id); a path does not meet a node twice, and diamonds
    give every branch. Each hop is one equi-join; plans stay short as ``most`` is a small cap of the caller."""
    now = start.select(F.col("id").alias("root"), F.col("id").alias("at"), F.array("id").alias("path"))
    out = None
    for _ in range(most):
        step = now.join(edges, now["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        now = step.select("root", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        out = now if out is None else out.unionByName(now)
    return out.withColumn("depth", (F.size("path") - 1).cast("long"))


def ancestors(seeds: DataFrame, parents: DataFrame, most: int = 5) -> DataFrame:
    """Stale marks go up at most ``most`` levels; each node once, with its least level."""
    now, out = seeds.select("id", F.lit(0).alias("level")), None
    for i in range(1, most + 1):
        now = now.join(parents, "id").select(F.col("parent").alias("id"), F.lit(i).alias("level")).distinct()
        out = now if out is None else out.unionByName(now)
    return out.groupBy("id").agg(F.min("level").cast("long").alias("level"))


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def truncate_by_degree(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, ties by id, and the edges among them."""
    nodes = degrees(edges).orderBy(F.desc("degree"), "id").limit(most)
    ids = nodes.select(F.col("id").alias("_id"))
    kept = edges.join(ids, edges["src"] == ids["_id"], "left_semi")
    return nodes, kept.join(ids, kept["dst"] == ids["_id"], "left_semi")


def crossings(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """Edges whose ends lie in different domains."""
    a, b = domains.select(F.col("id").alias("src"), F.col("domain").alias("from_domain")), domains.select(F.col("id").alias("dst"), F.col("domain").alias("to_domain"))
    return edges.join(a, "src").join(b, "dst").where("from_domain <> to_domain")


def breakdown(df: DataFrame, by: str) -> DataFrame:
    """A7."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def inherited_topic(tree: DataFrame, topics: DataFrame) -> DataFrame:
    """The topic of the nearest classified ancestor; tree: (id, path array from the root)."""
    up = tree.select("id", F.posexplode("path").alias("at", "node")).join(topics.withColumnRenamed("id", "node"), "node")
    return up.groupBy("id").agg(F.max_by("topic", "at").alias("topic"))


def variant_delta(base: DataFrame, variant: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed, changed, same."""
    a, b = base.select(key, F.col(value).alias("old")), variant.select(key, F.col(value).alias("new"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return j.select(key, "old", "new", kind.alias("change"))


def ring(nodes: DataFrame, group: str, key: str) -> DataFrame:
    """Sorted nodes cut at the middle: segment_a, the turn, segment_b."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(group)), F.row_number().over(Window.partitionBy(group).orderBy(key))
    mid = F.floor(F.col("_n") / 2)
    return nodes.withColumns({"_n": n, "_i": i - 1}).withColumn("part", F.when(F.col("_i") < mid, "segment_a").when(F.col("_i") == mid, "u_turn").otherwise("segment_b")).drop("_n", "_i")


def reached(start: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, depth): what is within ``most`` hops of start (id), each node once with its least number of hops. A frontier
    of new nodes alone goes through each round, so the work follows nodes and edges, not paths."""
    seen = frontier = stored(start.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    for hop in range(1, most + 1):
        step = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = stored(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Nodes that an export holds at most, hops that it may ask for.
EXPORT_NODES, EXPORT_HOPS = 1_000, 10


def export(nodes: DataFrame | None, edges: DataFrame | None, scope: str, root: str, depth: int = 3, signal: str = "", most: int = EXPORT_NODES) -> tuple[DataFrame | None, DataFrame | None, dict]:
    """Nodes (id, label, type), edges (id, source, target, label) and metadata of a part of the graph.

    ``nodes`` (id, name, type), ``edges`` (src, dst, type). Scopes: ``chip``, the root, what it instantiates and the
    signals that their ports meet, by child; ``module``, the root, its ports and their signals; ``signal``, what ports
    of the root whose name contains ``signal`` reach over connections in ``depth`` hops (1 to 10). Beyond ``most``
    nodes those of highest degree stay, ties by id. Without a graph the export is empty and says so. A wrong scope, no root, or no
    signal where one is needed is a ValueError."""
    if scope not in ("chip", "module", "signal") or not root or (scope == "signal" and not signal):
        raise ValueError("scope must be chip, module or signal, with a root, and a signal filter for signal")
    depth = max(1, min(depth, EXPORT_HOPS))
    meta = {"scope": scope, "root_module": root, "depth": depth, "node_count": 0, "edge_count": 0, "fallback": nodes is None or edges is None, "truncated": False}
    if meta["fallback"]:
        return None, None, meta
    of = lambda kind: edges.where(F.col("type") == kind).select("src", "dst")
    named = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.col("type").alias(f"{c}_type"))
    ports, wires = of("HAS_PORT").toDF("owner", "port"), of("CONNECTS_TO").toDF("port", "signal")
    base = nodes.where((F.col("type") == "Module") & (F.col("name") == root)).select("id")
    node = lambda df, i, label, kind: df.select(F.col(i).alias("id") if isinstance(i, str) else i.alias("id"), label.alias("label"), kind.alias("type"))
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("label"))
    module, port, sig = (F.lit(x) for x in ("Module", "Port", "Signal"))
    if scope == "chip":
        child = of("INSTANTIATES").join(base.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("child")).distinct().join(named("child"), "child")
        met = child.join(ports, child["child"] == ports["owner"]).join(wires, "port").join(named("signal"), "signal")
        own = F.concat("child_name", F.lit("."), "signal_name")
        # No children, no rows: the root stands only beside a child.
        out = node(child.limit(1), F.lit(root), F.lit(root), module).unionByName(node(child, "child_name", F.col("child_name"), module)).unionByName(node(met, own, F.col("signal_name"), sig))
        lines = edge(child, F.lit(root), F.col("child_name"), "INSTANTIATES").unionByName(edge(met, F.col("child_name"), own, "CONNECTS_TO"))
    elif scope == "module":
        has = ports.join(base.select(F.col("id").alias("owner")), "owner", "left_semi").join(named("port"), "port")
        met = has.join(wires, "port").join(named("signal"), "signal")
        p, s = (F.concat(F.lit(f"{root}."), c) for c in ("port_name", "signal_name"))
        out = node(has.limit(1), F.lit(root), F.lit(root), module).unionByName(node(has, p, F.col("port_name"), port)).unionByName(node(met, s, F.col("signal_name"), sig))
        lines = edge(has, F.lit(root), p, "HAS_PORT").unionByName(edge(met, p, s, "CONNECTS_TO"))
    else:
        has = ports.join(base.select(F.col("id").alias("owner")), "owner", "left_semi").join(named("port"), "port").where(F.contains("port_name", F.lit(signal)))
        has = stored(has.join(wires.select("port").distinct(), "port", "left_semi").select("owner", "port").distinct(), "ports")
        hops = reached(has.select(F.col("port").alias("id")), wires.toDF("src", "dst"), depth)
        walked = wires.join(hops.where(F.col("depth") < depth).select(F.col("id").alias("port")), "port", "left_semi")
        ids = hops.select("id").unionByName(has.select(F.col("owner").alias("id"))).distinct()
        out = ids.join(nodes, "id").select(F.col("name").alias("id"), F.col("name").alias("label"), "type")
        pairs = edge(has, F.col("owner"), F.col("port"), "HAS_PORT").unionByName(edge(walked, F.col("port"), F.col("signal"), "CONNECTS_TO"))
        lines = pairs.join(named("source"), "source").join(named("target"), "target").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "label")
    out = stored(out.groupBy("id").agg(F.min_by("label", "type").alias("label"), F.min("type").alias("type")), "export")
    lines = stored(lines.distinct(), "export")
    meta["node_count"] = out.count()
    if meta["node_count"] > most:
        meta |= {"truncated": True, "node_count": most}
        degree = degrees(lines.select(F.col("source").alias("src"), F.col("target").alias("dst")))
        out = stored(out.join(degree, "id", "left").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id").limit(most).drop("degree"), "export")
        for end in ("source", "target"):
            lines = lines.join(out.select(F.col("id").alias(end)), end, "left_semi")
        lines = stored(lines, "export")
    meta["edge_count"] = lines.count()
    name = F.concat(F.lit("e"), F.hex(F.xxhash64("source", "target", "label")))
    return out, lines.select(name.alias("id"), "source", "target", "label"), meta
