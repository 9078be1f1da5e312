"""The service graph: edges (src, dst, ...), nodes (id, ...), ranks, cycles, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled, rounded
from ..sources.shared import cut
from .incidents import beside, by_incident, keys, packed, unpacked

NODE_STATS = ("span_count", "error_count", "error_rate", "unknown_response_pct", "duration_mean_ms", "duration_p50_ms", "duration_p95_ms", "duration_p99_ms", "duration_std_ms", "duration_min_ms", "duration_max_ms", "operations")


#: Edges and nodes of a graph whose PageRank is one job; steps of a search between two tables that are written; nodes of a graph all of whose pairs are listed.
SMALL, HOPS, FEW = 20_000, 3, 100


@by_incident
def call_edges(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """src, dst, call_count, avg_duration_ms, total_duration_ms, error_count, error_rate, operations of calls between services.

    A parent is looked up by its span id alone; of several spans with the id the last one counts. Errors are flagged
    spans only, unlike those of service_stats.
    """
    service = F.coalesce(filled(F.col("service_name")), F.lit("unknown"))
    parents = spans.filter(filled(F.col("span_id")).isNotNull()).groupBy(*by, F.trim("span_id").alias("p_id")).agg(F.max_by(service, F.col("ingest_seq")).alias("src"))
    calls = spans.select(*by, F.trim("parent_span").alias("p_id"), service.alias("dst"), "duration_ms", "has_error", filled(F.col("operation_name")).alias("op")).filter("p_id <> '' AND p_id <> 'ROOT'")
    g = calls.join(parents, [*by, "p_id"]).filter("src <> dst").groupBy(*by, "src", "dst", "op")
    # exact sums by operation first, so that sets are made of few rows
    e = g.agg(F.count("*").alias("call_count"), F.sum(F.coalesce("duration_ms", F.lit(0.0)).cast("decimal(20,3)")).alias("total"), F.count_if(F.coalesce("has_error", F.lit(False))).alias("error_count"))
    e = e.groupBy(*by, "src", "dst").agg(F.sum("call_count").alias("call_count"), F.sum("total").alias("total"), F.sum("error_count").alias("error_count"), F.array_sort(F.collect_set("op")).alias("operations"))
    return e.select(*by, "src", "dst", "call_count", rounded(F.col("total").cast("double") / F.col("call_count"), 2).alias("avg_duration_ms"), F.round("total", 2).cast("double").alias("total_duration_ms"), "error_count", rounded(F.col("error_count") / F.col("call_count"), 4).alias("error_rate"), "operations")


@by_incident
def service_nodes(edges: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """id, node_type and the statistics; services that only one of the two tables knows stay, with zeros."""
    ends = edges.select(*by, F.col("src").alias("id")).union(edges.select(*by, "dst")).distinct()
    s = stats.select(*by, F.col("service").alias("id"), *NODE_STATS)
    zero = {c: 0 for c in NODE_STATS if c != "operations"}
    return ends.join(s, [*by, "id"], "full").fillna(zero).withColumn("node_type", F.lit("service"))


def column_call_graph(df: DataFrame, fixed: bool = False) -> DataFrame:
    """Edges between the first column named like a parent or caller and the first named like a service or child.

    On a table of spans that is parent span id -> service; fixed: see call_edges for service -> service.
    """
    if fixed:
        return call_edges(df).select("src", "dst")
    find = lambda words: next((c for c in df.columns if any(w in c.lower() for w in words)), None)
    a, b = find(("parent", "caller")), find(("service", "child"))
    if a is None or b is None:
        raise ValueError("no columns that name caller and callee")
    return df.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")).dropna().filter("src <> dst").distinct()


def _reaches(e: DataFrame, n: int) -> DataFrame:
    """src, dst of all pairs of a graph of n nodes, few, of which one reaches the other; each step doubles the length of the walks."""
    pairs, length = e, 1
    while length < n:
        further = pairs.withColumnRenamed("dst", "mid").join(pairs.withColumnRenamed("src", "mid"), "mid").select("src", "dst")
        pairs, length = cut(pairs.union(further).distinct().coalesce(1), "reach"), 2 * length  # n * n rows at most
    return pairs


def strong_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, component (its least node) for each node that lies on a cycle.

    In a graph of `few` nodes at most, as counted once its edges are written, all pairs of which one reaches the other are listed. In
    larger ones first nodes that nothing enters or leaves are dropped, and of nodes with one caller and one callee those whose hash is least among
    such neighbours are passed over (the caller calls the callee), until neither changes anything: chains shrink by a share in each
    round, and vanish. In what is left the greatest name that reaches a node colours it; of a colour, what reaches the node of that
    name is a component; the rest is coloured again. Nodes that were passed over belong where both their neighbours do.
    """
    e = cut(edges.select("src", "dst").distinct(), "edges")
    size = e.select("src").union(e.select("dst")).distinct().count()
    if size <= few:
        pairs = _reaches(e, size)
        both = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
        return both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    found = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e, passed, n = e.filter("src <> dst"), [], None
    while True:
        some_in, some_out = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = cut(e.join(some_in, "src", "left_semi").join(some_out, "dst", "left_semi").select("src", "dst"), "edges")
        into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("src")).filter("n = 1").drop("n")
        out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1").drop("n")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(passed)), F.col(c)), F.col(c))  # noqa: B023, E731
        thin = into.join(out, "node").withColumn("h", order("node"))
        near = lambda c: thin.select(F.col("node").alias(c), F.col("h").alias(f"h_{c}"))  # noqa: B023, E731
        least = thin.join(near("src"), "src", "left").join(near("dst"), "dst", "left").filter("(h_src IS NULL OR h < h_src) AND (h_dst IS NULL OR h < h_dst)")
        gone = cut(least.select("node", "src", "dst"), "passed")
        before, n = n, e.count()
        n_gone = gone.count()
        if n == before and not n_gone:
            break
        if n_gone:
            ends = gone.select(F.col("node").alias("x"))
            left = e.join(ends, F.col("src") == F.col("x"), "left_anti").join(ends, F.col("dst") == F.col("x"), "left_anti")
            passed.append(gone)
            found = found.union(gone.filter("src = dst").select(F.col("src"), F.col("src")))
            e = left.union(gone.filter("src <> dst").select("src", "dst")).distinct()
    while n:
        colour = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node"))
        while True:
            new = colour
            for _ in range(HOPS):
                sent = e.join(new.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
                new = new.union(sent).groupBy("node").agg(F.max("colour").alias("colour"))
            new, old = cut(new, "colours"), colour
            colour = new
            if not new.join(old.withColumnRenamed("colour", "old"), "node").filter("colour <> old").head(1):
                break
        inner = e.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").filter("colour = c").select("src", "dst", "colour")
        inner = cut(inner, "edges")
        comp, n_comp = colour.filter("node = colour"), 0
        while True:
            for _ in range(HOPS):
                comp = comp.union(inner.join(comp.withColumnRenamed("node", "dst"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour")).distinct()
            comp = cut(comp, "component")
            before, n_comp = n_comp, comp.count()
            if n_comp == before:
                break
        names = comp.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
        found = found.union(comp.join(names, "colour").select("node", "component"))
        e = cut(inner.join(comp.withColumnRenamed("node", "src"), "src", "left_anti").join(comp.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
        n = e.count()
    found = cut(found.groupBy("node").agg(F.min("component").alias("component")), "components")
    for gone in reversed(passed):
        at = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))  # noqa: B023, E731
        back = gone.join(at("src"), "src").join(at("dst"), "dst").filter("c_src = c_dst").select("node", F.col("c_src").alias("component"))
        found = cut(found.union(back), "components")
    least = found.groupBy("component").agg(F.min("node").alias("least"))  # nodes that were passed over may be smaller
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """cycle: every simple cycle once, from its smallest node; max_len: those of so many nodes at most.

    Only edges within a strong component are followed, so that what lies on no cycle makes no path.
    """
    all_edges = edges.select("src", "dst").distinct()
    parts = cut(strong_components(all_edges), "components")
    at = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    e = cut(all_edges.join(at("src"), "src").join(at("dst"), "dst").filter("c_src = c_dst").select("src", "dst"), "edges")
    found = e.filter("src = dst").select(F.array("src").alias("cycle"))
    paths = e.filter("src < dst").select(F.array("src", "dst").alias("path"), F.lit(False).alias("closed"))
    e, size = e.filter("src <> dst"), 2
    last, first = F.element_at("path", -1), F.element_at("path", 1)
    while max_len is None or size <= max_len:
        # HOPS steps between two tables that are written; a path that has closed stays as it is
        for _ in range(HOPS if max_len is None else min(HOPS, max_len - size + 1)):
            step = paths.join(e, ~F.col("closed") & (last == F.col("src")), "left")
            step = step.filter("closed OR dst IS NOT NULL").withColumn("closes", F.col("closed") | (F.col("dst") == first))
            step = step.filter(F.col("closes") | ((F.col("dst") > first) & ~F.array_contains("path", F.col("dst"))))
            paths = step.select(F.when(F.col("closes"), F.col("path")).otherwise(F.array_append("path", F.col("dst"))).alias("path"), F.col("closes").alias("closed"))
            size += 1
        paths = cut(paths, "paths")
        found = found.union(paths.filter("closed").select(F.col("path").alias("cycle")))
        paths = paths.filter("NOT closed")
        if not paths.head(1):
            break
    return found


def pagerank(edges: DataFrame, alpha: float = 0.85, weight: str | None = None, restart: DataFrame | None = None, tol: float = 1e-6, max_iter: int = 100, nodes: DataFrame | None = None, every: int = 3, small: int = SMALL, by: Sequence[str] = ()) -> DataFrame:
    """id, score, scores (of each incident) sum to 1.

    weight: a column of edges (default 1). restart: id; its nodes share the restart mass, else all do. Nodes without
    edges out spread theirs by the restart shares. A graph's scores stand once they have changed by less than its nodes * tol in all.
    Each `every`-th round is written to the shared folder and looked at; graphs that stand leave the rounds. Graphs of up to `small`
    edges and nodes, as counted once they are written, are a row each instead, and all rounds of all of them one job.
    """
    k = keys(by)
    e = packed(edges, by).select(*k, "src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    ids = e.select(*k, F.col("src").alias("id")).union(e.select(*k, "dst"))
    ids = (ids.unionByName(packed(nodes, by).select(*k, "id")) if nodes is not None else ids).distinct()
    out = e.groupBy(*k, "src").agg(F.sum("w").alias("total"))
    e = cut(e.join(out, [*k, "src"]).select(*k, "src", "dst", (F.col("w") / F.col("total")).alias("share")))
    ids = cut(ids.join(out.select(*k, F.col("src").alias("id"), F.lit(True).alias("sends")), [*k, "id"], "left"))
    marks = packed(restart, by).select(*k, "id").distinct().withColumn("mark", F.lit(1.0)) if restart is not None else ids.limit(0).select(*k, "id", F.lit(1.0).alias("mark"))
    ids = ids.join(marks, [*k, "id"], "left")
    size = ids.groupBy(*k).agg(F.count("*").alias("n"), F.count("mark").alias("m"))
    jump = F.when(F.col("m") > 0, F.coalesce("mark", F.lit(0.0)) / F.col("m")).otherwise(1 / F.col("n"))
    rank = cut(beside(ids, size, by).select(*k, "id", F.coalesce("sends", F.lit(False)).alias("sends"), jump.alias("jump"), (1 / F.col("n")).alias("score"), (F.col("n") * tol).alias("least")))
    nodes_and_edges = rank.select(*k).union(e.select(*k)).groupBy(*k).agg(F.count("*").alias("n")) if k else rank.select("least").union(e.select("share")).agg(F.count("*").alias("n"))
    most = nodes_and_edges.agg(F.max("n")).first()[0]
    if not most:
        return unpacked(rank.select(*k, "id", "score"), by)
    if most <= small:
        return unpacked(_folded(e, rank, alpha, max_iter, k), by)
    standing = None
    for i in range(max_iter):
        lost = rank.groupBy(*k).agg(F.sum(F.when(~F.col("sends"), F.col("score")).otherwise(F.lit(0.0))).alias("lost"))
        got = e.join(rank.select(*k, F.col("id").alias("src"), "score"), [*k, "src"]).groupBy(*k, F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = beside(rank.join(got, [*k, "id"], "left"), lost, by)
        new = new.select(*k, "id", "sends", "jump", F.col("score").alias("old"), (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump")) + (1 - alpha) * F.col("jump")).alias("score"), "least")
        if i % every < every - 1 and i < max_iter - 1:
            rank = new.drop("old")
            continue
        new = cut(new, "rank")
        still = new.groupBy(*k).agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("apart"), F.first("least").alias("least")).filter("apart >= least").select(*k)
        rank = new.drop("old")
        if not still.head(1):
            break
        if k and i < max_iter - 1:
            stands = rank.join(still, k, "left_anti").select(*k, "id", "score")
            standing = stands if standing is None else standing.union(stands)
            rank = cut(rank.join(still, k, "left_semi"), "rank")
    rank = rank.select(*k, "id", "score")
    return unpacked(rank if standing is None else rank.union(standing), by)


def _folded(e: DataFrame, rank: DataFrame, alpha: float, rounds: int, k: list[str]) -> DataFrame:
    """The rounds of pagerank over small graphs: for each an array of nodes, each with the places and shares of those that send to it."""
    places = cut(rank.withColumn("i", F.row_number().over(Window.partitionBy(*k).orderBy("id")) - 1), "places")
    at = lambda c, name: places.select(*k, F.col("id").alias(c), F.col("i").alias(name))
    into = e.join(at("src", "s"), [*k, "src"]).join(at("dst", "i"), [*k, "dst"]).groupBy(*k, "i").agg(F.array_sort(F.collect_list(F.struct("s", "share"))).alias("into"))
    node = F.struct("i", "id", "jump", "sends", "score", F.coalesce("into", F.array().cast("array<struct<s:int,share:double>>")).alias("into"))
    one = places.join(into, [*k, "i"], "left").groupBy(*k).agg(F.array_sort(F.collect_list(node)).alias("g"), F.max("least").alias("least"))
    # sums of lambdas over places: what nodes without edges out hold, and how far two rounds are apart
    lost = lambda scores: F.aggregate("g", F.lit(0.0), lambda a, x: a + F.when(x["sends"], F.lit(0.0)).otherwise(F.get(scores, x["i"])))
    apart = lambda new, old: F.aggregate(F.zip_with(new, old, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)

    def step(acc: Column, _: Column) -> Column:
        got = lambda x: F.aggregate(x["into"], F.lit(0.0), lambda a, y: a + y["share"] * F.get(acc["score"], y["s"]))
        new = F.transform("g", lambda x: alpha * (got(x) + acc["lost"] * x["jump"]) + (1 - alpha) * x["jump"])
        made = F.get(F.transform(F.array(new), lambda s: F.struct(s.alias("score"), lost(s).alias("lost"), apart(s, acc["score"]).alias("apart"))), F.lit(0))
        return F.when(acc["apart"] < F.col("least"), acc).otherwise(made)

    first = F.transform("g", lambda x: x["score"])
    begin = F.get(F.transform(F.array(first), lambda s: F.struct(s.alias("score"), lost(s).alias("lost"), F.lit(float("inf")).alias("apart"))), F.lit(0))
    final = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step, lambda acc: acc["score"])
    return cut(one.withColumn("final", final).select(*k, F.explode(F.arrays_zip(F.transform("g", lambda x: x["id"]).alias("id"), F.col("final").alias("score"))).alias("x")).select(*k, "x.id", "x.score"), "rank")


@by_incident
def fact_edges(facts: DataFrame, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """src, dst, w of facts (source, relationship, target): calls turned round, signals to services, others as they are.

    Of a repeated (src, dst) the last fact's weight holds (seq).
    """
    rel = F.col("relationship")
    turned = rel.isin("calls", "emits", "blocks")
    w = F.when(rel == "emits", weight).when(rel == "blocks", F.lit(1.5)).otherwise(F.lit(1.0))
    e = facts.select(*by, F.when(turned, F.col("target")).otherwise(F.col("source")).alias("src"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("dst"), w.alias("w"), "seq")
    return e.groupBy(*by, "src", "dst").agg(F.max_by("w", "seq").alias("w"))


@by_incident
def error_services(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """service of spans that are flagged or whose status is true, 1, error or 5."""
    bad = F.coalesce(F.col("has_error"), F.lit(False)) | F.lower(F.coalesce("status", F.lit(""))).isin("true", "1", "error", "5")
    return spans.filter(bad).select(*by, F.col("service_name").alias("service")).distinct()


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """json: the graph as nodes and links; of service graphs, which are small."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "node_type"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "call_count", "error_rate"))).alias("links"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", "links")).alias("json"))


def graph_summary(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, n_cycles: DataFrame | None = None) -> DataFrame:
    """node_count, edge_count, cycle_count, top: the five nodes of highest rank."""
    top = ranks.orderBy(F.desc("score"), "id").limit(5).agg(F.collect_list("id").alias("top"))
    loops = (n_cycles if n_cycles is not None else cycles(edges)).agg(F.count("*").alias("cycle_count"))
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(loops).crossJoin(top)
