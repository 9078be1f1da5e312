"""Root-cause candidates: upstream paths, scores, silent bottlenecks, ranks, fault trees.

Every operator takes `by`, the incident keys of its tables; a rank, a maximum or a limit holds within an incident.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..sources.shared import cut, shared_dir
from .incidents import beside, everywhere, keys, packed, unpacked

CANDIDATE = ("service", "confidence", "error_rate", "latency_z_score", "traversal_depth", "evidence", "components")


def _text(path: str = "path") -> Column:
    return F.array_join(path, "\x01")


def upstream_paths(edges: DataFrame, start: DataFrame | str, max_depth: int = 5, infra_depth: int = 2, max_paths: int = 200, types: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """path_no, path (of each incident): acyclic predecessor paths from the start service, each as long as it can be.

    edges: src, dst and, if there are kinds, edge_type (default CALLS). A path has at most max_depth calls and
    infra_depth other edges; types keeps some kinds only. Of more than max_paths the shortest stay, ties by their text;
    a warning tells of it. start: a name, or a table of names (without by: one column, whose paths are numbered together).

    Paths grow level by level, all incidents at once. Where a level holds more than max_paths of an incident, those that can't
    rank any more are dropped, exactly: all of them once enough shorter ones have ended, and in graphs of calls alone a path that
    can't end before the last level, if enough others stand before it by their text, since each of those ends no later.
    """
    kind = F.coalesce("edge_type", F.lit("CALLS")) if "edge_type" in edges.columns else F.lit("CALLS")
    k = keys(by)
    e = packed(edges, by).select(*k, "src", "dst", kind.alias("kind")).distinct()
    e = cut(e.filter(F.col("kind").isin(types)) if types else e)
    ends = e.select(*k, F.col("src").alias("service")).union(e.select(*k, "dst")).distinct()
    first = everywhere(start, e, by).join(ends, [*k, "service"], "left_semi").distinct()
    now = first.select(*k, F.array("service").alias("path"), F.lit(0).alias("calls"), F.lit(0).alias("others"))
    done, bound = None, None
    for level in range(max_depth + infra_depth + 1):
        step = now.withColumn("dst", F.element_at("path", -1)).join(e, [*k, "dst"]).filter(~F.array_contains("path", F.col("src")))
        call = F.col("kind") == "CALLS"
        step = step.filter((call & (F.col("calls") < max_depth)) | (~call & (F.col("others") < infra_depth)))
        grown = cut(step.select(*k, F.array_append("path", F.col("src")).alias("path"), (F.col("calls") + call.cast("int")).alias("calls"), (F.col("others") + (~call).cast("int")).alias("others")), "paths")
        parents = grown.select(*k, F.slice("path", 1, level + 1).alias("path")).distinct()
        ended = now.join(parents, [*k, "path"], "left_anti").filter(F.size("path") > 1).select(*k, "path")
        done = ended if done is None else done.union(ended)
        most = grown.groupBy(*k).count().agg(F.max("count")).first()[0]
        if not most:
            break
        now = grown
        if most > max_paths:
            bound = _bound(e, max_depth, k) if bound is None else bound
            now = cut(_ranking(grown, done, bound, level + 1, max_depth, max_paths, k), "paths")
    order = (F.size("path"), _text())
    best = done.distinct()
    best = best if by else best.orderBy(*order).limit(max_paths + 1)
    best = best.withColumn("path_no", F.row_number().over(Window.partitionBy(*k).orderBy(*order))).filter(F.col("path_no") <= max_paths + 1)
    out = cut(unpacked(best.select(*k, "path_no", "path"), by))
    if out.filter(F.col("path_no") > max_paths).head(1):
        warnings.warn(f"more than {max_paths} paths: the shortest were kept", stacklevel=2)
    return out.filter(F.col("path_no") <= max_paths)


def _bound(e: DataFrame, depth: int, k: list[str]) -> DataFrame | None:
    """dst, level: where a path of `level` edges ends at dst, it can't but go on to the last level. None if not all edges are calls.

    A path of n edges goes on if its last node has more callers than the n nodes before it.
    """
    if e.filter("kind <> 'CALLS'").head(1):
        return None
    callers = e.filter("src <> dst").groupBy(*k, "dst").agg(F.count("*").alias("callers"))
    levels = [cut(callers.filter(F.col("callers") >= depth).select(*k, "dst", F.lit(depth - 1).alias("level")), "bound")]
    for level in range(depth - 2, -1, -1):
        sure = levels[-1].select(*k, F.col("dst").alias("src"), F.lit(True).alias("sure"))
        all_sure = e.filter("src <> dst").join(sure, [*k, "src"], "left").groupBy(*k, "dst").agg(F.count("*").alias("callers"), F.count("sure").alias("sure"))
        levels.append(cut(all_sure.filter((F.col("callers") >= level + 1) & (F.col("callers") == F.col("sure"))).select(*k, "dst", F.lit(level).alias("level")), "bound"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def _ranking(now: DataFrame, done: DataFrame, bound: DataFrame | None, level: int, depth: int, most: int, k: list[str]) -> DataFrame:
    """Of the paths of a level those that something of the first most + 1 may still come from."""
    n_done = done.groupBy(*k).agg(F.count("*").alias("ended"))
    n_done = now.select(*k).distinct().join(n_done, k, "left") if k else n_done
    held = now.join(n_done, k) if k else now.crossJoin(F.broadcast(n_done))  # one row
    held = held.withColumn("before", F.coalesce("ended", F.lit(0)) + F.row_number().over(Window.partitionBy(*k).orderBy(_text())) - 1)
    open_ = F.coalesce("ended", F.lit(0)) <= most
    if bound is None:
        return held.filter(open_).select(now.columns)
    if level == depth:  # nothing goes on from here
        sure = held.withColumn("sure", F.lit(True))
    else:
        at = bound.filter(F.col("level") == level).select(*k, "dst", F.lit(True).alias("sure"))
        sure = held.withColumn("dst", F.element_at("path", -1)).join(at, [*k, "dst"], "left")
    return sure.filter(open_ & (F.col("sure").isNull() | (F.col("before") <= most))).select(now.columns)


def candidates(paths: DataFrame, start: DataFrame | str, by: Sequence[str] = (), incidents: DataFrame | None = None) -> DataFrame:
    """service, depth: those on any path and the start; depth is the place in the first path that holds it.

    With by, a start that is a name holds for all incidents of `incidents` (default: those that have paths).
    """
    p, k = packed(paths, by), keys(by)
    on = p.select(*k, "path_no", F.posexplode("path").alias("depth", "service")).groupBy(*k, "service").agg(F.min_by("depth", "path_no").alias("depth"))
    me = everywhere(start, packed(incidents, by) if incidents is not None and by else p, by).withColumn("depth", F.lit(0))
    return unpacked(on.unionByName(me).groupBy(*k, "service").agg(F.min("depth").alias("depth")), by)


def _weights(only_error: Column, only_latency: Column) -> list[Column]:
    pick = lambda a, b, c: F.when(only_error, a).when(only_latency, b).otherwise(c)
    return [pick(0.50, 0.15, 0.35).alias("w_error"), pick(0.15, 0.50, 0.35).alias("w_latency"), pick(0.20, 0.20, 0.15).alias("w_alerts"), F.lit(0.10).alias("w_volume")]


def adaptive_weights(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """w_error, w_latency, w_alerts, w_volume by the kinds of alerts; one row, or one for each incident that has alerts."""
    t = F.lower(F.coalesce("anomaly_type", F.lit("")))
    has = packed(alerts, by).groupBy(*keys(by)).agg(F.coalesce(F.bool_or(t.contains("error")), F.lit(False)).alias("e"), F.coalesce(F.bool_or(t.contains("latency")), F.lit(False)).alias("l"))
    return unpacked(has.select(*keys(by), *_weights(F.col("e") & ~F.col("l"), F.col("l") & ~F.col("e"))), by)


def score_candidates(cands: DataFrame, nodes: DataFrame, baselines: DataFrame, alerts: DataFrame, spans: DataFrame | None = None, colocated: DataFrame | None = None, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Candidates (service, depth) with their confidence, evidence and components.

    The latency term compares the full mean with the baseline. spans: where a node's error rate or mean is 0 they
    are taken from them. colocated: src, dst of pairs on one machine; a candidate with an alerted neighbour gets an
    infra term of 0.3 * 0.10 and 0.9 of the others. An incident without alerts has the weights of neither kind.
    """
    k = keys(by)
    given = weights if weights is not None else adaptive_weights(alerts, by)
    cands, nodes, baselines, alerts, weights = (packed(x, by) for x in (cands, nodes, baselines, alerts, given))
    n = nodes.select(*k, F.col("id").alias("service"), "error_rate", F.col("duration_mean_ms").alias("mean"), "span_count")
    top = nodes.groupBy(*k).agg(F.coalesce(F.max("span_count"), F.lit(1)).alias("top"))
    by_service = alerts.groupBy(*k, "service").agg(F.max("score").alias("alert"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "anomaly_type"))), lambda x: x["anomaly_type"]), 1, 2).alias("kinds"))
    c = cands.join(n, [*k, "service"], "left").fillna({"error_rate": 0.0, "mean": 0.0, "span_count": 0})
    if spans is not None:
        s = packed(spans, by).groupBy(*k, F.col("service_name").alias("service")).agg(rounded(F.count_if("has_error") / F.count("*"), 4).alias("s_err"), rounded(F.avg("duration_ms"), 3).alias("s_mean"))
        c = c.join(s, [*k, "service"], "left").withColumn("error_rate", F.coalesce(F.nullif("error_rate", F.lit(0.0)), "s_err", F.lit(0.0))).withColumn("mean", F.coalesce(F.nullif("mean", F.lit(0.0)), "s_mean", F.lit(0.0)))
    c = c.join(baselines.select(*k, "service", "ewma_mean", "ewma_std"), [*k, "service"], "left").join(by_service, [*k, "service"], "left")
    c = beside(beside(c, top, by), weights, by).fillna({"w_error": 0.35, "w_latency": 0.35, "w_alerts": 0.15, "w_volume": 0.10, "top": 1})
    if colocated is not None:
        alerted = alerts.select(*k, F.col("service").alias("dst")).distinct()
        near = packed(colocated, by).join(alerted, [*k, "dst"], "left_semi").select(*k, F.col("src").alias("service")).distinct().withColumn("near", F.lit(True))
        c = c.join(near, [*k, "service"], "left").withColumn("infra", F.when(F.col("near"), F.lit(0.3)).otherwise(F.lit(0.0)))
    else:
        c = c.withColumn("infra", F.lit(0.0))
    base, std = F.coalesce("ewma_mean", "mean"), F.coalesce("ewma_std", F.lit(0.0))
    z = F.when(std <= 0.001, F.when(F.abs(F.col("mean") - base) > 0.001, F.lit(10.0)).otherwise(F.lit(0.0))).otherwise(rounded(F.try_divide(F.col("mean") - base, std), 3))
    c = c.withColumn("z", z).withColumn("alert", F.coalesce("alert", F.lit(0.0)))
    err = F.least(F.lit(1.0), F.col("error_rate") * 3)
    lat = F.when(F.abs("z") > 2, F.least(F.lit(1.0), F.abs("z") / 10)).otherwise(F.lit(0.0))
    vol = F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("span_count") / F.col("top"))).otherwise(F.lit(0.0))
    deep = F.least(F.lit(0.15), F.col("depth") * 0.03)
    mixed = F.col("w_error") * err + F.col("w_latency") * lat + F.col("w_alerts") * F.col("alert") + F.col("w_volume") * vol
    total = F.when(F.col("infra") > 0, mixed * 0.9 + deep + 0.1 * F.col("infra")).otherwise(mixed + deep)
    parts = {"error": err, "latency": lat, "alerts": F.col("alert"), "volume": vol, "depth_boost": deep, "infra": F.col("infra")}
    evidence = F.array_compact(F.array(
        F.when(F.col("error_rate") > 0, F.format_string("Error rate=%.1f%%", F.col("error_rate") * 100)),
        F.when(F.abs("z") > 0, F.format_string("Latency mean=%.1fms (baseline=%.1f±%.1f), z=%.2f", "mean", base, std, "z")),
        F.when(F.size(F.coalesce("kinds", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Alerts: "), F.array_join("kinds", ", "))),
        F.when(F.col("depth") > 0, F.concat(F.lit("Upstream depth="), F.col("depth").cast("string"))),
    ))
    out = c.select(*k, "service", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("confidence"), rounded(F.col("error_rate"), 4).alias("error_rate"), F.col("z").alias("latency_z_score"), F.col("depth").cast("int").alias("traversal_depth"), evidence.alias("evidence"), F.struct(*(rounded(v, 4).alias(name) for name, v in parts.items())).alias("components"))
    return unpacked(out, by)


def silent_bottlenecks(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """parent, child, absorption, child_error_rate, verdict of call edges that take most of the parent's mean time."""
    k = keys(by)
    n = packed(nodes, by).select(*k, "id", "duration_mean_ms", "error_rate")
    e = packed(edges, by).select(*k, "src", "dst", "avg_duration_ms").join(n.select(*k, F.col("id").alias("src"), F.col("duration_mean_ms").alias("mean")), [*k, "src"]).join(n.select(*k, F.col("id").alias("dst"), F.coalesce("error_rate", F.lit(0.0)).alias("err")), [*k, "dst"])
    e = e.filter("mean > 0 AND avg_duration_ms > 0").withColumn("a", F.least(F.lit(1.5), F.col("avg_duration_ms") / F.col("mean")))
    verdict = F.when((F.col("a") >= 0.75) & (F.col("err") < 0.05), F.lit("SILENT_BOTTLENECK")).when(F.col("a") >= 0.6, F.lit("POSSIBLE_BOTTLENECK"))
    out = e.select(*k, F.col("src").alias("parent"), F.col("dst").alias("child"), rounded(F.col("a"), 3).alias("absorption"), rounded(F.col("err"), 4).alias("child_error_rate"), verdict.alias("verdict"))
    return unpacked(out.filter("verdict IS NOT NULL"), by)


def boost_silent(cands: DataFrame, bottlenecks: DataFrame, factor: float = 1.15, by: Sequence[str] = ()) -> DataFrame:
    """Candidates that are a silent bottleneck gain by the factor, up to 1, and say so."""
    k = keys(by)
    hit = packed(bottlenecks, by).filter("verdict = 'SILENT_BOTTLENECK'").groupBy(*k, F.col("child").alias("service")).agg(F.max("absorption").alias("a"))
    c = packed(cands, by).join(hit, [*k, "service"], "left")
    note = F.format_string("Silent bottleneck: absorption=%.2f", "a")
    c = c.withColumn("confidence", F.when(F.col("a").isNotNull(), rounded(F.least(F.lit(1.0), F.col("confidence") * factor), 4)).otherwise(F.col("confidence"))).withColumn("evidence", F.when(F.col("a").isNotNull(), F.array_append("evidence", note)).otherwise(F.col("evidence"))).drop("a")
    return unpacked(c, by)


def rank(cands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Candidates with a rank from 1 by confidence; ties by service. A window holds one row for each service of an incident."""
    return unpacked(packed(cands, by).withColumn("rank", F.row_number().over(Window.partitionBy(*keys(by)).orderBy(F.desc("confidence"), "service"))), by)


def reorder(cands: DataFrame, order: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranked candidates, those that order (service, pos) names first, the rest as they were."""
    k = keys(by)
    o = packed(order, by).groupBy(*k, "service").agg(F.min("pos").alias("pos"))
    c = packed(cands, by).join(o, [*k, "service"], "left")
    return unpacked(c.withColumn("rank", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("pos").asc_nulls_last(), "rank"))).drop("pos"), by)


def apply_deltas(cands: DataFrame, deltas: DataFrame, parity: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Confidence plus delta within 0 and 1, ranked anew. deltas: service, delta, first (puts a service at the head; parity: ignored)."""
    k = keys(by)
    d = packed(deltas, by).groupBy(*k, "service").agg(F.sum("delta").alias("delta"), F.bool_or("first").alias("first"))
    c = packed(cands, by).join(d, [*k, "service"], "left").withColumn("confidence", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("delta", F.lit(0.0)))), 4))
    lead = F.lit(0) if parity else F.when(F.coalesce("first", F.lit(False)), 0).otherwise(1)
    return unpacked(c.withColumn("rank", F.row_number().over(Window.partitionBy(*k).orderBy(lead, F.desc("confidence"), "service"))).drop("delta", "first"), by)


class _Side:
    """One side of a two-sided breadth-first search: a table of the nodes that it has reached, a part for each level."""

    COLUMNS = "node string, met boolean, f integer, g integer, level integer"

    def __init__(self, pairs: DataFrame, col: str, met: Column, edges: DataFrame, here: str, there: str):
        spark = pairs.sparkSession
        self.base, self.schema, self.n, self.size = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}", pairs.select("pair").schema, 0, 1
        for part in self.COLUMNS.split(", "):
            self.schema = self.schema.add(*part.split())
        self.edges = edges.select(F.col("by").alias("b"), F.col(here).alias("node"), F.col(there).alias("next"))
        self._add(pairs.select("pair", F.col(col).alias("node"), met.alias("met"), F.lit(0).alias("f"), F.lit(0).alias("g")))

    def _add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.base}/level={self.n}")
        self.front, self.n = self.reached().filter(F.col("level") == self.n), self.n + 1

    def reached(self) -> DataFrame:
        spark = self.edges.sparkSession
        return spark.read.schema(self.schema).parquet(self.base)

    def grow(self, open_pairs: DataFrame, other: _Side, ahead: bool) -> None:
        """One level more for the pairs that haven't met, marked where the other side already is."""
        now = self.front.join(open_pairs, "pair", "left_semi").withColumn("b", F.col("pair")["by"])
        step = now.join(self.edges, ["b", "node"]).select("pair", F.col("next").alias("node")).distinct()
        step = step.join(self.reached().select("pair", "node"), ["pair", "node"], "left_anti")
        there = other.front.select("pair", "node", F.lit(True).alias("met"))
        f, g = (self.n, other.n - 1) if ahead else (other.n - 1, self.n)
        self._add(step.join(there, ["pair", "node"], "left").select("pair", "node", F.coalesce("met", F.lit(False)).alias("met"), F.lit(f).alias("f"), F.lit(g).alias("g")))


def shortest_paths(edges: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """a, b, path for each pair (a, b) that calls connect: of the fewest edges, ties by text; no row without a path, whatever its length.

    The searches of all pairs grow level by level from both ends, the smaller side first, until they meet. Rows are nodes with their level; the
    path is then walked from a, by the nodes of the next level that lead to b. Jobs grow with the longest path, not with the pairs.
    """
    one = F.struct(F.lit(0).alias("none")) if not by else F.struct(*(F.col(b).alias(b) for b in by))
    e = cut(edges.select(one.alias("by"), "src", "dst").distinct())
    p = cut(pairs.select(F.struct(one.alias("by"), "a", "b").alias("pair"), "a", "b").distinct(), "pairs")
    ahead, back = _Side(p, "a", F.col("a") == F.col("b"), e, "src", "dst"), _Side(p, "b", F.lit(False), e, "dst", "src")
    open_pairs = p.filter("a <> b").select("pair")
    while True:
        side, other = (ahead, back) if ahead.size <= back.size else (back, ahead)
        side.grow(open_pairs, other, side is ahead)
        # pairs that neither met nor came to an end
        open_pairs = side.front.groupBy("pair").agg(F.bool_or("met").alias("met")).filter("NOT met").select("pair")
        side.size = side.front.join(open_pairs, "pair", "left_semi").count()
        if not side.size:
            break
    met = cut(ahead.reached().unionByName(back.reached()).filter("met").select("pair", "node", "f", "g"), "met")
    # nodes of the first part that lead to where the sides met, from there back
    into = e.select(F.col("by").alias("b"), F.col("src").alias("node"), F.col("dst").alias("next"))
    marked: dict[int, DataFrame] = {}
    for i in range(ahead.n - 1, -1, -1):
        on = met.filter(F.col("f") == i).select("pair", "node")
        if i + 1 in marked:
            here = ahead.reached().filter(F.col("level") == i).select("pair", "node").withColumn("b", F.col("pair")["by"]).join(into, ["b", "node"])
            on = on.union(here.join(marked[i + 1].withColumnRenamed("node", "next"), ["pair", "next"], "left_semi").select("pair", "node")).distinct()
        marked[i] = cut(on, "marked")
    lengths = met.select("pair", "f", (F.col("f") + F.col("g")).alias("n")).distinct()
    walk = p.join(lengths, "pair").select("pair", "f", "n", F.col("a").alias("node"), F.array("a").alias("path"))
    rest = back.reached().select("pair", F.col("node").alias("next"), "level")
    for i in range(ahead.n + back.n - 2):
        step = walk.filter(F.col("n") > i).withColumn("b", F.col("pair")["by"]).join(into, ["b", "node"]).drop("node", "b")
        on = step.filter(F.col("f") <= i).withColumn("level", F.col("n") - i - 1).join(rest, ["pair", "next", "level"], "left_semi").drop("level")
        if i + 1 in marked:
            on = on.unionByName(step.filter(F.col("f") > i).join(marked[i + 1].withColumnRenamed("node", "next"), ["pair", "next"], "left_semi"))
        least = on.groupBy("pair", "f", "n", "path").agg(F.min("next").alias("node")).withColumn("path", F.array_append("path", F.col("node")))
        walk = cut(walk.filter(F.col("n") <= i).unionByName(least), "walk")
    return walk.select(*(F.col("pair")["by"][b].alias(b) for b in by), F.col("pair")["a"].alias("a"), F.col("pair")["b"].alias("b"), "path")


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """path from a to b along calls, of fewest edges, ties by text; no row without one."""
    return shortest_paths(edges, edges.sparkSession.createDataFrame([(a, b)], "a string, b string")).select("path")


def fault_tree(cands: DataFrame, edges: DataFrame, service: DataFrame | str, top: int = 5, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """nodes (service) and edges (src, dst): the first candidates, the error service, the call chain from the first to it, and calls among them."""
    k = keys(by)
    c = packed(cands, by)
    error = everywhere(service, c, by)
    first = c.filter("rank = 1").select(*k, F.col("service").alias("a"))
    pairs = first.join(error.select(*k, F.col("service").alias("b")), k) if by else first.crossJoin(F.broadcast(error.select(F.col("service").alias("b"))))  # one row each
    chain = packed(shortest_paths(edges, unpacked(pairs, by), by), by)
    nodes = c.filter(F.col("rank") <= top).select(*k, "service").union(error.select(*k, "service")).union(chain.select(*k, F.explode("path")))
    nodes = cut(nodes.distinct())
    inner = packed(edges, by).select(*k, "src", "dst").join(nodes.withColumnRenamed("service", "src"), [*k, "src"], "left_semi").join(nodes.withColumnRenamed("service", "dst"), [*k, "dst"], "left_semi").select(*k, "src", "dst")
    links = chain.select(*k, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.element_at("path", i).alias("src"), F.try_element_at("path", i + 1).alias("dst")))).alias("x")).select(*k, "x.*").filter("dst IS NOT NULL")
    return unpacked(nodes, by), unpacked(inner.union(links).distinct(), by)


def pick_start(ranks: DataFrame, errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """service: of the error services the one of highest rank; ties by name."""
    k = keys(by)
    own = packed(ranks, by).join(packed(errors, by).select(*k, F.col("service").alias("id")).distinct(), [*k, "id"], "left_semi")
    return unpacked(own.groupBy(*k).agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("service")), by)
