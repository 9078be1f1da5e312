"""Cleaning and statistics of spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import failed, filled, rounded, unknown_response
from .incidents import by_incident
from .order import PLAIN, percentiles

#: Buckets in which keys are counted.
BUCKETS = 65_536
#: Columns that a table may have for dedup only: the file and the row in it, from which a span came.
ARRIVAL = ("__path", "__row")


def span_key() -> Column:
    """What makes two spans the same: trace and span id; the span id alone without a trace; seven columns without a span id.

    The seven-column key is the intended one; it takes the start time as a number.
    """
    trace, span = filled(F.col("trace_id")), filled(F.col("span_id"))
    rest = [F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("parent_span", "service_name", "operation_name", "status")]
    times = [F.coalesce(F.col("start_time"), F.lit(0)).cast("string"), F.coalesce(F.col("duration_ms"), F.lit(0.0)).cast("string")]
    return F.when(span.isNotNull(), F.array(F.lit("id"), F.coalesce(trace, F.lit("")), span)).otherwise(F.array(F.lit("row"), F.coalesce(trace, F.lit("")), *rest, *times))


def _key_columns() -> dict[str, Column]:
    """The key of span_key() as columns; the long one is made for the few spans without an id only."""
    span = filled(F.col("span_id"))
    return {"__trace": F.coalesce(filled(F.col("trace_id")), F.lit("")), "__span": F.coalesce(span, F.lit("")), "__rest": F.when(span.isNull(), F.to_json(span_key())).otherwise(F.lit(""))}


def is_crowded(spans: DataFrame) -> bool:
    """Whether a key may have over PLAIN spans: they are counted by hash of their key, in BUCKETS."""
    at = F.pmod(F.xxhash64(*_key_columns().values()), F.lit(BUCKETS))
    return (spans.groupBy(at.alias("at")).count().agg(F.max("count")).first()[0] or 0) > PLAIN


def dedup_spans(spans: DataFrame, crowded: bool = True) -> DataFrame:
    """Of the spans of a key the one that came in first (ingest_seq); among equal places the first in the files (ARRIVAL, where the table has it, which is dropped) and then the least by the other columns, so that every run and step keeps the same row.

    Rows are shuffled once, by key. Only the first place is asked for, so that each task drops its own repeats before the shuffle and a key
    that fills the table is no task's whole work. Where no key is so long (crowded: False), tasks don't sort before the shuffle; the same rows stay.
    """
    ties = [f.name for f in spans.schema if f.name != "ingest_seq" and "map<" not in f.dataType.simpleString()]  # maps have no order
    ties, kept = sorted(ties, key=lambda c: c not in ARRIVAL), [c for c in spans.columns if c not in ARRIVAL]
    k = _key_columns()
    if crowded:
        first = F.row_number().over(Window.partitionBy(*k).orderBy("ingest_seq", *ties))
        return spans.withColumns(k).withColumn("__n", first).filter("__n = 1").select(kept)
    # a hash leads the key, so that most comparisons of the sort are of two numbers
    before = F.lag(F.lit(1)).over(Window.partitionBy("__hash", *k).orderBy("ingest_seq", *ties))
    return spans.withColumns(k).withColumn("__hash", F.xxhash64(*k)).withColumn("__before", before).filter("__before IS NULL").select(kept)


def dedup_stats(raw: DataFrame) -> DataFrame:
    """original_count, unique_count, duplicates_removed."""
    n = raw.groupBy(span_key().alias("key")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original_count"), F.count("*").alias("unique_count"))
    return n.withColumn("duplicates_removed", F.col("original_count") - F.col("unique_count"))


def _missing() -> Column:
    names = ("trace_id", "span_id", "service_name")
    return F.array_compact(F.array(*(F.when(filled(F.col(c)).isNull(), F.lit(c)) for c in names)))


def validate_spans(spans: DataFrame, most_errors: int = 10) -> DataFrame:
    """is_valid, valid_count, total_count, validation_rate (100 without spans), errors: the first ones in order of arrival."""
    bad = spans.withColumn("missing", _missing()).filter(F.size("missing") > 0)
    first = bad.orderBy("ingest_seq").limit(most_errors).select("ingest_seq", "missing")
    errors = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", "missing"))), lambda e: F.concat(F.lit("span "), e["ingest_seq"].cast("string"), F.lit(": missing "), F.array_join(e["missing"], ", "))).alias("errors"))
    n = spans.agg(F.count("*").alias("total_count"), F.count_if(F.size(_missing()) == 0).alias("valid_count"))
    rate = F.when(F.col("total_count") == 0, F.lit(100.0)).otherwise(F.col("valid_count") / F.greatest(F.col("total_count"), F.lit(1)) * 100)
    return n.crossJoin(errors).select((F.col("valid_count") == F.col("total_count")).alias("is_valid"), "valid_count", "total_count", rate.alias("validation_rate"), "errors")


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which no span has as its id, in whatever trace."""
    ids = spans.select(F.col("span_id").alias("__id")).filter("__id IS NOT NULL AND __id <> ''").distinct()
    parent = filled(F.col("parent_span"))
    return spans.filter(parent.isNotNull() & (parent != "ROOT")).join(ids, F.trim(F.col("parent_span")) == F.col("__id"), "left_anti")


@by_incident
def service_stats(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each service (of each incident, with by): counts, rates, durations (nearest-rank percentiles, population deviation), operations.

    Percentiles come from counted values in ranges, so that no buffer holds a service's values.
    """
    service = F.coalesce(filled(F.col("service_name")), F.lit("unknown"))
    d = F.coalesce(F.col("duration_ms"), F.lit(0.0))
    s = spans.select(*by, service.alias("service"), d.alias("d"), failed(F.col("has_error"), F.col("response")).alias("bad"), unknown_response(F.col("response")).alias("unk"), filled(F.col("operation_name")).alias("op"))
    g = s.groupBy(*by, "service").agg(
        F.count("*").alias("span_count"), F.count_if("bad").alias("error_count"), F.count_if("unk").alias("unknown_response_count"),
        rounded(F.min("d"), 2).alias("duration_min_ms"), rounded(F.max("d"), 2).alias("duration_max_ms"), rounded(F.avg("d"), 2).alias("duration_mean_ms"), rounded(F.stddev_pop("d"), 2).alias("duration_std_ms"),
    )
    keys = [*by, "service"]
    # sets are gathered from distinct rows, beside the figures, since a set among them would take the generated code from all of these
    ops = s.select(*keys, "op").distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("op")).alias("operations"))
    names = {"duration_p50_ms": 0.5, "duration_p95_ms": 0.95, "duration_p99_ms": 0.99}
    p = percentiles(s, keys, "d", names).select(*keys, *(rounded(F.col(c), 2).alias(c) for c in names))
    g = g.join(p, keys).join(ops, keys).select(*keys, *g.columns[len(keys) :], *names, "operations")
    return g.withColumn("error_rate", rounded(F.col("error_count") / F.col("span_count"), 4)).withColumn("unknown_response_pct", rounded(F.col("unknown_response_count") / F.col("span_count") * 100, 1))


@by_incident
def overall_stats(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total_spans, unique_spans, unique_services, unique_traces, error_spans, unknown_response_pct, services."""
    n = lambda c, name: F.count_distinct(filled(F.col(c))).alias(name)
    bad, unk = failed(F.col("has_error"), F.col("response")), unknown_response(F.col("response"))
    share = F.count_if(unk) / F.greatest(F.count("*"), F.lit(1)) * 100
    aggs = [F.count("*").alias("total_spans"), n("span_id", "unique_spans"), n("service_name", "unique_services"), n("trace_id", "unique_traces"), F.count_if(bad).alias("error_spans"), share.alias("unknown_response_pct"), F.array_sort(F.collect_set(filled(F.col("service_name")))).alias("services")]
    return spans.groupBy(*by).agg(*aggs) if by else spans.agg(*aggs)


def ingest_summary(raw: DataFrame) -> DataFrame:
    """One row: dedup statistics, validation, orphans and overall figures of the deduplicated spans."""
    spans = dedup_spans(raw)
    valid = validate_spans(spans).select("is_valid", "validation_rate")
    orphans = orphan_spans(spans).agg(F.count("*").alias("orphan_count"))
    total = overall_stats(spans).select("unique_services", "unique_traces", "error_spans", "unknown_response_pct")
    return dedup_stats(raw).crossJoin(valid).crossJoin(orphans).crossJoin(total)  # four tables of one row


def discover_services(pods: DataFrame, spans: DataFrame) -> DataFrame:
    """service: canonical names seen in pods (name) or spans, infrastructure aside."""
    from ..functions.columns import INFRA_SERVICES, canonical_service

    names = pods.select(canonical_service(F.col("name")).alias("service")).union(spans.select(canonical_service(F.col("service_name"))))
    return names.filter(F.col("service") != "").filter(~F.lower("service").isin(*INFRA_SERVICES)).distinct()
