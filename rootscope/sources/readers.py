"""Readers of spans, metrics, logs and pod listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import pod_of

# Header words of a span file, and the column names that stand for each field.
HEADER = ("trace_id", "span_id", "parent_span", "service_name", "operation_name", "start_time", "duration", "has_error", "response")
ALIASES = {
    "trace_id": ("trace_id", "traceId", "TraceId"),
    "span_id": ("span_id", "spanId", "SpanId"),
    "parent_span": ("parent_span", "parentSpan", "parent_id", "parentId", "ParentId"),
    "service_name": ("service_name", "serviceName", "service", "Service"),
    "operation_name": ("operation_name", "operationName", "operation", "Operation"),
    "start_time": ("start_time", "startTime", "StartTime"),
    "duration_ms": ("duration_ms",),
    "duration": ("duration", "Duration"),
    "has_error": ("has_error", "hasError"),
    "response": ("response", "response_class", "http.status_code"),
    "status": ("status", "Status"),
    "end_time": ("end_time", "endTime", "EndTime"),
    "tags": ("tags", "Tags"),
}


#: Bits of ingest_seq that hold the place within a file; the file's place is above them.
LINE_BITS = 40


def _located() -> list[Column]:
    """Where a row comes from: path and block (the part of a file that one task reads), and i, which grows with the rows of a block."""
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")]


def placed(rows: DataFrame, fill: Column | None = None) -> DataFrame:
    """rows (path, block, i, ...) with `file` (from 0, by path), `line` (from 1, within the file) and, if asked, `filled`: the last `fill` so far in the file that isn't null.

    A carry scan: each block's count and last `fill` come from partial aggregation, and are carried over a file's blocks on one row for each block.
    Within a block rows are numbered by a window, so that no window holds more than a block; a file of any size spreads over tasks.
    """
    fill = F.lit(None).cast("string") if fill is None else fill
    own = rows.withColumn("__fill", fill)
    per = own.groupBy("path", "block").agg(F.count("*").alias("__n"), F.max_by(F.when(F.col("__fill").isNotNull(), F.col("__fill")), F.when(F.col("__fill").isNotNull(), F.col("i"))).alias("__last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier))
    files = per.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")).cast("long") - 1)  # names of files
    w = Window.partitionBy("path", "block").orderBy("i")
    local = own.withColumn("__local", F.row_number().over(w)).withColumn("__filled", F.last("__fill", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = local.join(per.join(files, "path").select("path", "block", "file", "__before", "__carried"), ["path", "block"])
    return both.withColumn("line", F.col("__local") + F.col("__before")).withColumn("filled", F.coalesce("__filled", "__carried")).select(*rows.columns, "file", "line", "filled")


def _sequence() -> Column:
    return F.shiftleft(F.col("file"), LINE_BITS) + F.col("line")


def normalize_spans(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """SPAN of raw columns under any alias, all as text.

    duration_ms counts before duration (microseconds); numbers that don't parse are 0 (`123.0` is none for a whole
    number); true, 1, yes and y are errors; a missing response is Unknown and a missing status follows from both.
    """
    have = {c: c for c in raw.columns}
    pick = lambda f: [F.col(f"`{have[a]}`").cast("string") for a in ALIASES[f] if a in have]
    first = lambda f: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in pick(f)), F.lit(None).cast("string")) if pick(f) else F.lit(None).cast("string")
    whole = lambda c: F.coalesce(F.trim(c).try_cast("long"), F.lit(0))
    given = F.coalesce(*pick("duration_ms"), F.lit(None).cast("string"))
    ms = F.when(given.isNotNull(), F.coalesce(F.trim(given).try_cast("double"), F.lit(0.0))).otherwise(whole(first("duration")) / 1000.0)
    bad = F.coalesce(F.lower(first("has_error")).isin("true", "1", "yes", "y"), F.lit(False))
    said = first("response")
    resp = F.when(said.isNull() | F.lower(said).isin("none", "nan"), F.lit("Unknown")).otherwise(said)
    status = F.coalesce(first("status"), F.when(bad, F.lit("ERROR")).when(F.lower(resp) == "unknown", F.lit("UNKNOWN")).otherwise(resp))
    tags = F.coalesce(F.from_json(first("tags"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return raw.select(
        F.coalesce(first("trace_id"), F.lit("")).alias("trace_id"), F.coalesce(first("span_id"), F.lit("")).alias("span_id"), F.coalesce(first("parent_span"), F.lit("ROOT")).alias("parent_span"),
        F.coalesce(first("service_name"), F.lit("unknown")).alias("service_name"), F.coalesce(first("operation_name"), F.lit("")).alias("operation_name"), whole(first("start_time")).alias("start_time"),
        F.bround(ms * 1000).cast("long").alias("duration"), ms.alias("duration_ms"), bad.alias("has_error"), resp.alias("response"), status.alias("status"), F.coalesce(first("end_time"), F.lit("")).alias("end_time"), tags.alias("tags"),
        (order if order is not None else F.monotonically_increasing_id()).alias("ingest_seq"),
    )


def file_formats(spark: SparkSession, path: str, sample: int = 25) -> DataFrame:
    """path, fmt of each CSV file: standard or mixed (six fields, two of them blank-separated).

    The header and the first rows of a file decide: of up to `sample` rows the first that is as wide as the header makes it standard,
    one of six fields below a header of the nine words makes it mixed. They are looked for in the file's first block.
    """
    t = spark.read.text(path, pathGlobFilter="*.csv").select("value", *_located()).filter("block = 0").filter(F.trim("value") != "")
    first = t.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("i"))).filter(F.col("n") <= sample + 1)
    head = first.filter("n = 1").select("path", F.col("value").alias("header"))
    fields = F.size(F.split("value", ","))
    rows = first.filter("n > 1").filter(~F.lower(F.trim("value")).startswith("trace_id")).join(head, "path")
    words = F.size(F.filter(F.split("header", r"[,\s]+"), lambda w: F.trim(w, F.lit('"')).isin(*HEADER)))
    width = F.size(F.split("header", ","))
    mixed = (fields == 6) & (words == len(HEADER)) & ((width >= 8) | (width == 6))
    verdict = F.when(mixed, F.lit("mixed")).when(fields == width, F.lit("standard"))
    told = rows.withColumn("fmt", verdict).filter("fmt IS NOT NULL").groupBy("path").agg(F.min_by("fmt", "n").alias("fmt"))
    return head.join(told, "path", "left").select("path", F.coalesce("fmt", F.lit("standard")).alias("fmt"))


def _mixed(lines: DataFrame) -> DataFrame:
    """Columns of mixed lines: trace_id, "span parent service", "operation start", duration, has_error, response."""
    p = lines.select("path", "block", "i", F.transform(F.split("value", ",", 6), lambda x: F.trim(F.trim(x), F.lit('"'))).alias("f")).filter(F.size("f") == 6)
    ids = F.split(F.get("f", F.lit(1)), r"\s+", 3)
    op, two = r"^(.*)\s+(\d+)$", F.get("f", F.lit(2))
    return p.filter(~F.get("f", F.lit(0)).isin(*HEADER)).select(
        "path", "block", "i", F.get("f", F.lit(0)).alias("trace_id"), F.get(ids, F.lit(0)).alias("span_id"), F.get(ids, F.lit(1)).alias("parent_span"), F.get(ids, F.lit(2)).alias("service_name"),
        F.when(two.rlike(op), F.regexp_extract(two, op, 1)).otherwise(two).alias("operation_name"), F.regexp_extract(two, op, 2).alias("start_time"), F.get("f", F.lit(3)).alias("duration"), F.get("f", F.lit(4)).alias("has_error"), F.get("f", F.lit(5)).alias("response"),
    )


def read_spans(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """SPAN of the CSV or JSON files of a folder. fmt: standard, mixed, json, jsonl, or auto (CSV files, each by its own look).

    Files of a folder may have different headers: each header's files are read together. JSON: an array, or an object
    with `data` or `traces`; one in each file (json), or in each line (jsonl: files that Spark can split).
    """
    if fmt in ("json", "jsonl"):
        raw = spark.read.option("multiLine", fmt == "json").option("primitivesAsString", True).json(path)
        key = next((k for k in ("data", "traces") if k in raw.columns), None)
        where = [c for c in _located()[:2]]
        raw = raw.select(*where, F.explode(key).alias("x")).select("path", "block", "x.*") if key else raw.select("*", *where)
        raw = placed(raw.withColumn("i", F.monotonically_increasing_id()))
        return normalize_spans(raw.drop("filled"), _sequence())
    if fmt == "auto":
        kinds = {r.fmt: r.paths for r in file_formats(spark, path).groupBy("fmt").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()}  # file names
    else:
        kinds = {fmt: [path]}
    parts = []
    if "mixed" in kinds:
        parts.append(_mixed(spark.read.text(kinds["mixed"]).select("value", *_located())))
    if "standard" in kinds:
        heads = spark.read.text(kinds["standard"], pathGlobFilter="*.csv").select("value", *_located()).filter("block = 0")
        by_head = heads.groupBy("path").agg(F.min_by("value", "i").alias("head")).groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()  # file names
        for r in sorted(by_head, key=lambda r: r.paths):
            parts.append(spark.read.option("header", True).csv(r.paths).select("*", *_located()))
    if not parts:
        raise ValueError(f"no span files in {path}")
    raw = parts[0]
    for more in parts[1:]:
        raw = raw.unionByName(more, allowMissingColumns=True)
    return normalize_spans(placed(raw).drop("filled"), _sequence())  # one order over all files: by path, then line


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """METRIC of a summary CSV (metric, cmdb_id, kpi_name, value[, timestamp]) or of a folder's kpi_*.csv files without header (time, id, name, value); NaN goes, a missing time is the row's place."""
    files = spark.read.option("recursiveFileLookup", True)
    if path.endswith(".csv"):
        t = spark.read.option("header", True).csv(path).select("*", *_located())
        ts = F.col("timestamp").try_cast("double") if "timestamp" in t.columns else F.lit(None).cast("double")
        t = t.select(F.lower("metric").alias("metric"), pod_of(F.col("cmdb_id")).alias("service"), ts.alias("ts"), F.col("value").try_cast("double").alias("value"), "path", "block", "i")
    else:
        t = files.option("pathGlobFilter", "kpi_*.csv").schema("c0 string, c1 string, c2 string, c3 string").csv(path)
        t = t.select(F.lower(F.regexp_extract("_metadata.file_name", r"^kpi_(.*)\.csv$", 1)).alias("metric"), pod_of(F.col("c1")).alias("service"), F.col("c0").try_cast("double").alias("ts"), F.col("c3").try_cast("double").alias("value"), *_located())
    t = placed(t.filter("value IS NOT NULL AND NOT isnan(value) AND service <> ''"))
    return t.select("metric", "service", F.coalesce("ts", (F.col("line") - 1).cast("double")).alias("ts"), "value")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """LOG_LINE of text files: a line `=== service ===` names the service of the lines below it, over the borders of the file's blocks."""
    t = spark.read.text(path).select(F.col("value"), *_located())
    head = F.regexp_extract("value", r"^===\s*(\S.*?)\s*===\s*$", 1)
    t = placed(t, F.when(head != "", head))
    return t.filter((head == "") & F.col("filled").isNotNull()).select(F.col("filled").alias("service"), F.col("line").alias("line_no"), F.col("value").alias("line"))


def read_pods(spark: SparkSession, path: str) -> DataFrame:
    """name, ready, status, restarts of a pod listing with a header line."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    f = f.filter((F.size("f") >= 3) & (F.get("f", F.lit(0)) != "NAME"))
    return f.select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("ready"), F.get("f", F.lit(2)).alias("status"), F.coalesce(F.get("f", F.lit(3)), F.lit("0")).alias("restarts"))


def unwrap_text(df: DataFrame, col: str, prompt: str | None = None) -> DataFrame:
    """line: lines of texts that came as b'...' with escaped line ends; what follows `prompt` (a pattern) goes."""
    t = F.trim(F.col(col))
    t = F.when(t.rlike(r"(?s)^b(['\"]).*\1$"), F.regexp_replace(t, r"(?s)^b(['\"])(.*)\1$", "$2")).otherwise(t)
    t = F.replace(F.replace(F.replace(t, F.lit("\\r"), F.lit("")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    if prompt:
        t = F.regexp_replace(t, f"(?s){prompt}.*$", "")
    return df.select(F.explode(F.split(t, "\n")).alias("line")).filter(F.trim("line") != "")
