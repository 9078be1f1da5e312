"""Sinks: tables of graphs, traces, candidates, facts and incidents as Parquet. Writing twice is writing once.

A table is a folder of parts, one for each write, and a log: the entry of the highest number lists the parts that make
the table. A write adds a part of its own rows and then an entry; so a lost driver or executor leaves the table as it was
or as it should be, and what a write costs hangs on its rows. After MERGE parts they are merged into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a table before they are merged.
MERGE = 16


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _entry(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number and parts of the last entry of the log; 0 and none without a table."""
    log, fs = _fs(spark, f"{path}/_log")
    if not fs.exists(log):
        return 0, []
    last = max((f.getPath().getName() for f in fs.listStatus(log) if not f.getPath().getName().startswith(".")), default=None)
    if last is None:
        return 0, []
    return int(last), [r.value for r in spark.read.text(f"{path}/_log/{last}").collect()]  # at most MERGE names


def _commit(spark: SparkSession, path: str, number: int, parts: list[str]) -> None:
    """The entry appears whole or not at all; two writers of one number can't both succeed."""
    tmp, fs = _fs(spark, f"{path}/.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray("\n".join(parts).encode()))
    out.close()
    log, _ = _fs(spark, f"{path}/_log")
    fs.mkdirs(log)
    entry, _ = _fs(spark, f"{path}/_log/{number:08d}")
    if fs.exists(entry) or not fs.rename(tmp, entry):
        fs.delete(tmp, False)
        raise RuntimeError(f"{path} was changed by another writer")


def read_table(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The table at path: of the rows of a key the one of latest `order`, of equal ones that of the later write."""
    _, parts = _entry(spark, path)
    if not parts:
        raise ValueError(f"no table at {path}")
    return _latest(spark, path, parts, keys, order)


def _latest(spark: SparkSession, path: str, parts: list[str], keys: list[str], order: str) -> DataFrame:
    rows = None
    for k, part in enumerate(parts):
        p = spark.read.parquet(f"{path}/{part}").withColumn("__write", F.lit(k))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__write"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__write")


def upsert(new: DataFrame, path: str, keys: list[str], order: str, partition: str | None = None) -> DataFrame:
    """The table at path with new's rows put in (see read_table). new: one row at most counts for a key, that of the latest `order`."""
    spark = new.sparkSession
    number, parts = _entry(spark, path)
    for _ in range(2):
        part = f"part-{number + 1:08d}-{uuid.uuid4().hex}"
        (new.write.partitionBy(partition) if partition else new.write).parquet(f"{path}/{part}")
        merged = len(parts) >= MERGE
        if not merged:
            break
        new, parts = _latest(spark, path, [*parts, part], keys, order), []
    _commit(spark, path, number + 1, [*parts, part])
    return read_table(spark, path, keys, order)


def upsert_graph(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables nodes (by node_type, id) and edges (by edge_type, src, dst), the latest of each; partitioned by type."""
    now = F.current_timestamp()
    n = upsert(nodes.withColumn("updated_at", now), f"{path}/nodes", ["node_type", "id"], "updated_at", "node_type")
    e = edges if "edge_type" in edges.columns else edges.withColumn("edge_type", F.lit("CALLS"))
    return n, upsert(e.withColumn("updated_at", now), f"{path}/edges", ["edge_type", "src", "dst"], "updated_at", "edge_type")


def write_trace_graph(spans: DataFrame, path: str) -> DataFrame:
    """Edges CONTAINS (trace -> span), EXECUTED_BY (span -> service), CHILD_OF (span -> parent) of spans, partitioned by edge_type."""
    ok = spans.filter("span_id <> ''")
    edge = lambda df, kind, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type"))
    e = edge(ok.filter("trace_id <> ''"), "CONTAINS", "trace_id", "span_id").union(edge(ok, "EXECUTED_BY", "span_id", "service_name")).union(edge(ok.filter("parent_span <> '' AND parent_span <> 'ROOT'"), "CHILD_OF", "span_id", "parent_span"))
    return upsert(e.distinct().withColumn("updated_at", F.current_timestamp()), path, ["edge_type", "src", "dst"], "updated_at", "edge_type")


def append_rca(cands: DataFrame, incident_id: str, path: str, top: int = 10) -> DataFrame:
    """The first candidates of an incident; an incident that is stored again replaces its rows."""
    rows = cands.filter(F.col("rank") <= top).withColumn("incident_id", F.lit(incident_id)).withColumn("stored_at", F.current_timestamp())
    return upsert(rows, path, ["incident_id", "rank"], "stored_at")


def store_facts(rows: DataFrame, path: str) -> DataFrame:
    return upsert(rows, path, ["edge_id"], "extracted_at", "session_id")


def store_incidents(rows: DataFrame, path: str) -> DataFrame:
    return upsert(rows, path, ["id"], "ts")


def store_sessions(rows: DataFrame, path: str) -> DataFrame:
    """Sessions (session_id, user_query, master_plan, global_status, updated_at), the latest of each."""
    return upsert(rows, path, ["session_id"], "updated_at")
