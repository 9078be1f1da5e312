"""Incident history with lists beside it: the newest incidents of each signature and root cause, kept up to date by every write.

A write adds a part of incidents and a part with the lists of the keys that it touches, and one entry of the log names both; so
lists and incidents never disagree, whatever is lost. A lookup reads the lists of the keys that it asks for, not the incidents.
The latest row of an id holds, of equal times that of the later write; an id whose key has changed leaves the list of the old
one, and a list that loses an entry is filled again from the incidents. Rows without a value for a key stand in no list of it.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.memory import latest
from .shared import cut
from .tables import MERGE, _commit, _entry

#: Entries of a list, and the columns that have lists.
KEEP = 5
KINDS = ("signature", "signature_full", "root_cause")
_KEY = ["kind", "key"]


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str], list[str]]:
    number, parts = _entry(spark, path)
    return number, [p for p in parts if p.startswith("rows-")], [p for p in parts if p.startswith("lists-")]


def _stored(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    read = (spark.read.parquet(f"{path}/{p}").withColumn("__write", F.lit(k)) for k, p in enumerate(parts))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def _holding(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__write")


def _by_key(rows: DataFrame) -> DataFrame:
    """kind, key, i: each incident for each of its keys."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS))
    return rows.select(F.explode(kinds).alias("k"), F.struct(*rows.columns).alias("i")).filter("k.key IS NOT NULL").select("k.kind", "k.key", "i")


def _of_keys(spark: SparkSession, path: str, rows: list[str], keys: DataFrame) -> DataFrame:
    """_by_key of all incidents that hold, for some keys: only ids that ever had one of them are ordered by time."""
    stored = _stored(spark, path, rows)
    ids = _by_key(stored.select("id", *KINDS)).join(keys, _KEY, "left_semi").select("i.id").distinct()
    now = _holding(stored.join(ids, "id", "left_semi"), ["id"], ["ts", "__write"])
    return _by_key(now).join(keys, _KEY, "left_semi")


def add(new: DataFrame, path: str) -> None:
    """Puts incident rows (id, ts, signature, signature_full, root_cause and whatever else) into the history at path."""
    spark = new.sparkSession
    number, rows, lists = _parts(spark, path)
    name = f"{number + 1:08d}-{uuid.uuid4().hex}"
    latest(new).write.parquet(f"{path}/rows-{name}")
    fresh = spark.read.schema(new.schema).parquet(f"{path}/rows-{name}")
    held = spark.read.schema(new.schema).parquet(f"{path}/rows-{name}").limit(0)
    if rows:
        held = _holding(_stored(spark, path, rows).join(fresh.select("id"), "id", "left_semi"), ["id"], ["ts", "__write"])
    held = cut(held, "held")
    before = held.select("id", F.col("ts").alias("__ts"), F.lit(True).alias("__known"))
    won = fresh.join(before, "id", "left").filter("__known IS NULL OR __ts IS NULL OR ts >= __ts").select(fresh.columns)
    put, gone = cut(_by_key(won), "put"), cut(_by_key(held.join(won, "id", "left_semi")).select(*_KEY, "i.id"), "gone")
    touched = put.select(*_KEY).union(gone.select(*_KEY)).distinct()
    entries = put
    more = put.select(*_KEY).limit(0)
    if lists:
        old = cut(_holding(_stored(spark, path, lists).join(touched, _KEY, "left_semi"), _KEY, ["version"]), "lists")
        more = old.filter("more").select(*_KEY)
        listed = old.select(*_KEY, F.explode("newest").alias("i"))
        named = lambda df: df.select(*_KEY, "i.id")
        moved = gone.join(named(put), [*_KEY, "id"], "left_anti")
        # a cut list that loses an entry may need one that it doesn't hold
        short = cut(named(listed).join(moved, [*_KEY, "id"], "left_semi").select(*_KEY).distinct().join(more, _KEY, "left_semi"), "short")
        kept = listed.withColumn("id", F.col("i.id")).join(gone, [*_KEY, "id"], "left_anti").drop("id")
        entries = kept.unionByName(put, allowMissingColumns=True)
        if not short.isEmpty():
            again = _of_keys(spark, path, [*rows, f"rows-{name}"], short)
            entries = entries.join(short, _KEY, "left_anti").unionByName(again, allowMissingColumns=True)
            more = more.join(short, _KEY, "left_anti")
        entries = cut(entries, "entries")
    first = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("i.ts"), "i.id"))
    newest = entries.withColumn("__n", first).filter(F.col("__n") <= KEEP).groupBy(*_KEY).agg(F.collect_list("i").alias("newest"))
    many = entries.groupBy(*_KEY).agg((F.count("*") > KEEP).alias("many")).join(more.withColumn("had", F.lit(True)), _KEY, "left")
    made = touched.join(newest, _KEY, "left").join(many, _KEY, "left")
    made = made.select(*_KEY, F.coalesce("newest", F.array()).alias("newest"), F.coalesce("had", "many", F.lit(False)).alias("more"), F.lit(number + 1).alias("version"))
    made.write.parquet(f"{path}/lists-{name}")
    rows, lists = [*rows, f"rows-{name}"], [*lists, f"lists-{name}"]
    if 2 * len(rows) > MERGE:  # an entry of the log has MERGE names at most
        _holding(_stored(spark, path, rows), ["id"], ["ts", "__write"]).write.parquet(f"{path}/rows-{name}-all")
        _holding(_stored(spark, path, lists), _KEY, ["version"]).filter(F.size("newest") > 0).write.parquet(f"{path}/lists-{name}-all")
        rows, lists = [f"rows-{name}-all"], [f"lists-{name}-all"]
    _commit(spark, path, number + 1, [*rows, *lists])


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incidents that hold."""
    _, rows, _ = _parts(spark, path)
    if not rows:
        raise ValueError(f"no history at {path}")
    return _holding(_stored(spark, path, rows), ["id"], ["ts", "__write"])


def find_similar(spark: SparkSession, path: str, asked: DataFrame, limit: int = KEEP) -> DataFrame:
    """memory.find_similar over the history at path, from its lists alone: at most 3 * KEEP rows for each row of asked (case_id, signature, root_cause)."""
    if limit > KEEP:
        raise ValueError(f"lists hold {KEEP} incidents")
    _, _, lists = _parts(spark, path)
    if not lists:
        raise ValueError(f"no history at {path}")
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("root_cause" if k == "root_cause" else "signature").alias("key")) for k in KINDS))
    wanted = asked.select("case_id", F.explode(keys).alias("k")).select("case_id", "k.*").filter("key IS NOT NULL AND NOT (kind = 'root_cause' AND key = '')").distinct()
    now = _holding(_stored(spark, path, lists).join(wanted, _KEY, "left_semi"), _KEY, ["version"])
    hits = wanted.join(now, _KEY).select("case_id", F.explode("newest").alias("i")).select("case_id", "i.*").dropDuplicates(["case_id", "id"])
    w = Window.partitionBy("case_id").orderBy(F.desc("ts"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
