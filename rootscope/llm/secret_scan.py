"""Secret scans by corpus-wide ownership frequency.

Every text is searched for candidates. Their values' hashes are counted over distinct documents (repositories)
and owners. A value of many owners is a widely copied example, and so is one of two owners in very many repositories; the
others look live. A loose kind of candidate, too noisy alone, becomes a span only where the counts say that it is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_key, whole


def _any_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


_NAMES = f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})"
#: kind, pattern, group that holds the value, least characters of the value; in the order that breaks ties.
KINDS = (
    ("assign", _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The method's own kind: long runs that mix capital and small letters with digits.
LOOSE = ("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
SPAN = "array<struct<start:int,no:int,end:int,kind:string,value:string>>"
#: A value of so many owners is an example; so is one of two owners or more that stands in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 16
#: Hits whose places are summed up at once: a fold copies its array with each step.
RUN = 256


def _spans(no: int, hits: Column, values: Column, gaps: Column, kind: str, least: int) -> Column:
    """Spans of one kind: hits and the gaps before them give the places, in code points."""

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(hits, i))
        span = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), F.get(values, i).alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def within(b: Column) -> Column:
        return F.sequence(b * RUN, F.least((b + 1) * RUN, F.size(hits)) - 1)

    # where each run of hits starts, then the hits of each run
    runs = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int"))
    length = lambda acc, i: acc + F.length(F.get(gaps, i)) + F.length(F.get(hits, i))
    offsets = F.aggregate(runs, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.aggregate(within(b), F.element_at(acc, -1), length)))
    out = lambda at, b: F.aggregate(within(b), F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    found = F.flatten(F.zip_with(offsets, runs, lambda at, b: F.when(b.isNotNull(), out(at, b)).otherwise(F.array().cast(SPAN))))
    return F.filter(found, lambda s: F.length(s["value"]) >= least)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, key (of its text), owner, base and loose: arrays of spans, by start, then kind."""
    t = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), whole(F.col(owner_col).cast("string")).alias("owner"))
    t = t.withColumn("key", text_key("text"))
    kinds = [*KINDS, LOOSE]
    for k, (_, pattern, _, least) in enumerate(kinds):
        # runs of one class of characters: only the long ones can pass, and they are found at the same places
        find = pattern.replace("[A-Z0-9]+", "[A-Z0-9]{16,}").replace("[0-9a-f]+", "[0-9a-f]{%d,}" % least)
        kinds[k] = (*kinds[k], find)
        t = t.withColumn(f"h{k}", F.regexp_extract_all("text", F.lit(find), F.lit(0)))
    parts = []
    for k, (kind, _, group, least, find) in enumerate(kinds):
        hits = F.col(f"h{k}")
        values = F.regexp_extract_all("text", F.lit(find), F.lit(group)) if group else hits
        t = t.withColumn(f"v{k}", F.when(F.size(hits) > 0, values)).withColumn(f"g{k}", F.when(F.size(hits) > 0, F.split("text", find, -1)))
        parts.append(F.when(F.size(hits) > 0, _spans(k, hits, F.col(f"v{k}"), F.col(f"g{k}"), kind, least)).otherwise(F.array().cast(SPAN)))
    t = t.select("doc_id", "key", "owner", F.array_sort(F.concat(*parts[:-1])).alias("base"), parts[-1].alias("loose"))
    mixed = F.filter("loose", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return t.withColumn("loose", F.filter(mixed, apart))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value's hash: vh, n_docs, n_owners. A value that stands in a third of all rows is summed where it is read."""
    values = F.array_distinct(F.transform(F.concat("base", "loose"), lambda s: F.sha2(s["value"], 256)))
    rows = found.select("doc_id", "key", "owner", F.explode(values).alias("vh")).distinct()
    by_owner = rows.groupBy("vh", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("vh").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row for each row of docs: doc_id, key, base (spans), all_spans: array of (start, no, end, kind, value, n_docs, n_owners, live).

    A null or empty text has no spans; a null owner counts as one owner named ''. Base spans always stay; a loose
    span is added if its value is live. live: one owner, or fewer than `example_owners` owners and fewer than
    `example_repos` repositories (n_docs). Rows that repeat a doc_id are told apart by their text; equal ones count once.
    """
    found = cut(candidates(docs, id_col, text_col, owner_col), "secrets")
    some = found.filter((F.size("base") > 0) | (F.size("loose") > 0))
    each = some.select("doc_id", "key", F.explode(F.concat("base", "loose")).alias("s")).distinct().withColumn("vh", F.sha2("s.value", 256))
    live = (F.col("n_owners") == 1) | ((F.col("n_owners") < example_owners) & (F.col("n_docs") < example_repos))
    judged = each.join(ownership(some), "vh").withColumn("live", live).filter((F.col("s.no") < len(KINDS)) | F.col("live"))
    span = F.struct("s.start", "s.no", "s.end", "s.kind", "s.value", "n_docs", "n_owners", "live")
    per_doc = judged.groupBy(F.col("doc_id").alias("j_id"), F.col("key").alias("j_key")).agg(F.array_sort(F.collect_list(span)).alias("all_spans"))
    out = found.join(per_doc, found.doc_id.eqNullSafe(per_doc.j_id) & (found.key == per_doc.j_key), "left")
    empty = F.array().cast("array<struct<start:int,no:int,end:int,kind:string,value:string,n_docs:bigint,n_owners:bigint,live:boolean>>")
    return out.select("doc_id", "key", "base", F.coalesce("all_spans", empty).alias("all_spans"))


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, then n_live and n_example over all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("all_spans", lambda s: s["live"])).cast("long")
    return scanned.select("doc_id", *(n(k[0]) for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), live.alias("n_live"), (F.size("all_spans") - live).cast("long").alias("n_example"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """docs with every span replaced: <secret> where it looks live, <example-secret> where it is widely copied. Rows and other columns stay.

    Of spans that overlap the first one is replaced. A null text stays null; equal rows are masked alike.
    """
    scanned = scan_secrets(docs, id_col, text_col, owner_col).filter(F.size("all_spans") > 0).select(F.col("doc_id").alias("__s_id"), F.col("key").alias("__s_key"), F.col("all_spans").alias("__s_spans")).dropDuplicates(["__s_id", "__s_key"])

    def run(acc: Column, b: Column) -> Column:
        """RUN spans more: `rest` is the text from `at` on, so that neither text nor output is copied for each span."""
        part = F.slice("__s_spans", b * RUN + 1, F.lit(RUN))

        def step(own: Column, s: Column) -> Column:
            word = F.when(s["live"], F.lit("<secret>")).otherwise(F.lit("<example-secret>"))
            gap = F.substring(acc["rest"], own["at"] - acc["at"] + 1, s["start"] - own["at"])
            put = F.when(s["start"] >= own["at"], F.concat(own["out"], gap, word)).otherwise(own["out"])
            return F.struct(F.greatest(own["at"], s["end"]).alias("at"), put.alias("out"))

        end = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        masked = F.aggregate(part, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step, lambda own: own["out"])
        return F.struct(end.alias("at"), F.substring(acc["rest"], end - acc["at"] + 1, F.length(acc["rest"])).alias("rest"), F.array_append(acc["out"], masked).alias("out"))

    text = F.col(f"`{text_col}`")
    runs = F.sequence(F.lit(0), F.floor((F.size("__s_spans") - 1) / RUN).cast("int"))
    begin = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(runs, begin, run, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
    both = docs.join(scanned, docs[id_col].eqNullSafe(scanned["__s_id"]) & (text_key(text) == scanned["__s_key"]), "left")
    return both.withColumn(text_col, F.when(F.col("__s_spans").isNull(), text).otherwise(masked)).select(*(F.col(f"`{c}`") for c in docs.columns))
