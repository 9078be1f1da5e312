"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit are equal once a character at one place is deleted from both (a replacement) or from
the longer one (an insertion). Such variants are emitted as hashed keys and met by grouping; within a key only
the earliest line is wanted, so that no pairs of a group are formed. The edit distance to it is then verified.

A line of n characters has n variants of n characters. But of two lines within one edit, the first or the last half
is the same, and so on within the other half. So a half that only one line has needs no variants; where it is
shared, it becomes a fixed part of the key, and after LEVELS halvings only the short segment that is left has
characters deleted. This loses no pair: of any two lines within one edit the same halves stay at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_key, whole

#: Default of min_chars: lines of fewer characters (without outer blanks) are not compared. The query and the stage of the pipeline use ALL_LINES.
MIN_CHARS = 16
#: min_chars that leaves out blank lines only.
ALL_LINES = 1
#: Lines of so many characters have near copies: one edit makes a line of one character any other one, while from two on a character is shared.
NEAR_CHARS = 2
#: White space that does not count at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Times that the place of the edit is halved.
LEVELS = 4
#: Up to so many lines that share a half, their places are broadcast to the documents (about 100 bytes each); beyond, both are shuffled.
BROADCAST_LINES = 200_000


def _row_key(text: Column) -> Column:
    return F.xxhash64(text)


def corpus_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """me (doc_id, key of the document's text, place of the line from 0), line, n, lk (key of the line): lines that may be compared."""
    t = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).filter("doc_id IS NOT NULL")
    each = t.select("doc_id", _row_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    each = each.select(F.struct("doc_id", "key", "place").alias("me"), F.trim(F.col("raw"), F.lit(BLANKS)).alias("line"))
    return each.withColumn("n", F.length("line")).filter(F.col("n") >= min_chars).withColumn("lk", text_key("line"))


def _halves(seg: Column, m: Column, longer: Column | int, fixed: Column) -> list[tuple[Column, Column, Column]]:
    """(fixed, seg, m) with the first, then the last half of seg fixed; m: its length in the shorter of two lines."""
    n, h = m + longer, F.floor(m / 2).cast("int")
    first, last = F.substring(seg, F.lit(1), h), F.substring(seg, n - (m - h) + 1, m - h)
    key = lambda half, side: F.xxhash64(fixed, m, F.lit(side), half)
    return [(key(first, 0), F.substring(seg, h + 1, n - h), m - h), (key(last, 1), F.substring(seg, F.lit(1), n - (m - h)), h)]


def _half_keys() -> Column:
    """Keys of both halves of a line as the shorter of two lines (or one of equal length), then as the longer one."""
    n, nothing = F.col("n"), F.lit(0).cast("long")
    return F.array(*(k[0] for longer in (0, 1) for k in _halves(F.col("line"), n - longer, F.lit(longer), nothing)))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (me, fixed, longer, ...) whose fixed part another line has as well; one of them must be the shorter."""
    keys = rows.groupBy("fixed").agg(F.count("*").alias("c"), F.min("longer").alias("l")).filter("c > 1 AND l = 0").select("fixed")
    return rows.join(keys, "fixed", "left_semi")


def near_lines(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """me (first place) of distinct lines that have an earlier line at one edit; firsts: me, halves."""
    halves = firsts.select("me", F.posexplode("halves").alias("role", "fixed")).withColumn("longer", F.floor(F.col("role") / 2).cast("int"))
    wanted = cut(_shared(halves).select("me", "role"), "halves")
    # the texts of these lines, read again from their first document
    of_doc = wanted.groupBy(F.col("me.doc_id").alias("w_id"), F.col("me.key").alias("w_key")).agg(F.collect_list(F.struct("me", "role")).alias("lines"))
    if wanted.count() <= BROADCAST_LINES:
        of_doc = F.broadcast(of_doc)
    t = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    t = t.join(of_doc, (t.doc_id == of_doc.w_id) & (_row_key(t.text) == of_doc.w_key))
    one = t.select(F.split("text", "\n", -1).alias("parts"), F.explode("lines").alias("l")).select("l.*", F.trim(F.get("parts", F.col("l.me.place")), F.lit(BLANKS)).alias("line")).distinct()
    one = cut(one.withColumn("longer", F.floor(F.col("role") / 2).cast("int")), "near-lines")
    whole_line = F.length("line") - F.col("longer")
    step = _halves(F.col("line"), whole_line, F.col("longer"), F.lit(0).cast("long"))
    pick = lambda k: F.when(F.col("role") % 2 == 0, step[0][k]).otherwise(step[1][k])
    seg = one.select("me", "longer", pick(0).alias("fixed"), pick(1).alias("seg"), pick(2).alias("m"))
    for _ in range(LEVELS - 1):
        both = [F.struct(f.alias("fixed"), s.alias("seg"), m.alias("m")) for f, s, m in _halves(F.col("seg"), F.col("m"), F.col("longer"), F.col("fixed"))]
        seg = cut(_shared(seg.select("me", "longer", F.explode(F.array(*both)).alias("h")).select("me", "longer", "h.*")), "segments")
    # the shorter emits its segment whole and, for replacements, with each character deleted; the longer emits deletions
    size = F.col("m") + F.col("longer")
    v = seg.select("me", "longer", "fixed", "seg", F.explode(F.sequence(F.col("longer"), size)).alias("at")).filter("at > 0 OR longer = 0")
    v = v.withColumn("variant", F.when(F.col("at") == 0, F.col("seg")).otherwise(F.concat(F.expr("substring(seg, 1, at - 1)"), F.expr("substring(seg, at + 1)"))))
    # spot -1: an insertion (a whole segment against deletions); else a replacement at that place
    spot = F.when((F.col("longer") == 1) | (F.col("at") == 0), F.lit(-1)).otherwise(F.col("at"))
    key = F.struct(F.xxhash64("fixed", "variant", spot).alias("a"), F.xxhash64(F.lit("salt"), "fixed", "variant", spot).alias("b"))
    v = v.select("me", "longer", spot.alias("spot"), key.alias("vkey"))
    best = v.groupBy("vkey", "longer").agg(F.min("me").alias("earliest"), F.min("spot").alias("spot"))
    # a replacement meets its own side, an insertion the other one
    meets = best.select("vkey", F.when(F.col("spot") == -1, 1 - F.col("longer")).otherwise(F.col("longer")).alias("longer"), "earliest")
    pairs = v.join(meets, ["vkey", "longer"]).filter(F.col("earliest") < F.col("me")).select("me", "earliest").distinct()
    texts = one.select("me", "line").distinct()
    pairs = pairs.join(texts, "me").join(texts.select(F.col("me").alias("earliest"), F.col("line").alias("e_line")), "earliest")
    return pairs.filter(F.levenshtein("line", "e_line", 1).between(0, 1)).select("me").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key, gone: for each document that loses lines their places, from 0.

    A line (outer white space aside) goes if an earlier one, by doc_id, then place, is within max_edits (0 or 1)
    insertions, deletions or replacements of a character, judged on the input; lines of one character go as exact
    repeats only, and none makes a longer one go. Lines under min_chars characters, null and empty texts lose nothing. Rows without a doc_id have no place in the order: their lines stay and make
    none go. Rows that repeat a doc_id with another text are ordered by the text's hash; rows equal in both are one
    document and lose the same lines.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    rows = corpus_lines(docs, id_col, text_col, min_chars)
    halves = F.when(F.col("n") >= NEAR_CHARS, _half_keys()).otherwise(F.array().cast("array<bigint>"))
    slim = rows.select("me", "lk", *([halves.alias("halves")] if max_edits else []))
    firsts = slim.groupBy("lk").agg(F.min("me").alias("me"), *([F.first("halves").alias("halves")] if max_edits else []))
    stays = firsts.select(F.col("lk").alias("f_lk"), F.col("me").alias("f_me"))
    near = F.lit(False)
    if max_edits:
        firsts = cut(firsts, "lines")
        found = near_lines(docs, firsts.select("me", "halves"), id_col, text_col).select(F.col("me").alias("n_me"))
        stays = firsts.select(F.col("lk").alias("f_lk"), F.col("me").alias("f_me")).join(found, F.col("f_me") == F.col("n_me"), "left")
        near = F.col("n_me").isNotNull()
    gone = rows.select("me", "lk").join(stays, F.col("lk") == F.col("f_lk")).filter(near | (F.col("me") != F.col("f_me")))
    return gone.groupBy("me.doc_id", "me.key").agg(F.array_sort(F.collect_set("me.place")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS, drop_emptied: bool = True) -> DataFrame:
    """docs without the removed lines, other columns as they were; a document that keeps no visible line goes, if drop_emptied."""
    out = _with_gone(docs, id_col, text_col, max_edits, min_chars)
    text = F.col(f"`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__l_gone", i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("__l_gone").isNull(), text).otherwise(left))
    if drop_emptied:
        out = out.filter(F.col("__l_gone").isNull() | text.rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _with_gone(docs: DataFrame, id_col: str, text_col: str, max_edits: int, min_chars: int) -> DataFrame:
    gone = removed_lines(docs, id_col, text_col, max_edits, min_chars).select(F.col("doc_id").alias("__l_id"), F.col("key").alias("__l_key"), F.col("gone").alias("__l_gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__l_id"]) & (_row_key(whole(text_col)) == gone["__l_key"]), "left")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_removed, removed (places, comma-joined), kept_sha256 (of the lines left)."""
    parts = F.split(whole(text_col), "\n", -1)
    gone = F.coalesce("__l_gone", F.array().cast("array<int>"))
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = _with_gone(docs, id_col, text_col, max_edits, min_chars)
    return out.select(F.col(id_col).alias("doc_id"), F.size(parts).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed"), F.sha2(left, 256).alias("kept_sha256"))
