"""Repair of conversations: the cheapest edits that make roles alternate, found and proved by depth-first branch-and-bound.

Rows of a conversation are taken by turn (nulls first; ties by role, then by a hash of the text). Equal rows of a turn are counted once. Blank rows, and
rows whose role and text stood earlier, must go; the others may stay, change their role to the one that is due, or go; rows may be
put in. The search runs over a conversation's codes (initial of the role, fault, number of copies), never over texts:

- an explicit stack holds (place, state, cost, audit);
- a suffix bound is made of windows: what a few rows cost at least wherever the edits enter and leave them, added up over disjoint windows;
- the incumbent is the least (cost, audit) so far; a prefix whose bound can't beat it is dropped;
- a table of each node (place, state) keeps the least cost that reached it and drops what comes later and isn't cheaper. What may follow depends on
  the node alone, and of two prefixes of one node and cost neither begins the other, so no best completion is lost.
A first pass takes the child of least bound first and proves the cost; a second one takes audits in order, under that cost.

A conversation of over SEGMENT rows is cut into segments, each searched for every state before and after it, and the least
(cost, audit) is then carried from segment to segment. No task holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import cut

#: Different rows of a segment, rows of a window of the bound.
SEGMENT, WINDOW = 512, 6
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: nothing kept yet, after system, after user, after assistant. A repaired conversation ends in START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_SOLID, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
ROLES = {"u": "user", "a": "assistant"}
Best = tuple[int, str]


class Item(NamedTuple):
    """Rows that are decided together: one row (its role's initial, whether it is truncated), or copies that must go (initial empty)."""

    initial: str
    truncated: bool
    copies: int


def items(codes: list[str], copies: list[int]) -> list[Item]:
    """Of rows coded as initial and fault (b blank, d duplicate, t truncated, n none): of equal rows the first is judged by its fault, the others are duplicates."""
    out = []
    for code, n in zip(codes, copies, strict=True):
        if code[1] in "bd":
            out.append(Item("", False, n))
            continue
        out.append(Item(code[0], code[1] == "t", 1))
        if n > 1:
            out.append(Item("", False, n - 1))
    return out


def _due(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is."""
    if initial == "s" and state == START:
        return SYSTEM
    return _due(state) if (initial == "a") == (state == USER) and initial in ("u", "a") else None


def bounds(rows: list[Item], ends: tuple[int, ...]) -> list[int]:
    """For each place a cost that the edits from there on can't go below, whatever the state."""
    n, out = len(rows), [0] * (len(rows) + 1)
    for i in range(n - 1, -1, -1):
        cost = [0, 0, 0, 0]
        for k in range(i, min(n, i + WINDOW)):
            row = rows[k]
            if row.initial:
                to_user, extra = min(cost[START], cost[SYSTEM], cost[ASSISTANT]), TRUNCATED * row.truncated
                new = [c + DELETE for c in cost]
                user, assistant = to_user + extra + REROLE * (row.initial != "u"), cost[USER] + extra + REROLE * (row.initial != "a")
                new[USER], new[ASSISTANT] = min(new[USER], user), min(new[ASSISTANT], assistant)
                if row.initial == "s":
                    new[SYSTEM] = min(new[SYSTEM], cost[START] + extra)
            else:
                new = [c + DELETE * row.copies for c in cost]
            for _ in range(2):
                new[USER] = min(new[USER], min(new[START], new[SYSTEM], new[ASSISTANT]) + INSERT)
                new[ASSISTANT] = min(new[ASSISTANT], new[USER] + INSERT)
            cost = new
            out[i] = max(out[i], (min(cost[e] for e in ends) if k == n - 1 else min(cost)) + out[k + 1])
    return out


def search(rows: list[Item], entry: int = START, ends: tuple[int, ...] = ENDS, bound: list[int] | None = None) -> Best | None:
    """The least (cost, audit) of edits that lead from the state `entry` to one of `ends`; None if there are none (no edits lead back to START)."""
    bound = bounds(rows, ends) if bound is None else bound
    cheap = _depth_first(rows, entry, ends, bound, None)
    return cheap and _depth_first(rows, entry, ends, bound, cheap[0])


def _depth_first(rows: list[Item], entry: int, ends: tuple[int, ...], bound: list[int], limit: int | None) -> Best | None:
    """Without a limit: some edits of least cost, children of least bound first. With the least cost as the limit: of its edits those of the least audit, children in order of audits.

    In that order a node's first prefix of a cost has the least audit of them, so that in both passes a later one must be cheaper, and
    the first whole audit within the limit is the answer. A node is thus opened once for each cost at most.
    """
    n = len(rows)
    best: Best | None = None
    table: dict[tuple[int, int], int] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bound[i]
        if limit is not None and least > limit or best is not None and least >= best[0]:
            continue
        if table.get((i, state), cost + 1) <= cost:
            continue
        table[i, state] = cost
        if i == n and state in ends:
            best = (cost, audit)
            if cost == limit:
                break
        children = [(i, _due(state), cost + INSERT, audit + "I")]
        if i < n:
            row = rows[i]
            children.append((i + 1, state, cost + DELETE * row.copies, audit + "D" * row.copies))
            if row.initial:
                extra = cost + TRUNCATED * row.truncated
                children.append((i + 1, _due(state), extra + REROLE, audit + "R"))
                if (after := _kept(state, row.initial)) is not None:
                    children.append((i + 1, after, extra, audit + "K"))
        children.sort(key=(lambda c: c[3]) if limit is not None else (lambda c: c[2] + bound[c[0]]), reverse=True)
        stack += children
    return best


def replay(rows: list[Item], entry: int, audit: str) -> list[str]:
    """For each item the roles put in before it (u, a) and what becomes of it (D, K, or its new role U, A); last what is put in at the end."""
    out, state, at = [], entry, 0
    for row in rows:
        step = ""
        while audit[at] == "I":
            state, at = _due(state), at + 1
            step += "u" if state == USER else "a"
        edit = audit[at]
        at += row.copies
        if edit == "K":
            state = _kept(state, row.initial)
        elif edit == "R":
            state = _due(state)
            edit = "U" if state == USER else "A"
        out.append(step + edit)
    tail = ""
    for _ in audit[at:]:
        state = _due(state)
        tail += "u" if state == USER else "a"
    return [*out, tail]


def _solid(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties it, 2 takes its [.!?], 3 repeats it, 4 makes it the user's. Nulls count as one space in the key, the role and the text."""
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(_solid("text"), "[.!?]", "")).otherwise(_solid("text"))
    rows = conversations.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(_solid("role")).alias("role"), text.alias("text"), k.alias("__k")).filter("__k <> 0")
    return rows.withColumn("__copy", F.explode(F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__k", "__copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """key (of the conversation), turn, role, text, said_a and said_b (hashes of role and text), row_a and row_b (of key, turn, role and text)."""
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    base = rows.select("conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), _solid("role").alias("role"), _solid("text").alias("text"))
    said = base.withColumns({"said_a": F.xxhash64("role", "text"), "said_b": F.xxhash64(F.lit("salt"), "text", "role")})
    turn = (F.col("turn").isNull(), F.coalesce("turn", F.lit(0)))
    return said.withColumns({"row_a": F.xxhash64("key", *turn, "said_a"), "row_b": F.xxhash64(*turn, "said_b", "key")})


def _turns(rows: DataFrame) -> DataFrame:
    """The different rows without their texts: conv_id, key, numbered and turn, role, hashes, copies, code."""
    light = rows.groupBy("key", "turn", "role", "said_a", "said_b", "row_a", "row_b").agg(
        F.first("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.first(~F.col("text").rlike(_SOLID)).alias("blank"), F.first(~F.col("text").rlike(_ENDED)).alias("open")
    )
    light = light.select("*", F.col("turn").isNotNull().alias("numbered"))
    first = light.groupBy("key", "said_a", "said_b").agg(F.min(F.struct("numbered", "turn")).alias("first"))
    light = light.join(first, ["key", "said_a", "said_b"])
    later = ~F.struct("numbered", "turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), F.lit("b")).when(later, F.lit("d")).when(F.col("open"), F.lit("t")).otherwise(F.lit("n"))
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")), fault)
    return light.select("conv_id", "key", "numbered", "turn", "role", "said_a", "said_b", "row_a", "row_b", "copies", code.alias("code"))


def _segments(light: DataFrame) -> DataFrame:
    """key, seg, more (others follow), codes, copies, rows (row_a, row_b, role): the different rows of a segment in order."""
    long = light.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SEGMENT).select("key")
    if long.head(1):
        order = ["numbered", "turn", "role", "said_a", "said_b"]
        placed = numbered(light.join(long, "key", "left_semi"), ["key"], order, "__pos", "__n")
        placed = placed.withColumn("seg", F.floor((F.col("__pos") - 1) / SEGMENT)).withColumn("more", F.col("__n") > (F.col("seg") + 1) * SEGMENT).drop("__pos", "__n")
        parted = placed.unionByName(light.join(long, "key", "left_anti").select("*", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("more")))
    else:
        parted = light.select("*", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("more"))
    row = F.struct("numbered", "turn", "role", "said_a", "said_b", "row_a", "row_b", "code", "copies")
    g = parted.groupBy("key", "seg", "more").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # SEGMENT rows at most
    each = lambda c: F.transform("rows", lambda r: r[c])
    return g.select("key", "seg", "more", each("code").alias("codes"), each("copies").alias("copies"), F.transform("rows", lambda r: F.struct(r["row_a"].alias("row_a"), r["row_b"].alias("row_b"), r["role"].alias("role"))).alias("rows"))


_SEARCHED = "key string, seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<struct<entry:int,leave:int,cost:long,audit:string>>"
_LEGAL = ("su", "ua", "au")


def _searched(segments: DataFrame) -> DataFrame:
    """For each segment its counts and, for each state before and after it, the least (cost, audit)."""

    def one(key: str, seg: int, more: bool, codes: list[str], copies: list[int]) -> tuple:
        rows = items(codes, copies)
        count = lambda f: sum(n if code[1] == f == "b" else 1 for code, n in zip(codes, copies, strict=True) if code[1] == f)
        later = sum(n - (code[1] != "d") for code, n in zip(codes, copies, strict=True) if code[1] != "b")
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(codes, codes[1:], strict=False)) + sum(copies) - len(copies)
        ways = []
        exits = [(e,) for e in range(4)] if more else [ENDS]
        for ends in exits:
            bound = bounds(rows, ends)
            for entry in range(4) if seg else (START,):
                if (best := search(rows, entry, ends, bound)) is not None:
                    ways.append({"entry": entry, "leave": ends[-1], "cost": best[0], "audit": best[1]})
        return key, seg, count("b"), later, count("t"), illegal, codes[0][0], codes[-1][0], ways

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [one(*x) for x in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True)]
                kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in made], k) for c, k in enumerate(kinds)], names=["key", "seg", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"])

    return segments.select("key", "seg", "more", "codes", "copies").mapInArrow(run, _SEARCHED)


_CHOSEN = "key string, seg long, entry int, part string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Path(NamedTuple):
    """The way to the end of a segment: the way before it, the state before it, its audit."""

    before: Path | None
    entry: int
    part: str


def earlier(a: Path | None, b: Path | None) -> bool:
    """Whether the audit of a is less than that of b, of as many segments; looks back only as far as they differ."""
    parts: list[tuple[str, str]] = []
    while a is not b:
        parts.append((a.part, b.part))
        a, b = a.before, b.before
    return "".join(x for x, _ in reversed(parts)) < "".join(y for _, y in reversed(parts))


def _chosen(searched: DataFrame) -> DataFrame:
    """For each segment the state before it and its audit, and in the conversation's last row (seg null) the sums, cost and whole audit.

    Segments come in order; of the ways to each state the least is carried on.
    """

    def done(key: str, counts: list[int], carried: dict[int, tuple], segs: list[int]) -> list[tuple]:
        (cost, path), *_ = carried.values()  # the last segment leaves through one set of ends
        out = []
        while path is not None:  # from the last segment back
            out.append((key, segs[len(segs) - 1 - len(out)], path.entry, path.part, *[None] * 6))
            path = path.before
        return [*out, (key, None, None, None, *counts, cost, "".join(x[3] for x in reversed(out)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["key"]:
                    out += done(*now[:4]) if now else []
                    now = [r["key"], [0, 0, 0, 0], {START: (0, None)}, [], ""]
                joint = now[4] + r["first"]
                for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    now[1][k] += r[c]
                now[1][3] += len(joint) == 2 and joint not in _LEGAL
                new: dict[int, tuple] = {}
                for w in r["ways"]:
                    if w["entry"] in now[2]:
                        cost, path = now[2][w["entry"]]
                        made, old = (cost + w["cost"], Path(path, w["entry"], w["audit"])), new.get(w["leave"])
                        if old is None or made[0] < old[0] or made[0] == old[0] and earlier(made[1], old[1]):
                            new[w["leave"]] = made
                now[2], now[4] = new, r["last"]
                now[3].append(r["seg"])
            if len(out) > 1000:
                yield _rows(out)
                out = []
        yield _rows(out + (done(*now[:4]) if now else []))

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in enumerate(kinds)], names=[x.split()[0] for x in _CHOSEN.split(", ")])

    return searched.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(run, _CHOSEN)


def _replayed(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """key, seg, steps: for each of a segment's different rows the roles put in before it and its edit; one more for what is put in at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, segs, steps = [], [], []
            for key, seg, codes, copies, entry, part in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                told, at, merged, before = replay(items(codes, copies), entry, part), 0, [], ""
                for code, n in zip(codes, copies, strict=True):
                    merged.append(told[at])
                    at += 1
                    if code[1] not in "bd" and n > 1:  # what is put in before copies that go stands before the next row
                        before = told[at][:-1]
                        at += 1
                        merged[-1] += before
                merged.append(told[at])
                keys.append(key), segs.append(seg), steps.append(merged)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(segs, pa.int64()), pa.array(steps, pa.list_(pa.string()))], names=["key", "seg", "steps"])

    both = segments.join(chosen.filter("seg IS NOT NULL").select("key", "seg", "entry", "part"), ["key", "seg"])
    return both.select("key", "seg", "codes", "copies", "entry", "part").mapInArrow(run, "key string, seg long, steps array<string>")


class Repaired(NamedTuple):
    """summary: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. messages: key, seg, place, sub (in this order), edit (K, R or I), role, text."""

    summary: DataFrame
    messages: DataFrame


def repair(rows: DataFrame) -> Repaired:
    """The repaired conversations of rows (conv_id, turn, role, text; others are ignored) and what was wrong with each.

    Nulls in role or text count as one space; rows with a null turn come first; rows with a null conv_id are one conversation of its own.
    A role that begins with none of s, u, a must change or go. Texts may be of any length. Turns too far apart for a long have 0 gaps.
    """
    keyed = _keyed(rows)
    light = cut(_turns(keyed), "turns")
    segments = cut(_segments(light), "segments")
    chosen = cut(_chosen(_searched(segments)), "chosen")
    span = F.try_subtract(F.max("turn"), F.min("turn"))
    turns = light.groupBy("key", "turn").agg(F.first("conv_id").alias("conv_id")).groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.try_add(span, 1 - F.count("turn")), F.lit(0)).alias("gaps"))
    summary = chosen.filter("seg IS NULL").select("key", "blank", "duplicate", "truncated", "illegal", "cost", "audit").join(turns, "key")
    told = _replayed(segments, chosen).join(segments.select("key", "seg", "rows"), ["key", "seg"])
    placed = told.select("key", "seg", "rows", F.posexplode("steps").alias("place", "step")).withColumn("row", F.try_element_at("rows", F.col("place") + 1)).drop("rows")
    edits = cut(placed.select("key", "seg", "place", "row.*", F.posexplode(F.split("step", "")).alias("sub", "edit")).filter("edit NOT IN ('', 'D')"), "edits")
    given = lambda c: F.when(c.isin("u", "U"), F.lit(ROLES["u"])).when(c.isin("a", "A"), F.lit(ROLES["a"]))
    put_in = edits.filter("edit IN ('u', 'a')").select("key", "seg", "place", "sub", F.lit("I").alias("edit"), given(F.col("edit")).alias("role"), F.lit("").alias("text"))
    texts = keyed.groupBy("row_a", "row_b").agg(F.first("text").alias("text"))
    stay = edits.filter("edit IN ('K', 'U', 'A')").join(texts, ["row_a", "row_b"])
    stay = stay.select("key", "seg", "place", "sub", F.when(F.col("edit") == "K", F.lit("K")).otherwise(F.lit("R")).alias("edit"), F.coalesce(given(F.col("edit")), "role").alias("role"), "text")
    return Repaired(summary.select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), stay.unionByName(put_in))


def digests(messages: DataFrame) -> DataFrame:
    """key, repaired_sha256 of `role:text`, newline-joined. Messages stream through in order, so a conversation of any length takes the memory of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            keys, shas = [], []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key:
                    if h is not None:
                        keys.append(key), shas.append(h.hexdigest())
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], names=["key", "repaired_sha256"])
        last = [] if h is None else [(key, h.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in last], pa.string()) for c in range(2)], names=["key", "repaired_sha256"])

    ordered = messages.repartition("key").sortWithinPartitions("key", "seg", "place", "sub").select("key", "role", "text")
    return ordered.mapInArrow(run, "key string, repaired_sha256 string")


def digest(repaired: Repaired, asked: DataFrame) -> DataFrame:
    """A row for each conv_id of asked: the summary and the digest of the repaired conversation; one without rows has zeros, no edits and the digest of an empty text."""
    ids = asked.select("conv_id").distinct().withColumn("key", F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))))
    found = ids.join(repaired.summary.drop("conv_id"), "key", "left").join(digests(repaired.messages), "key", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
