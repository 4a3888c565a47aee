"""Repair of conversation structure by a lightest-derivation agenda.

A conversation's role initials should read ``(s?(ua)+)?``. Edits, in order: Keep a row
(0), Rerole it to user or assistant (3), Delete it (4; the only one for blank and
duplicate rows), Insert an empty user or assistant row (3); a truncated row that is not
deleted adds 3. The cheapest list of edits is wanted, among equals the one whose
initials are least in ASCII.

Items ``(i, state)`` say that the first ``i`` rows are dealt with and the rows put out so
far lead to ``state`` (nothing yet, after s, after u, after a). Each edit is a deduction
from an item to the next. An item's weight is ``(cost, audit)``, the audit being the
initials of the edits so far; deductions add to both, so a conclusion never weighs less
than its premise, and lighter premises give lighter conclusions (audits of one item and
one cost are never prefixes of each other, since only inserts could lie between and they
cost). So items popped from a heap are final, and the first goal is the answer (Knuth,
1977).

Rows move without their texts. They are range-sorted by conversation and turn, so a
conversation of any length spreads over tasks, and are cut into chunks of ``CHUNK`` rows
at most. A chunk that is a whole conversation is solved at once. Of any other the agenda
gives the lightest span from each entry state to each exit state, a hyperedge of the
conversation; chains of such spans are then joined, with 16 costs and ranks for a chunk
of rows. Only then do texts meet their edits, by row.

Defined cases: null roles and texts are one space, so such a text is blank; rows without
turn come first; rows of one turn come by role, then by a hash of role and text; rows
without conv_id make one conversation; a repeated row is a duplicate; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common

#: Rows of a chunk at most.
CHUNK = 1024
#: Costs of edits, and what a truncated row adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing put out yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = "-sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: By state: where an inserted or reroled row leads, and which initials may be kept.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ("su", "u", "a", "u")
#: Where a conversation may end, and what inserts lead there from the other states.
GOALS = (NONE, ASSISTANT)
CLOSING = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")


def lightest(initials: str, faults: str, entry: int, closes: bool) -> dict[int, tuple[int, str]]:
    """Weights (cost, audit) of the lightest derivations of a chunk's rows by exit state.

    ``faults`` holds ``b``, ``d``, ``t`` or ``-`` for each row. With ``closes`` the
    conversation ends here, and only the goal that finalises first is returned."""
    n, final, out = len(initials), set(), {}
    agenda = [(0, "", 0, entry)]
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            if not closes:
                out[state] = cost, audit
                if len(out) == len(STATES):
                    return out
                continue
            if state in GOALS:
                return {state: (cost, audit)}
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, NEXT[state]))
        if i < n:
            fault = faults[i]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in "bd":
                more = cost + CUT if fault == "t" else cost
                heapq.heappush(agenda, (more + REROLE, audit + "R", i + 1, NEXT[state]))
                if initials[i] in KEPT[state]:
                    heapq.heappush(agenda, (more + KEEP, audit + "K", i + 1, STATES.index(initials[i])))
    return out


def edits(initials: str, entry: int, audit: str) -> list[tuple[str, str, str, str]]:
    """Per row (inserted before it, its edit, its new role or an empty one, inserted
    after it); inserts are initials."""
    state, pending, out = entry, "", []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            pending += STATES[state]
            continue
        role = ""
        if letter == "R":
            state = NEXT[state]
            role = ROLES[state]
        elif letter == "K":
            state = STATES.index(initials[len(out)])
        out.append((pending, letter, role, ""))
        pending = ""
    if pending:
        out[-1] = (*out[-1][:3], pending)
    return out


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations (conv_id, turn, role, text)`` with faults planted by
    ``crc32("conv_id:turn") % 20``: 0 drops a row, 1 empties its text, 2 takes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


class Repair(NamedTuple):
    """``messages``: the repaired rows (conv_id, place, edit, role, text), in the order of
    ``place``. ``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost and
    audit of each conversation that has rows."""

    messages: DataFrame
    summary: DataFrame


def _numbered(conversations: DataFrame) -> DataFrame:
    """A written table of the rows: row (its number), same (equal for rows that repeat a
    role and text in a conversation), initial, fault (but for duplicates)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    first = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("-")
    same = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return common.staged(
        rows.withColumns({"row": F.monotonically_increasing_id(), "same": same, "initial": F.when(first.isin("s", "u", "a"), first).otherwise("-"), "fault": fault}), "repair-rows"
    )


def _items(rows: DataFrame) -> DataFrame:
    """(row, conv_id, turn, role, same, initial, fault), duplicates marked. Groups of equal
    rows are counted before they are shuffled."""
    light = rows.select("row", "conv_id", "turn", "role", "same", "initial", "fault")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    firsts = light.filter("fault != 'b'").groupBy("same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", F.col("first.row").alias("first_row"))
    again = (F.col("fault") != "b") & F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row"))
    return light.join(firsts, "same", "left").withColumn("fault", F.when(again, "d").otherwise(F.col("fault"))).drop("first_row")


CHUNKS = "conv_id long, part int, chunk long, rows array<long>, initials string, illegal long, costs array<int>, ranks array<int>, audits array<string>"


def _chunks(items: DataFrame, size: int) -> DataFrame:
    """A written table of chunks in the order of (part, chunk). ``costs``, ``ranks`` and
    ``audits`` hold the span from state s to t at place ``4 * s + t``; a rank orders the
    audits of one entry state."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "same", "row"]

    def solved(initials: str, faults: str, opens: bool, closes: bool) -> tuple[list, list, list]:
        costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
        for s in [NONE] if opens else range(4):
            spans = lightest(initials, faults, s, opens and closes)
            for rank, t in enumerate(sorted(spans, key=lambda t: spans[t][1])):
                costs[4 * s + t], audits[4 * s + t] = spans[t]
                ranks[4 * s + t] = rank
        return costs, ranks, audits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, schema = TaskContext.get().partitionId(), [], None
        conv, rows, initials, faults, opens, number = None, [], [], [], False, 0

        def flush(closes: bool) -> None:
            nonlocal number, rows, initials, faults, opens
            if rows:
                joined = "".join(initials)
                out.append((conv, part, number, rows, joined, illegal_pairs(joined), *solved(joined, "".join(faults), opens, closes)))
                number, rows, initials, faults, opens = number + 1, [], [], [], False

        def batch_of(done: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            columns = list(zip(*done, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "part", "chunk", "rows", "initials", "illegal", "costs", "ranks", "audits"])

        begun = False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "row", "initial", "fault")]
            for c, row, initial, fault in zip(*columns, strict=True):
                if not begun or c != conv:
                    flush(True)
                    # The first conversation of a partition may have begun in the one before.
                    conv, opens, begun = c, begun, True
                elif len(rows) == size:
                    flush(False)
                rows.append(row)
                initials.append(initial)
                faults.append(fault)
            if len(out) >= 256:
                yield batch_of(out)
                out.clear()
        flush(False)  # it may go on in the next partition
        yield batch_of(out)

    light = items.select("conv_id", "turn", "role", "same", "row", "initial", "fault")
    ordered = light.repartitionByRange(common.shuffle_partitions(items), *order).sortWithinPartitions(*order)
    return common.staged(common.map_arrow(ordered.select("conv_id", "row", "initial", "fault"), cut, CHUNKS), "repair-chunks")


def chain(costs: list[list], ranks: list[list]) -> tuple[int, list[int], str]:
    """Joins the spans of a conversation's chunks: (cost, span of each chunk, inserts that
    close it). Chunk by chunk each state keeps its lightest way there; the audits of ways
    to different states differ before either ends, so their order is kept as a rank."""
    ways, back = {NONE: (0, 0)}, []
    for cost, rank in zip(costs, ranks, strict=True):
        found = {}
        for s, (c, r) in ways.items():
            for t in range(4):
                if (k := cost[4 * s + t]) is not None:
                    found[t] = min(found.get(t, (c + k + 1,)), (c + k, r, rank[4 * s + t], s))
        by_audit = sorted(found, key=lambda t: found[t][1:3])
        ways = {t: (found[t][0], place) for place, t in enumerate(by_audit)}
        back.append({t: found[t][3] for t in found})
    cost, _, state = min((c + INSERT * len(CLOSING[t]), place, t) for t, (c, place) in ways.items())
    closing, spans = CLOSING[state], []
    for step in reversed(back):
        spans.append(4 * step[state] + state)
        state = step[state]
    return cost, spans[::-1], closing


def _chains(chunks: DataFrame) -> DataFrame:
    """A written table with one row a chunk: part, chunk, span, closing; at the last one
    of a conversation also last (true), and conv_id, cost and illegal of the whole."""
    links = F.sort_array(F.collect_list(F.struct("part", "chunk", "costs", "ranks", "illegal", F.substring("initials", 1, 1).alias("first"), F.substring("initials", -1, 1).alias("end"))))
    whole = chunks.groupBy("conv_id").agg(links.alias("links"))
    names = ["conv_id", "part", "chunk", "span", "closing", "last", "cost", "illegal"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, links in zip(batch.column("conv_id").to_pylist(), batch.column("links").to_pylist(), strict=True):
                cost, spans, closing = chain([x["costs"] for x in links], [x["ranks"] for x in links])
                illegal = sum(x["illegal"] for x in links) + sum(x["end"] + y["first"] not in LEGAL for x, y in zip(links, links[1:], strict=False))
                for x, span in zip(links, spans, strict=True):
                    last = x is links[-1]
                    out.append((conv, x["part"], x["chunk"], span, closing if last else "", last, cost, illegal))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return common.staged(common.map_arrow(whole, run, "conv_id long, part int, chunk long, span int, closing string, last boolean, cost long, illegal long"), "repair-chains")


def _edits(decided: DataFrame) -> DataFrame:
    """(row, place, before, edit, new_role, after) of every row."""
    names = ["row", "part", "chunk", "nth", "before", "edit", "new_role", "after"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                found = edits(chunk["initials"], chunk["span"] // 4, chunk["audit"])
                out = [(row, chunk["part"], chunk["chunk"], i, *e) for i, (row, e) in enumerate(zip(chunk["rows"], found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    found = common.map_arrow(decided.select("part", "chunk", "rows", "initials", "span", "audit"), run, "row long, part int, chunk long, nth int, before string, edit string, new_role string, after string")
    return found.withColumn("place", F.struct("part", "chunk", "nth")).drop("part", "chunk", "nth")


def repair(conversations: DataFrame, chunk: int = CHUNK) -> Repair:
    """Repairs the conversations of ``conversations (conv_id, turn, role, text)``."""
    rows = _numbered(conversations)
    items = common.staged(_items(rows), "repair-items")
    chunks = _chunks(items, chunk)
    chains = _chains(chunks)
    audit = F.concat(F.element_at("audits", F.col("span") + 1), "closing")
    decided = chunks.drop("illegal", "conv_id").join(chains.select("conv_id", "part", "chunk", "span", "closing"), ["part", "chunk"]).withColumn("audit", audit)

    inserted = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: _message("I", F.when(x == "u", ROLES[USER]).otherwise(ROLES[ASSISTANT]), F.lit("")))
    own = F.when(F.col("edit") != "D", F.array(_message(F.col("edit"), F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role")), F.col("text"))))
    own = F.coalesce(own, F.array().cast("array<struct<edit: string, role: string, text: string>>"))
    out = rows.select("row", "conv_id", "role", "text").join(_edits(decided), "row")
    messages = out.select("conv_id", "place", F.posexplode(F.concat(inserted("before"), own, inserted("after"))).alias("nth", "m"))
    messages = messages.select("conv_id", F.struct("place.*", F.col("nth").alias("line")).alias("place"), "m.*")

    turns = items.groupBy("conv_id", "turn").agg(*(F.sum((F.col("fault") == name[0]).cast("long")).alias(name) for name in FAULTS))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(name).alias(name) for name in FAULTS))
    audits = decided.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    last = chains.filter("last").select("conv_id", "illegal", "cost")
    return Repair(messages, _joined(_joined(counts, last), audits))


def _message(edit: Column, role: Column, text: Column) -> Column:
    return F.struct((F.lit(edit) if isinstance(edit, str) else edit).alias("edit"), role.alias("role"), text.alias("text"))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join by conv_id; a null one meets a null one."""
    right = right.withColumnRenamed("conv_id", "other_id")
    return left.join(right, left["conv_id"].eqNullSafe(right["other_id"]), "left").drop("other_id")


def message_digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over the ``role:text`` of a conversation's messages,
    joined by line feeds. A task sorts its conversations and streams through them, so a
    conversation of any length takes no memory; sha256 allows no split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            ids, digests = [], []
            for c, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        ids.append(conv)
                        digests.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    lines = messages.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line")).repartition(common.shuffle_partitions(messages), "conv_id").sortWithinPartitions("conv_id", "place")
    return common.map_arrow(lines.select("conv_id", "line"), run, "conv_id long, repaired_sha256 string")


def damage_and_repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every conv_id of ``conversations`` with the faults that ``damaged`` leaves, the
    cheapest repair's cost and audit, and the sha256 of the repaired messages."""
    found = repair(damaged(conversations), chunk)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = _joined(_joined(ids, found.summary), message_digests(found.messages))
    zeros = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", *FAULTS, "illegal", "cost")}
    return every.select("conv_id", *(zeros[c].alias(c) for c in zeros), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
