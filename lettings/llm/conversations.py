"""Repair of conversation structure: cheapest edits by a dynamic program that keeps costs only at checkpoints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lettings.llm.common import dealt_by_key, sorted_runs, written

#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block at least; a longer conversation has blocks of about the root of its rows.
BLOCK = 4096
FAR = 1 << 60
#: States by the last role: none yet, system, user, assistant; a conversation may end in the first or the last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that may be made in each state (by renaming or inserting), and the state after it.
MADE = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
NOT_BLANK = r"[^\x20\x09-\x0D]"

Costs = tuple[int, int, int, int]


def relaxed(costs: Sequence[int]) -> Costs:
    """Costs with rows inserted first where that is cheaper."""
    begin, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(begin, INSERT + user), min(system, INSERT + user), user, assistant


#: Costs from each state behind the last row.
END = relaxed((0, FAR, FAR, 0))


def choices(initial: str, fault: str, state: int, after: Costs) -> tuple[int, int, int]:
    """Costs of deleting, keeping and renaming a row in a state, given the costs after it."""
    delete = DELETE + after[state]
    if fault in ("b", "d"):
        return delete, FAR, FAR
    more = TRUNCATED if fault == "t" else 0
    to = NEXT.get((state, initial))
    return delete, FAR if to is None else more + after[to], RENAME + more + after[AFTER[state]]


def before(initial: str, fault: str, after: Costs) -> Costs:
    """Costs from each state before a row (and what is inserted before it)."""
    return relaxed([min(choices(initial, fault, s, after)) for s in range(4)])


def walk(initials: Sequence[str], faults: Sequence[str], end: Costs, state: int) -> tuple[list[tuple[str, str]], int]:
    """The cheapest edits of some rows from a state on, of equal costs the ASCII-least.

    ``end`` has the costs behind the rows.  Costs are computed backwards but kept only at
    every root of n rows; walking forward, those of one stretch at a time are computed
    again.  Gives inserted roles and the edit of each row, and the last state.
    """
    n = len(initials)
    step = max(1, math.isqrt(n))
    kept: dict[int, Costs] = {n: end}
    costs = end
    for i in range(n - 1, -1, -1):
        costs = before(initials[i], faults[i], costs)
        if i % step == 0:
            kept[i] = costs
    edits: list[tuple[str, str]] = []
    for first in range(0, n, step):
        last = min(first + step, n)
        stretch = [kept[last]]
        for i in range(last - 1, first - 1, -1):
            stretch.append(before(initials[i], faults[i], stretch[-1]))
        for i in range(first, last):
            now, after = stretch[last - i], stretch[last - i - 1]
            added = ""
            while True:  # D before I before K before R
                delete, keep, rename = choices(initials[i], faults[i], state, after)
                if delete == now[state]:
                    edits.append((added, "D"))
                elif INSERT + now[AFTER[state]] == now[state]:
                    added += MADE[state][0]
                    state = AFTER[state]
                    continue
                elif keep == now[state]:
                    edits.append((added, "K"))
                    state = NEXT[state, initials[i]]
                else:
                    edits.append((added, "R" + MADE[state][0]))
                    state = AFTER[state]
                break
    return edits, state


def tail(state: int) -> str:
    """Initials of the rows inserted behind the last row."""
    return {BEGIN: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


def faults(role: Column, text: Column, again: Column) -> Column:
    """The first fault of a row: b(lank), d(uplicate), t(runcated) or none."""
    return (
        F.when(~text.rlike(NOT_BLANK), "b").when(again, "d")
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("")
    )


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn: some dropped, emptied, unended, repeated, renamed."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(key) % 20
    stopless = F.translate(F.col(text), ".!?", "")
    return rows.withColumns({role: F.coalesce(role, F.lit(" ")), text: F.coalesce(text, F.lit(" "))}).withColumn(
        "__kind", kind
    ).where("__kind <> 0").withColumns({
        text: F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, stopless).otherwise(F.col(text)),
        role: F.when(F.col("__kind") == 4, "user").otherwise(F.col(role)),
        "__copy": F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    }).drop("__kind", "__copy")


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows as a table with ``at``, which rises with conversation, turn (nulls first), role and text.

    They are range-partitioned, also inside of a conversation; equal rows are told apart
    by a number, so that not even many copies of one row are one task.  The rows have to
    come from a table (through filters and expressions), so that a lost task finds them again.
    """
    base = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col(conv).cast("string")), F.lit("-")).alias("code"),
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("__tie"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "__tie")]
    placed = base.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.drop("__tie").withColumn("at", F.monotonically_increasing_id()))


def marked(rows: DataFrame) -> DataFrame:
    """``code``, ``at``, ``initial`` and ``fault`` of ordered rows; texts are not moved for it.

    First places of equal rows are combined before they are shuffled, and are joined by
    place, which no two rows share.
    """
    narrow = rows.select(
        "code", "at", F.col("role").substr(1, 1).alias("initial"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("__same"),
        faults(F.col("role"), F.col("text"), F.lit(False)).alias("__fault"),
    )
    firsts = narrow.groupBy("code", "__same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("__first"))
    again = F.col("__first").isNull() & (F.col("__fault") != "b")
    return narrow.join(firsts, "at", "left").select(
        "code", "at", "initial", F.when(again, "d").otherwise(F.col("__fault")).alias("fault"),
    )


def block_rows(longest: int) -> int:
    return max(BLOCK, math.isqrt(longest) + 1)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list], list[tuple[int, int]]]]:
    """Columns of whole blocks as lists, and where each block lies in them."""
    for rows, edges in sorted_runs(batches, ["code", "block"]):
        yield rows.to_pydict(), list(zip(edges.tolist(), edges[1:].tolist(), strict=False))


def block_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block, from its first state and the costs at its end."""
    for rows, spans in blocks_of(batches):
        added, edit, to, behind = [], [], [], []
        for a, b in spans:
            end = tuple(rows["ends"][a]) if rows["ends"][a] else END
            found, final = walk(rows["initial"][a:b], rows["fault"][a:b], end, rows["state"][a] or BEGIN)
            added += [x for x, _ in found]
            edit += [e[0] for _, e in found]
            to += [e[1:] for _, e in found]
            behind += [""] * (b - a - 1) + ["" if rows["last"][a] is False else tail(final)]
        yield pa.RecordBatch.from_pydict({
            "at": pa.array(rows["at"], pa.int64()), "initial": rows["initial"], "fault": rows["fault"],
            "added": added, "edit": edit, "to": to, "behind": behind,
        })


def block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of each block from each state before it to each state after it (16 numbers)."""
    for rows, spans in blocks_of(batches):
        out = {"code": [], "block": [], "costs": []}
        for a, b in spans:
            columns = []
            for state in range(4):
                costs: Sequence[int] = [0 if s == state else FAR for s in range(4)]
                for i in range(b - 1, a - 1, -1):
                    costs = before(rows["initial"][i], rows["fault"][i], costs)
                columns.append(costs)
            out["code"].append(rows["code"][a])
            out["block"].append(rows["block"][a])
            out["costs"].append([min(c[s], FAR) for s in range(4) for c in columns])
        yield pa.RecordBatch.from_pydict(out)


def block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block for each state before it."""
    for rows, spans in blocks_of(batches):
        yield pa.RecordBatch.from_pydict({
            "code": [rows["code"][a] for a, _ in spans], "block": [rows["block"][a] for a, _ in spans],
            "to": [
                [walk(rows["initial"][a:b], rows["fault"][a:b], tuple(rows["ends"][a]), s)[1] for s in range(4)]
                for a, b in spans
            ],
        })


def backward(group: pd.DataFrame) -> pd.DataFrame:
    """Costs at the block ends of one conversation, from its last block to its first."""
    group = group.sort_values("block", ignore_index=True)
    at, ends = np.array(END, np.int64), []
    for costs in reversed(group["costs"]):
        ends.append(at.tolist())
        at = np.minimum((np.array(costs).reshape(4, 4) + at).min(axis=1), FAR)
    return pd.DataFrame({"code": group["code"], "block": group["block"], "ends": ends[::-1]})


def forward(group: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of one conversation, from its first block on."""
    group = group.sort_values("block", ignore_index=True)
    state, first = BEGIN, []
    for to in group["to"]:
        first.append(state)
        state = int(to[state])
    last = [False] * (len(group) - 1) + [True]
    return pd.DataFrame({"code": group["code"], "block": group["block"], "state": first, "last": last})


def checkpoints(cut: DataFrame) -> DataFrame:
    """For blocks of conversations with several: costs at the block's end, its first state, and whether it is the last."""
    keys = ["code", "block"]
    costs = dealt_by_key(cut, keys, ["at"]).mapInArrow(block_costs, "code string, block long, costs array<long>")
    ends = written(costs.groupBy("code").applyInPandas(backward, "code string, block long, ends array<long>"))
    to = dealt_by_key(cut.join(ends, keys), keys, ["at"]).mapInArrow(block_states, "code string, block long, to array<long>")
    first = to.groupBy("code").applyInPandas(forward, "code string, block long, state int, last boolean")
    return written(ends.join(first, keys))


def edits(steps: DataFrame) -> DataFrame:
    """Edits of marked rows: ``at``, ``added`` (initials inserted before), ``edit``, ``to`` and ``behind`` (inserted last).

    A conversation is cut in blocks of at least ``BLOCK`` rows, and of the root of its rows
    where it is longer.  Of several blocks each gives the costs between its states; the
    block ends are then the checkpoints of the conversation's backward costs, blocks give
    their last state for each first one, and these are followed forward.  Both go over one
    row per block, about the root of the rows; blocks are computed again in parallel.
    """
    part = F.shiftright("at", 33)
    longest = steps.groupBy("code").count().agg(F.max("count")).first()[0] or 0
    inside = F.col("at") - F.shiftleft(part, 33)  # a block never reaches over a partition of the ordered rows
    cut = steps.withColumn("block", F.col("at") - inside % block_rows(longest))
    blocks = cut.select("code", "block").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("blocks"))
    several = written(blocks.where("blocks > 1").select("code"))
    if several.isEmpty():
        ends = cut.sparkSession.createDataFrame([], "code string, block long, ends array<long>, state int, last boolean")
    else:
        ends = checkpoints(cut.join(several, "code"))
    spans = cut.join(ends, ["code", "block"], "left")
    return dealt_by_key(spans, ["code", "block"], ["at"]).mapInArrow(
        block_edits, "at long, initial string, fault string, added string, edit string, to string, behind string"
    )


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """The rows of each conversation in order, with their first fault and the cheapest edits that mend the structure.

    ``at`` rises in the order by turn (nulls first), role and text; ``fault`` is b(lank),
    d(uplicate), t(runcated) or empty; ``added`` and ``behind`` are initials of roles that
    are inserted, with empty text, before the row and behind the last one; ``edit`` is
    K(eep), R(ename, to the role with initial ``to``) or D(elete).  The roles then read
    system at most once, first, and pairs of user and assistant.  Of equally cheap edits
    the ASCII-least are taken.

    Null roles and texts count as one space: such a text is blank, such a role never fits;
    an empty role has no initial and never fits.  Null conversations are one conversation.
    Repeated rows are duplicates from the second on; an empty table gives no rows; other
    columns are not kept.  Long texts are only hashed and searched, not cut.
    """
    placed = ordered(rows, conv, turn, role, text)
    return placed.join(edits(written(marked(placed))), "at").select(
        "code", "conv", "turn", "at", "role", "text", "initial", "fault", "added", "edit", "to", "behind",
    )


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """The mended conversations as rows: ``conv``, ``at`` and ``nth`` (their order), ``role`` and ``text``."""
    def made(initials: Column) -> Column:
        return F.transform(
            F.filter(F.split(initials, ""), lambda i: i != ""),
            lambda i: F.struct(F.when(i == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")),
        )
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("to") == "u", "user").otherwise("assistant")
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
    )
    return repaired.select(
        "conv", "at", F.posexplode(F.concat(made(F.col("added")), own, made(F.col("behind")))).alias("nth", "row"),
    ).select("conv", "at", "nth", "row.role", "row.text")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order; only a hash, counts and the edits are held of it."""
    names = ("code", "turn", "initial", "fault", "added", "edit", "to", "behind", "role", "text")
    legal, made = {("s", "u"), ("u", "a"), ("a", "u")}, {"u": "user", "a": "assistant"}
    code = None
    out: dict[str, list] = {k: [] for k in DIGEST}

    def close() -> None:
        gaps = high - low + 1 - turns if low is not None else 0
        values = (code, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, "".join(audit), sha.hexdigest())
        for k, v in zip(DIGEST, values, strict=True):
            out[k].append(v)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({k: pa.array(v, DIGEST[k]) for k, v in out.items()})
        for v in out.values():
            v.clear()
        return batch

    for batch in batches:
        for c, turn, initial, fault, added, edit, to, behind, role, text in zip(
            *[batch.column(n).to_pylist() for n in names], strict=True
        ):
            if c != code:
                if code is not None:
                    close()
                code, low, high, turns, before_ = c, None, None, 0, None
                counts, illegal, cost, audit, sha, some = {"b": 0, "d": 0, "t": 0, "": 0}, 0, 0, [], hashlib.sha256(), False
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            counts[fault] += 1
            illegal += before_ is not None and (before_, initial) not in legal
            before_ = initial
            audit.append("I" * len(added) + edit + "I" * len(behind))
            cost += INSERT * len(added + behind) + (
                DELETE if edit == "D" else RENAME * (edit == "R") + TRUNCATED * (fault == "t"))
            lines = [f"{made[i]}:" for i in added]
            if edit != "D":
                lines.append(f"{role if edit == 'K' else made[to]}:{text}")
            lines += [f"{made[i]}:" for i in behind]
            if lines:
                sha.update((("\n" if some else "") + "\n".join(lines)).encode())
                some = True
        if len(out["code"]) >= 10_000:
            yield flush()
    if code is not None:
        close()
    yield flush()


DIGEST = {
    "code": pa.string(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
    "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
}


def digest(repaired: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation id of ``conversations``: its faults, the cost, the edits and a hash of what is left.

    The hash of a conversation goes over its texts one after the other, so each one's rows
    pass through one task, which holds a batch of them.
    """
    kinds = "code string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = dealt_by_key(repaired.drop("conv"), ["code"], ["at"]).mapInArrow(digests, kinds)
    ids = conversations.select(conv).distinct().withColumn(
        "code", F.coalesce(F.concat(F.lit("+"), F.col(conv).cast("string")), F.lit("-"))
    )
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, "code", "left").select(
        conv, *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
