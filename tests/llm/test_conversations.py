"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lettings.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
FITS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
MADE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def plain_repair(rows, ids):
    """The contract's row of each conversation, by trying all edits with at most three insertions in a row."""
    of = {i: [] for i in ids}
    for conv, *rest in rows:
        of[conv].append(tuple(rest))
    out = []
    for conv, own in of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            visible = VISIBLE.findall(text)
            faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]

        @functools.cache
        def best(i, state, inserted, own=own, faults=faults, initials=initials):
            ways = [(0, "", ())] if i == len(own) and state in ("", "a") else []

            def way(cost, edit, line, rest):
                if rest:
                    ways.append((cost + rest[0], edit + rest[1], line + rest[2]))

            role = MADE[state]
            if inserted < 3:
                way(3, "I", (role + ":",), best(i, role[0], inserted + 1))
            if i < len(own):
                way(4, "D", (), best(i + 1, state, 0))
                if faults[i] not in ("b", "d"):
                    more = 3 * (faults[i] == "t")
                    if (state, initials[i]) in FITS:
                        way(more, "K", (f"{own[i][1]}:{own[i][2]}",), best(i + 1, FITS[state, initials[i]], 0))
                    way(3 + more, "R", (f"{role}:{own[i][2]}",), best(i + 1, role[0], 0))
            return min(ways, default=None)

        for i in range(len(own), -1, -1):  # from the end, so that no call goes deep
            for state in MADE:
                best(i, state, 0)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = best(0, "", 0)
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    """Null conversations, turns, roles and texts, ties, odd roles, a very long text, many equal rows, a long conversation."""
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", None, "", "umbrella"]
    texts = [None, "", " ", "hi.", "ok?", "x", "é! ", "a.\n", "z", "é.", "same. "]
    out = [
        (conv, rng.choice([t, t, t, None, 3]), rng.choice(roles[: rng.choice([2, 7])]), rng.choice(texts))
        for conv in [*range(60), None] for t in range(rng.randrange(14))
    ]
    out += [(7, 1, "user", "again and again.")] * 200 + [(8, 40, "user", "long " * 300_000 + ".")]
    out += [(99, t // 2, rng.choice(["user", "assistant"]), f"t{rng.randrange(300)}{rng.choice(['.', ''])}") for t in range(600)]
    return out


def digest(df):
    got = conversations.digest(conversations.repair(conversations.damage(df)), df)
    return sorted(map(tuple, got.drop("clash").collect()), key=str)


@pytest.mark.parametrize("block", [conversations.BLOCK, 5])
def test_repair(spark, rows, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"code": F.lit(1), "at": F.lit(2), "edit": F.lit("x")})
    assert digest(df) == plain_repair(damaged(rows), {r[0] for r in rows})


def test_no_conversations(spark):
    assert digest(spark.createDataFrame([], SCHEMA)) == []


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert digest(df) == plain_repair(damaged(rows), {r[0] for r in rows})


def test_repaired_rows_have_the_structure(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fixed = conversations.repaired_rows(conversations.repair(df)).collect()
    of = {}
    for r in sorted(fixed, key=lambda r: (r["at"], r["nth"])):
        of.setdefault(r["conv"], []).append(r["role"][0])
    assert of and all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in of.values())


def test_only_checkpoints_and_one_stretch_are_held():
    n = 10_000
    held = []
    step = conversations.before

    def counted(*args):
        held.append(1)
        return step(*args)

    conversations.before, old = counted, conversations.before
    try:
        found, state = conversations.walk(["u", "a"] * (n // 2), [""] * n, conversations.END, conversations.BEGIN)
    finally:
        conversations.before = old
    assert "".join(e for _, e in found) == "K" * n and state == conversations.ASSISTANT
    assert len(held) == 2 * n  # each cost is computed once backwards and once more in its stretch
