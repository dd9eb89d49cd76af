"""Conversation repair against an exhaustive search and a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import pytest

from clauseloom.llm import conversation

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def exhaustive(rows):
    """The least (cost, audit) over all edit sequences with up to three inserts."""
    best = None
    for inserts in range(4):
        for word in set(product("DKuaI", repeat=len(rows) + inserts)):
            if sum(x in "I" for x in word) != inserts:
                continue
            for new in product("ua", repeat=inserts):
                cost, out, at, added = 0, "", 0, iter(new)
                for x in word:
                    if x == "I":
                        cost, out = cost + 2, out + next(added)
                        continue
                    row, at = rows[at], at + 1
                    if x == "D":
                        cost += 3
                        continue
                    cost += row.isupper() + (2 if x in "ua" else 0)
                    out += row.lower() if x == "K" else x
                if re.fullmatch("(s?(ua)+)?", out):
                    audit = "".join("R" if x in "ua" else x for x in word)
                    best = min(best or (cost, audit), (cost, audit))
    return best


def searched(rows):
    """The least (cost, audit) by memory over (row, state); rows None have to go."""
    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in "0a" else []

        def then(cost, edit, *place):
            rest = best(*place)
            if rest:
                found.append((cost + rest[0], edit + rest[1]))

        follow = "a" if state == "u" else "u"
        if inserted < 2:
            then(2, "I", i, follow, inserted + 1)
        if i < len(rows):
            then(3, "D", i + 1, state, 0)
            if rows[i] is not None:
                late = rows[i].isupper()
                if rows[i].lower() == follow or state == "0" and rows[i].lower() == "s":
                    then(late, "K", i + 1, rows[i].lower(), 0)
                then(2 + late, "R", i + 1, follow, 0)
        return min(found, default=None)

    for i in range(len(rows), -1, -1):  # from the end, so that calls do not nest deeply
        for state, inserted in product("0sua", (2, 1, 0)):
            best(i, state, inserted)
    return best(0, "0", 0)


def plainly(rows):
    """The contract row by row: {conv_id: the report's values}."""
    space, white = " ", " \t\n\x0b\x0c\r"
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (space if x is None else x for x in (role, text))
        key = f"{space if conv is None else conv}:{space if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        kept = by[conv]
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [] if code == 0 else [(turn, role, text)] * (1 + (code == 3))
    out = {}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            last = text.strip(white)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen
                          else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        codes = [None if f in ("blank", "duplicate") else
                 (lambda c: c.upper() if f == "truncated" else c)(r[:1] if r[:1] in ("u", "a", "s") else "x")
                 for f, (_, r, _) in zip(faults, kept)]
        cost, audit = searched(tuple(codes))
        left, at, alternate = [], 0, 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            if edit in "RI":
                role = ("user", "assistant")[alternate % 2]
            left.append(f"{role}:{text}")
            alternate += not (edit == "K" and role[0] == "s")
        turns = {t for t, _, _ in kept if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def digests(frame):
    rows = conversation.repair_digests(conversation.repair(conversation.damage(frame))).collect()
    found = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in rows}
    assert len(found) == len(rows)
    return found


def test_alignments():
    for n in range(4):
        for rows in product("uasxUASX", repeat=n):
            wanted = exhaustive(rows) if n < 3 else searched(rows)
            text = "".join(rows)
            assert searched(rows) == wanted
            assert conversation.align(text) == conversation.align_long(text) == wanted


def test_long_alignments(monkeypatch):
    rng = random.Random(5)
    for n in (20, 90, 300):
        text = "".join(rng.choice("uauauauasxUA") if rng.random() < 0.3 else "ua"[i % 2] for i in range(n))
        assert conversation.align(text) == conversation.align_long(text) == searched(tuple(text))
    monkeypatch.setattr(conversation, "LONG", 0)
    assert conversation.align("ssuA" * 3) == searched(tuple("ssuA" * 3))


def test_given_rows(spark):
    frame = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert digests(frame) == plainly([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No", "", " \n\t", None, "What?  ", "é!", " ", "Yes.", "a" * 300_000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts))
            for _ in range(600)]
    rows += [(100 + i, 0, "user", "Once.") for i in range(80)] + [(7, t, "user", "Again.") for t in range(50)]
    return rows


def test_odd_rows(spark, odd):
    rows = [(*r, "extra", 1, True) for r in odd]
    frame = spark.createDataFrame(rows, SCHEMA + ", fault string, place int, `odd.name` boolean").repartition(7)
    found = digests(frame)
    assert found == plainly(odd)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert any(v == empty for v in found.values())  # conversations that lost every row


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well"), (1, 2, "assistant", "So."), (2, None, None, None)]
    frame = conversation.repair(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r)[:7] for r in frame.where("place >= 0").orderBy("conv_id", "place").collect()]
    # taking out the truncated turn costs 3, as does answering the first one and keeping it
    assert got == [(1, 0, "K", None, 0, "user", "Hi."), (1, 1, "D", "truncated", 1, "user", "Well"),
                   (1, 2, "K", None, 2, "assistant", "So."), (2, 0, "D", "blank", None, " ", " ")]


def test_one_conversation_with_most_rows(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(3000)]
    rows += [(2, t, "user", f"Turn {t}.") for t in range(5)]
    assert digests(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)


def test_no_rows(spark):
    assert digests(spark.createDataFrame([], SCHEMA)) == {}
