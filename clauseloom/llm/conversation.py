"""Repair of conversation structure by alignment with an alternating grammar.

The roles of a sound conversation spell ``(s?(ua)+)?``: nothing, or user and assistant in
turn, once preceded by system.  A conversation is aligned (Wagner and Fischer) with the one
string that the grammar has of each feasible length.  Ukkonen's band keeps the cells that
can still lie on a path no dearer than the cheapest alignment so far, lengths are taken
nearest first until none can be as cheap, and of equally cheap alignments the traced-back
audits are compared.

One shuffle brings the rows of a conversation together, sorted.  Each row comes twice:
first without its text (role, fault, digest), so that the audit is known, then with it, so
that texts stream through and none is held.  A task holds some 50 bytes for each turn of
the conversation it is at, however large the conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.store import column

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Above so many rows to align, all lengths are aligned at once (see align_long).
LONG = 512
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
_BATCH_ROWS, _BATCH_CHARS = 4096, 1 << 22


def _target(length: int) -> str:
    return ("s" if length % 2 else "") + "ua" * (length // 2)


def _aligned(rows: str, target: str, most: int) -> tuple[int, str] | None:
    """The cheapest alignment of the rows with one target, if it costs at most ``most``.

    A row is the initial of its role, in capitals if it is truncated.  ``cost[i][j]`` is
    the price of the rows from i on against the target from j on; only diagonals inside
    the band are filled.  Of equally cheap audits the ASCII-least is traced.
    """
    n, m = len(rows), len(target)
    loose = most - sum(map(str.isupper, rows)) - 2 * abs(m - n)
    if loose < 0:
        return None
    low, high = min(0, m - n) - loose // 4, max(0, m - n) + loose // 4
    width = high - low + 1
    after, table = [_FAR] * (width + 2), [None] * (n + 1)
    for i in range(n, -1, -1):
        line = [_FAR] * (width + 2)  # place k + 1 holds j = i + low + k
        first, last = max(0, -(i + low)), min(width - 1, m - i - low)
        if i < n:
            initial, late = rows[i].lower(), TRUNCATED_COST * rows[i].isupper()
        for k in range(last, first - 1, -1):
            j = i + low + k
            if i == n and j == m:
                line[k + 1] = 0
                continue
            best = _FAR
            if i < n:
                best = DELETE_COST + after[k]  # row i + 1, same j: one diagonal down
            if j < m:
                wanted = target[j]
                if wanted != "s":
                    best = min(best, INSERT_COST + line[k + 2])
                if i < n and (initial == wanted or wanted != "s"):
                    best = min(best, after[k + 1] + late + REROLE_COST * (initial != wanted))
            line[k + 1] = best
        table[i] = after = line
    if not 0 <= -low < width or table[0][1 - low] > most:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        k = j - i - low
        now = table[i][k + 1]
        if i < n and table[i + 1][k] + DELETE_COST == now:
            audit.append(DELETE)
            i += 1
        elif j < m and target[j] != "s" and table[i][k + 2] + INSERT_COST == now:
            audit.append(INSERT)
            j += 1
        else:
            audit.append(KEEP if rows[i].lower() == target[j] else REROLE)
            i, j = i + 1, j + 1
    return table[0][1 - low], "".join(audit)


def align(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows none of which has to go."""
    if len(rows) > LONG:
        return align_long(rows)
    n, late = len(rows), sum(map(str.isupper, rows))
    most = REROLE_COST * n + DELETE_COST + late  # every role given anew
    best = None
    system = "s" in rows.lower()
    for length in sorted((x for x in range(0, 2 * n + 4) if x != 1 and (system or x % 2 == 0)),
                         key=lambda x: abs(x - n)):
        if late + 2 * abs(length - n) > most:
            break
        found = _aligned(rows, _target(length), most)
        if found and (best is None or found < best):
            best, most = found, found[0]
    return best


_remembered = lru_cache(1 << 16)(align)


def align_long(rows: str) -> tuple[int, str]:
    """The same as ``align``, over the four states of the grammar instead of each length.

    States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  Linear in the
    rows, so conversations without end are served too.
    """
    n = len(rows)
    wanted, then = "uuau", (2, 2, 3, 2)
    lines = [None] * (n + 1)
    after = None
    for i in range(n, -1, -1):
        line = [0, _FAR, _FAR, 0] if i == n else [0] * 4
        if i < n:
            initial, late = rows[i].lower(), TRUNCATED_COST * rows[i].isupper()
            for state in range(4):
                best = DELETE_COST + after[state]
                best = min(best, late + REROLE_COST * (initial != wanted[state]) + after[then[state]])
                if state == 0 and initial == "s":
                    best = min(best, late + after[1])
                line[state] = best
        for _ in range(2):
            line = [min(x, INSERT_COST + line[then[state]]) for state, x in enumerate(line)]
        lines[i] = after = tuple(line)
    i = state = 0
    audit = []
    while True:
        now = lines[i][state]
        if i == n and now == 0:
            return lines[0][0], "".join(audit)
        if i < n and lines[i + 1][state] + DELETE_COST == now:
            audit.append(DELETE)
            i += 1
        elif lines[i][then[state]] + INSERT_COST == now:
            audit.append(INSERT)
            state = then[state]
        else:
            initial, late = rows[i].lower(), TRUNCATED_COST * rows[i].isupper()
            i += 1
            if state == 0 and initial == "s" and lines[i][1] + late == now:
                state = 1
                audit.append(KEEP)
            else:
                audit.append(KEEP if initial == wanted[state] else REROLE)
                state = then[state]


def plan(initials: list[str], faults: list[str]) -> tuple[int, str]:
    """(cost, audit) for all rows of a conversation, the ones that have to go included.

    Rows that have to go leave the alignment; their D stands right behind the edit of the
    row before them, as D is the least initial.
    """
    rows = "".join(
        (a if a in ("s", "u", "a") else "x").upper() if f == "truncated" else (a if a in ("s", "u", "a") else "x")
        for a, f in zip(initials, faults) if f not in ("blank", "duplicate"))
    cost, found = _remembered(rows) if len(rows) <= 64 else align(rows)
    audit, at = [], 0
    for fault in faults:
        if fault in ("blank", "duplicate"):
            audit.append(DELETE)
            cost += DELETE_COST
            continue
        while found[at] == INSERT:
            audit.append(INSERT)
            at += 1
        audit.append(found[at])
        at += 1
    return cost, "".join(audit) + found[at:]


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by crc32(``conv_id:turn``) % 20.

    0 drops the row (it stays as a row that is not present, so that its conversation is
    known), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's.
    A null is one space: in the key, as role and as text; conv_id and turn stay null.
    """
    def spaced(name):
        return F.coalesce(column(turns, name).cast("string"), F.lit(" "))

    key = F.concat(spaced(conv_id), F.lit(":"), spaced(turn))
    said = turns.select(
        column(turns, conv_id).alias("conv_id"), column(turns, turn).cast("long").alias("turn"),
        spaced(role).alias("role"), spaced(text).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    code = F.col("code")
    copy = F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy")
    return said.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (code != 0).alias("present"), copy).drop("copy")


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """The rows of one conversation, without texts, and how far its edits have been told."""

    def __init__(self, conv_id):
        self.conv_id, self.initials, self.faults = conv_id, [], []
        self.seen, self.turns, self.distinct = set(), [], 0
        self.audit, self.at, self.row, self.place, self.length = None, 0, 0, 0, 0

    def add(self, turn, role, digest, blank, truncated):
        if turn is not None and (not self.turns or self.turns[1] != turn):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1
        fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if truncated else None
        self.seen.add(digest)
        self.initials.append(role[:1])
        self.faults.append(fault)

    def report(self) -> dict:
        self.seen = None
        cost, self.audit = plan(self.initials, self.faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        low, high = self.turns or (0, -1)
        return {"place": -1, "gaps": high - low + 1 - self.distinct, "illegal": illegal, "cost": cost,
                **{f: self.faults.count(f) for f in ("blank", "duplicate", "truncated")}}

    def _row(self, edit, **more) -> dict:
        self.place += 1
        return {"place": self.place - 1, "edit": edit, **more}

    def _next_role(self) -> str:
        return "assistant" if self.length % 2 else "user"

    def inserts(self) -> Iterator[dict]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            yield self._row(INSERT, role=self._next_role(), text="")
            self.at, self.length = self.at + 1, self.length + 1

    def tell(self, turn, role, text) -> Iterator[dict]:
        yield from self.inserts()
        edit, fault = self.audit[self.at], self.faults[self.row]
        self.at, self.row = self.at + 1, self.row + 1
        if edit == REROLE:
            role = self._next_role()
        yield self._row(edit, fault=fault, turn=turn, role=role, text=text)
        # a leading system row does not count in the alternation of user and assistant
        self.length += edit != DELETE and not (edit == KEEP and role[:1] == "s")


def _repair(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, now = [], 0, None

        def rows(batch):
            nonlocal now
            for conv_id, started, phase, turn, role, digest, blank, truncated, text in zip(
                    *(batch[c].to_pylist() for c in ("conv_id", "fresh", "phase", "turn", "role", "digest", "blank",
                                                     "truncated", "text"))):
                if now is None or now.conv_id != conv_id:
                    yield from end()
                    now = _Conversation(conv_id)
                if phase == 0:
                    if started:
                        now.add(turn, role, digest, blank, truncated)
                    continue
                if now.audit is None:
                    yield {"conv_id": now.conv_id, **now.report()}
                for row in now.tell(turn, role, text):
                    yield {"conv_id": now.conv_id, **row}

        def end():
            if now is None:
                return
            if now.audit is None:
                yield {"conv_id": now.conv_id, **now.report()}
            for row in now.inserts():
                yield {"conv_id": now.conv_id, **row}

        for batch in batches:
            for row in rows(batch):
                held.append(row)
                chars += len(row.get("text") or "")
                if len(held) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, chars = [], 0
        held += end()
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns of ``damage``'s rows, with the edit of each and a report.

    ``turns`` has conv_id, turn, role, text and, if rows may be absent, present.  Returns a
    row for each edit of a conversation, in order of ``place``: edit (K, R, D, I), fault
    (blank, duplicate, truncated or null), turn, role, text; a deleted row shows what it
    was.  Before them, at place -1, stands a row with the conversation's gaps, faults,
    illegal neighbours and cost.

    Rows are taken by turn, nulls first, then by role and by the digest of role and text;
    equal rows stay side by side.  Null ids are one conversation; nulls in role and text
    are one space.  A conversation without rows has its report alone.
    """
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    said = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(present, F.lit(True)).alias("fresh"))
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    marked = said.select(
        "*", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256)).alias("digest"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
        F.explode(F.when(F.col("fresh"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("phase"))
    twice = marked.withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    ordered = twice.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "digest")
    kind = turns.schema["conv_id"].dataType
    out = T.StructType([
        T.StructField("conv_id", kind), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("fault", T.StringType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in _REPORT)])
    return ordered.mapInArrow(_repair(_arrow(out)), out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest = None, [], None

        def done():
            return pa.RecordBatch.from_pylist(
                [{**now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["place"] == -1:
                    if now is not None:
                        yield done()
                    now, audit, digest, between = {c: row[c] for c in ["conv_id", *_REPORT]}, [], hashlib.sha256(), ""
                    continue
                audit.append(row["edit"])
                if row["edit"] != DELETE:
                    digest.update(f"{between}{row['role']}:{row['text']}".encode())
                    between = "\n"
        if now is not None:
            yield done()

    return run


def repair_digests(repaired: DataFrame) -> DataFrame:
    """A row per conversation: its report, its audit, and the SHA-256 of its repaired turns.

    ``repaired`` comes straight from ``repair``, in whose order rows still stand.  The
    digest is that of ``role:text`` of the turns that stay, joined by newlines.
    """
    out = T.StructType([
        repaired.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _REPORT),
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return repaired.mapInArrow(_digests(_arrow(out)), out)
