"""Mixing sources to target weights by balanced sampling (the cube method).

A document of a source whose target is r times its size is taken floor(r) times, and once
more with probability p = r - floor(r).  The extra takes are drawn by the cube method: a
vector of probabilities is moved along directions that change neither the number of
documents nor the number of words expected, until all but two of them are 0 or 1.  This
flight runs in parts of each source at once; what the parts leave open flies again
together, so both totals hold exactly up to the last two documents of a source.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut, fresh, row_key
from clauseloom.operators.positions import numbered
from clauseloom.session import fan_out

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one task flies at once.
PART = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources in order of code points, null last, take the weights in turn and share
    ``share`` of all sizes; a target over ``most`` times its source's size stops there and
    the excess is shared again by weight.  With the sources sorted by cap per weight, the
    capped ones come first, so one pass of running sums finds the level.  The windows
    hold one row per source, never documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    levelled = weighed.withColumns({"level": level, "bound": F.col("cap") / F.col("w")})
    # the level holds from the first source on that stays under its cap
    stays = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("bound", "level"))
    levelled = levelled.withColumn("level", F.min(stays).over(whole)["level"])
    return levelled.select(
        "source", "source_size",
        F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def flight(size: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Move ``p`` until at most two entries are strictly between 0 and 1.

    Three open entries at a time: (1, 1, 1) and their sizes span the constraints, and the
    cross product of the two is the direction that keeps both sums.
    """
    p = list(p)
    held: list[int] = []
    eps = 1e-9
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for k, d in zip(held, u):
                p[k] += step * d
                if not eps < p[k] < 1 - eps:
                    p[k] = float(round(p[k]))
            held = [k for k in held if 0 < p[k] < 1]
    return p


def land(size: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Settle the last open entries: keep their expected number, then the nearer words."""
    p = list(p)
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    if len(open_) == 2:
        a, b = open_
        want = p[a] * size[a] + p[b] * size[b]
        choices = [(0, 0), (0, 1), (1, 0), (1, 1)]
        x, y = min(choices, key=lambda c: (abs(c[0] * size[a] + c[1] * size[b] - want), c))
        p[a], p[b] = float(x), float(y)
    elif open_:
        p[open_[0]] = float(rng.random() < p[open_[0]])
    return p


def _fly(last: bool, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "k1", "k2", "size"], kind="stable").reset_index(drop=True)
        first = group.iloc[0]
        rng = random.Random(f"{seed} {first['h']} {first['k1']} {first['k2']} {len(group)}")
        size, p = group["size"].tolist(), flight(group["size"].tolist(), group["p"].tolist(), rng)
        group["p"] = land(size, p, rng) if last else p
        return group

    return run


def dealt(sized: DataFrame, goal: DataFrame, part: int, seed: int) -> DataFrame:
    """The rows with their source's target, each in one of its source's parts.

    Rows alike in everything are counted first and then dealt out by number, or one
    document that fills a third of the table would be a whole part.  A document of more
    rows than a part comes out of its count in blocks, which tasks share.
    """
    alike = sized.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count("*").alias("alike"))
    alike = alike.join(goal, alike.source.eqNullSafe(goal.s)).drop("s")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / part))
    many = fan_out(alike.where(F.col("alike") > part).withColumn("block", F.explode(blocks)),
                   F.col("k1"), F.col("k2"), F.col("block"))
    few = alike.where(F.col("alike") <= part).withColumn("block", F.lit(0).cast("long"))
    first = F.col("block") * part
    numbers = F.sequence(first, F.least(first + part, F.col("alike")) - 1)
    rows = few.unionByName(many).withColumn("number", F.explode(numbers))
    rows = rows.withColumn("h", F.xxhash64("k1", "k2", F.lit(seed)))
    return rows.withColumn("part", F.pmod(F.xxhash64("h", "number", F.lit("part")), F.col("parts"))) \
        .drop("block", "number", "alike")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
        most: float = 2.0, seed: int = 42, part: int = PART, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, times) and the row's keys k1, k2 per document.

    ``times`` is how often the mix takes the document, at most ``ceil(most)``; ``taken`` is
    times its size.  Null texts have size 0; a null source is a source.  The same input
    gives the same mix, however it is split.  A source is flown in parts of about ``part``
    documents chosen by hash, so that one that holds a third of all rows is many tasks.
    """
    k1, k2 = row_key(column(docs, doc_id), column(docs, text))
    sized = cut(docs.select(
        column(docs, doc_id).alias("doc_id"), column(docs, source).cast("string").alias("source"),
        word_count(column(docs, text)).alias("size"), k1.alias("k1"), k2.alias("k2")), "sizes")
    goal = targets(sized, weights, share, most)
    counted = sized.groupBy("source").agg(F.count("*").alias("docs"))
    goal = cut(goal.join(counted, goal.source.eqNullSafe(counted.source)).select(
        goal.source.alias("s"), "source_size", "target",
        F.ceil(F.col("docs") / part).cast("long").alias("parts")), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = dealt(sized, goal, part, seed).withColumn("rate", rate)
    rows = rows.withColumns({"whole": F.floor("rate"), "p": F.col("rate") - F.floor("rate")})
    rows = rows.select("doc_id", "source", "size", "k1", "k2", "source_size", "target", "h", "whole", "p", "part", "parts")
    schema = rows.schema
    state = cut(rows.groupBy("source", "part").applyInPandas(_fly(False, seed), schema), "flown")
    settled = []
    while True:
        open_ = state.where("p > 0 and p < 1")
        settled.append(state.where("p = 0 or p = 1"))
        # each part leaves at most two; fly these together until one part per source is left
        widest = open_.agg(F.max("parts")).first()[0]
        if widest is None:
            break
        last = widest <= max(1, part // 2)
        merged = open_.withColumn("parts", F.ceil(2 * F.col("parts") / part).cast("long") if not last else F.lit(1).cast("long"))
        merged = merged.withColumn("part", F.pmod(F.col("part"), F.col("parts")))
        state = cut(merged.groupBy("source", "part").applyInPandas(_fly(last, seed + 1), schema), "flown")
        if last:
            settled.append(state)
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    times = (F.col("whole") + F.col("p")).cast("int")
    return out.select("doc_id", "size", "source_size", "target",
                      (times * F.col("size")).cast("long").alias("taken"), times.alias("times"), "k1", "k2")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it.

    Rows alike in id and text take each their own number; their sum is what comes out.  The
    numbers follow the rows' places in ``docs``, a written table whose places do not change
    when a task runs again, and are counted over ranges, so alike rows need not meet in a task.
    """
    a, b, times, n, copies, row, place = (
        fresh(x, docs) for x in ("k1", "k2", "times", "rows", "copies", "row", "place"))
    takes = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    # of n alike rows that together are taken t times, row i comes out t div n or one more times
    per = takes.groupBy("k1", "k2").agg(F.sum("times").alias(times), F.count("*").alias(n))
    per = per.where(F.col(times) > 0).select(F.col("k1").alias(a), F.col("k2").alias(b), times, n)
    k1, k2 = row_key(column(docs, doc_id), column(docs, text))
    per = cut(per, "takes")
    placed = docs.withColumns({a: k1, b: k2, row: F.monotonically_increasing_id()})
    single = placed.join(per.where(F.col(n) == 1), [a, b]).withColumn(copies, F.col(times).cast("long"))
    # only the keys of alike rows are put in order
    several = per.where(F.col(n) > 1)
    order = numbered(placed.select(a, b, row).join(several.select(a, b), [a, b], "left_semi"), [a, b], [row], place)
    shared = placed.join(order.select(row, place), row).join(several, [a, b]).withColumn(
        copies, F.floor((F.col(times) + F.col(place)) / F.col(n)).cast("long"))
    spread = single.unionByName(shared.select(*[column(shared, c) for c in single.columns]))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long")))
    return spread.where(F.col(copies) > 0).withColumn(times, each).select(*[column(docs, c) for c in docs.columns])
