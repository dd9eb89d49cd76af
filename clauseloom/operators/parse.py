"""Profile detection and clause splitting inside the document row.

A clause is the run of lines between two markers, a section the run of clauses
between two headings, a merged clause the run of fragments behind a kept clause.
Each of the three is a slice between consecutive start positions, so the parse
needs neither a sort nor a shuffle; clauses leave the row in one ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom import fixed, grammar
from clauseloom.functions.text import (
    INLINE_CLASS, SPACE_CLASS, anchored, islands, let, occurrences, positions, quick, strip, words,
)


def _no_text() -> Column:
    return F.lit(None).cast("string")


def content_lines(text: Column) -> Column:
    """Stripped, non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda l: l != "")


# -- detection ---------------------------------------------------------------

def signature_score(head: Column, profile: str) -> Column:
    """Phrase hits in lower-cased text; phrases inside one another all count."""
    total = F.lit(0).cast("long")
    for phrase in grammar.PROFILES[profile]["signatures"]:
        total = total + occurrences(head, F.lit(phrase))
    return total


def _openers(*profiles: str) -> str:
    patterns = [rule[0] for name in profiles for rule in grammar.PROFILES[name]["rules"]]
    return anchored(list(dict.fromkeys(patterns)))


def structure_score(lines: Column, profile: str) -> Column:
    """Lines any rule of the profile opens."""
    return F.size(F.filter(lines, lambda l: l.rlike(_openers(profile)))).cast("long")


def profile_scores(text: Column) -> Column:
    """Array of (score, order, profile), one element per non-generic profile."""
    head = text
    names = [name for name in grammar.PROFILES if name != fixed.GENERIC]

    def scored(low: Column, lines: Column) -> Column:
        return F.array(*[
            F.struct(
                (signature_score(low, name) * 10 + structure_score(lines, name) * 0.5)
                .cast("double").alias("score"),
                F.lit(-rank).alias("order"),
                F.lit(name).alias("profile"),
            ) for rank, name in enumerate(names)])

    def opening(h: Column) -> Column:
        # one pass with all grammars leaves the few lines worth a look per grammar
        return F.filter(content_lines(h), lambda l: l.rlike(_openers(*names)))

    return let(head, lambda h: let(F.lower(h), lambda low: let(
        opening(h), lambda lines: scored(low, lines))))


def detected(text: Column) -> Column:
    """struct(profile, confidence): strongest score, ties to the earlier profile."""
    def pick(scores: Column) -> Column:
        best = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["score"])
        found = best["score"] > 0
        return F.struct(
            F.when(found, best["profile"]).otherwise(F.lit(fixed.GENERIC)).alias("profile"),
            F.when(found, F.round(best["score"] / total, 3)).otherwise(F.lit(0.0))
            .alias("confidence"),
        )

    return let(profile_scores(text), pick)


def _lookup(key: Column, pairs: dict[str, str], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def profile_of_country(code: Column) -> Column:
    return _lookup(F.coalesce(code, F.lit("")),
                   {j[0]: j[5] for j in fixed.JURISDICTIONS}, F.lit(fixed.GENERIC))


def resolve(documents: DataFrame, requested: str = "country_code") -> DataFrame:
    """Add profile, country, whether it was detected, and confidence."""
    asked = F.upper(F.coalesce(F.nullif(F.col(requested), F.lit("")), F.lit(fixed.AUTO_COUNTRY)))
    automatic = F.col("_asked") == fixed.AUTO_COUNTRY
    implied = {j[5]: j[0] for j in fixed.JURISDICTIONS if j[5] != fixed.GENERIC}
    labels = {name: profile["label"] for name, profile in grammar.PROFILES.items()}
    stated = profile_of_country(F.col("_asked"))
    return (
        documents
        .withColumn("_asked", asked)
        .withColumn("_found", detected(F.col("text")))
        .withColumn("profile", F.when(automatic, F.col("_found.profile")).otherwise(stated))
        .withColumn("profile_label", _lookup(F.col("profile"), labels, F.lit("")))
        .withColumn("country_detected", automatic)
        .withColumn("confidence", F.when(
            automatic | (F.col("_found.profile") == stated), F.col("_found.confidence"))
            .otherwise(F.lit(0.0)))
        .withColumn(requested, F.when(automatic, _lookup(
            F.col("_found.profile"), implied, F.lit(fixed.DEFAULT_COUNTRY)))
            .otherwise(F.col("_asked")))
        .drop("_asked", "_found")
    )


# -- lines to markers --------------------------------------------------------

def _per_profile(profile: Column, build) -> Column:
    chosen = None
    for name in grammar.PROFILES:
        if name == fixed.GENERIC:
            continue
        condition = profile == name
        chosen = (F.when(condition, build(name)) if chosen is None
                  else chosen.when(condition, build(name)))
    return chosen.otherwise(build(fixed.GENERIC))


def is_noise(line: Column, profile: Column) -> Column:
    """Running headers and footers known for the publisher."""
    def noise(name: str) -> Column:
        patterns = grammar.PROFILES[name]["noise"]
        return line.rlike(anchored(patterns)) if patterns else F.lit(False)

    return _per_profile(profile, noise)


def _marker(number: Column, level: Column, opens: Column, rest: Column) -> Column:
    return F.struct(number.alias("number"), level.cast("int").alias("level"),
                    opens.alias("opens"), rest.alias("rest"))


def line_marker(line: Column, profile: Column) -> Column:
    """First matching rule as struct(number, level, opens, rest), null when none matches.

    A heading with too long a remainder is a reference inside prose: it opens a
    clause of level 2 but no section.
    """
    # most rules serve several grammars, so each is built once
    built: dict[tuple, tuple[Column, Column]] = {}

    def raw(rule: tuple) -> tuple[Column, Column]:
        if rule not in built:
            pattern, level, heading, prefix = rule
            built[rule] = (line.rlike(pattern), F.struct(
                F.regexp_extract(line, pattern, 1).alias("group"),
                F.regexp_replace(line, pattern, "").alias("rest"), F.lit(level).alias("level"),
                F.lit(heading).alias("heading"), F.lit(prefix).alias("prefix")))
        return built[rule]

    def rules(name: str) -> Column:
        chosen = F
        for rule in grammar.PROFILES[name]["rules"]:
            chosen = chosen.when(*raw(rule))
        return F.when(line.rlike(_openers(name)), chosen)

    def finished(match: Column) -> Column:
        number = F.when(match["prefix"] == "", F.rtrim(strip(match["group"]), F.lit("."))) \
            .otherwise(F.concat(match["prefix"], match["group"]))

        def marked(rest: Column) -> Column:
            opens = match["heading"] & (F.length(rest) <= fixed.HEADING_MAX_CHARS)
            level = F.when(match["heading"] & ~opens, 2).otherwise(match["level"])
            return _marker(number, level, opens, rest)

        return F.when(match.isNotNull(), let(strip(match["rest"]), marked))

    return let(_per_profile(profile, rules), finished)


def is_list_item(line: Column) -> Column:
    return line.rlike(grammar.LIST_MARKER)


def list_marker(line: Column) -> Column:
    """"(a)"-style marker for documents without any numbering."""
    label = F.regexp_extract(line, grammar.LIST_MARKER, 1)
    return F.when(is_list_item(line), _marker(
        F.btrim(label, F.lit("().")), F.lit(3), F.lit(False),
        strip(F.substring(line, F.length(label) + 1, F.length(line)))))


# -- markers to clauses ------------------------------------------------------

def reflowed(lines: Column) -> Column:
    """Lines joined into prose; list items keep a line of their own."""
    parts = F.transform(lines, lambda l, i: F.when(
        (i > 0) & is_list_item(l), F.concat(F.lit("\n"), l)).otherwise(l))
    # a single plain space stays as it is, so only other spaces and runs are matched
    runs = f"{quick(INLINE_CLASS)}{{2,}}|{quick(INLINE_CLASS[1:], r'\x00-\x1F\x7F-　')}"
    text = F.regexp_replace(F.array_join(parts, " "), runs, " ")
    return let(text, lambda t: strip(F.ltrim(strip(F.when(F.contains(t, F.lit("\n")), F.regexp_replace(
        t, f"{quick(SPACE_CLASS)}*\n{quick(SPACE_CLASS)}*", "\n")).otherwise(t)), F.lit(":-–— "))))


def looks_like_heading(line: Column) -> Column:
    """A short line without terminal punctuation; ``line`` is stripped."""
    upper = line.rlike(r"^\p{Lu}") | (line.rlike(r"\p{Lu}") & ~line.rlike(r"[\p{Ll}\p{Lt}]"))
    return (F.length(line).between(3, 80) & ~line.rlike(r"[.,;:]$") & ~is_list_item(line)
            & (F.size(words(line)) <= 10) & upper)


def titled(content: Column) -> Column:
    """struct(title, content): a heading-like first line becomes the title."""
    def parted(parts: Column) -> Column:
        head = strip(F.get(parts, F.lit(0)))
        tail = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        promoted = (tail != "") & looks_like_heading(head)
        return F.struct(F.when(promoted, head).alias("title"),
                        F.when(promoted, strip(tail)).otherwise(content).alias("content"))

    return let(F.split(content, "\n", 2), parted)


def _clause(number: Column, title: Column, content: Column, section: Column,
            level: Column) -> Column:
    return F.struct(number.alias("clause_number"), title.alias("title"),
                    content.alias("content"), section.alias("section"),
                    level.cast("int").alias("level"))


def segmented(lines: Column, markers: Column, text: Column) -> Column:
    """Clauses as they stand between markers, sections inherited, preamble in front.

    ``lines`` and ``markers`` are lambda variables.
    """
    def raw(starts: Column) -> Column:
        def one(start: Column, run: Column) -> Column:
            def build(mark: Column) -> Column:
                opening = F.when(mark["rest"] != "", F.array(mark["rest"])).otherwise(
                    F.array().cast("array<string>"))
                body = reflowed(F.concat(opening, F.slice(run, 2, F.size(run))))
                section = F.when(mark["opens"], strip(F.concat(
                    mark["number"], F.lit(" "), mark["rest"])))
                return let(titled(body), lambda t: _clause(
                    mark["number"], t["title"], t["content"], section, mark["level"]))

            return let(F.get(markers, start), build)

        return islands(lines, starts, one)

    def sectioned(clauses: Column) -> Column:
        heads = positions(F.transform(clauses, lambda c, i: (i == 0) | c["section"].isNotNull()))
        return let(heads, lambda starts: F.flatten(islands(
            clauses, starts, lambda s, run: let(
                F.get(clauses, s)["section"], lambda section: F.transform(
                    run, lambda c: _clause(c["clause_number"], c["title"], c["content"],
                                           section, c["level"]))))))

    def with_preamble(starts: Column) -> Column:
        opening = reflowed(F.slice(lines, F.lit(1), F.coalesce(F.get(starts, F.lit(0)), F.lit(0))))
        preamble = let(opening, lambda p: F.when(
            F.length(p) >= fixed.MIN_CLAUSE_CHARS,
            F.array(_clause(F.lit("0"), F.lit("Preamble"), p, _no_text(), F.lit(1))))
            .otherwise(F.array_compact(F.array(F.when(F.lit(False), _clause(
                F.lit("0"), F.lit("Preamble"), p, _no_text(), F.lit(1)))))))
        whole = F.array(_clause(F.lit("1"), _no_text(), strip(text), _no_text(), F.lit(1)))
        return F.when(F.size(starts) == 0, whole).otherwise(
            F.concat(preamble, let(raw(starts), sectioned)))

    return let(positions(F.transform(markers, lambda m: m.isNotNull())), with_preamble)


def merged(clauses: Column) -> Column:
    """Short fragments folded into the clause above; empty non-headings dropped.

    Whether a clause is kept depends on itself and on being first only, so the
    kept ones are the starts of the runs to join.
    """
    keeps = F.transform(clauses, lambda c, i: (i == 0) | (c["level"] <= 1)
                        | (F.length(c["content"]) >= fixed.MIN_CLAUSE_CHARS))

    def folded(start: Column, run: Column) -> Column:
        def build(head: Column) -> Column:
            pieces = F.transform(F.slice(run, 2, F.size(run)), lambda c: strip(
                F.concat(c["clause_number"], F.lit(" "), c["content"])))
            content = F.when(F.size(run) == 1, head["content"]).otherwise(
                strip(F.array_join(F.concat(F.array(head["content"]), pieces), "\n")))
            return _clause(head["clause_number"], head["title"], content,
                           head["section"], head["level"])

        return let(F.get(run, F.lit(0)), build)

    joined = let(clauses, lambda all_clauses: let(
        positions(keeps), lambda starts: islands(all_clauses, starts, folded)))
    return F.filter(joined, lambda c: (strip(c["content"]) != "") | (c["level"] <= 1))


def is_navigation(content: Column, level: Column) -> Column:
    """A heading whose body is short and holds no sentence."""
    body = strip(content)
    return ((level <= 1) & ~body.rlike(rf"[.!?](?:[{SPACE_CLASS}]|$)")
            & (F.size(words(body)) <= fixed.NAVIGATION_MAX_WORDS))


def clause_array(text: Column, profile: Column) -> Column:
    """All clauses of one cleaned text, in order."""
    def parsed(lines: Column) -> Column:
        def choose(found: Column) -> Column:
            numbered = F.exists(found, lambda m: m.isNotNull())
            marks = F.when(numbered, found).otherwise(F.transform(lines, list_marker))
            return let(marks, lambda m: segmented(lines, m, text))

        return let(F.transform(lines, lambda l: line_marker(l, profile)), choose)

    lines = F.filter(content_lines(text), lambda l: ~is_noise(l, profile))
    kept = let(let(lines, parsed), merged)
    kept = F.filter(kept, lambda c: ~is_navigation(c["content"], c["level"]))
    return F.when(strip(text) != "", kept)


def parse_documents(documents: DataFrame, *keys: str) -> DataFrame:
    """One row per clause: the keys, ordinal and the clause fields.

    ``documents`` holds cleaned ``text`` and a ``profile``.
    """
    return (
        documents
        .select(*keys, F.posexplode(clause_array(F.col("text"), F.col("profile")))
                .alias("ordinal", "clause"))
        .select(*keys, "ordinal", "clause.*")
    )


def parse_summary(clauses: DataFrame, *keys: str) -> DataFrame:
    """Clauses, distinct sections and the upper median length, per key.

    The median comes from length counts, so a group travels as its distinct
    lengths rather than as its clauses.
    """
    from pyspark.sql import Window

    lengths = clauses.groupBy(*keys, F.length("content").cast("long").alias("chars")).agg(
        F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("chars")
    ranked = (lengths
              .withColumn("upto", F.sum("n").over(order))
              .withColumn("total", F.sum("n").over(Window.partitionBy(*keys))))
    median = ranked.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(
        F.min("chars").alias("median_chars"), F.max("total").alias("clauses"))
    sections = clauses.groupBy(*keys).agg(
        F.countDistinct(F.nullif(F.col("section"), F.lit(""))).alias("sections"))
    return median.join(sections, list(keys)).select(*keys, "clauses", "sections", "median_chars")
