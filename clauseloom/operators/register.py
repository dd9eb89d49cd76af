"""Amendment registers: published instructions read into clause references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom import fixed, grammar
from clauseloom.functions.text import SPACE_CLASS, let, strip

_BODY = grammar.REFERENCE_BODY
# noun, body, and what may follow it; the tail is looked at, not consumed
_REFERENCE = (rf"(?i)\b({grammar.REFERENCE_NOUNS})[{SPACE_CLASS}]+({_BODY})(?![A-Za-z])"
              rf"(?:(?=[{SPACE_CLASS}]*(to|and|,)[{SPACE_CLASS}]*({_BODY}))|)")


def regions(text: Column) -> Column:
    """Array of struct(volume, text): the stretches behind each list heading.

    The volume is that of the last volume heading before the list.
    """
    def parts(pieces: Column) -> Column:
        volumes = F.transform(pieces, lambda p: F.get(F.reverse(F.regexp_extract_all(
            p, F.lit(grammar.VOLUME_HEADING), F.lit(1))), F.lit(0)))

        def above(known: Column) -> Column:
            return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p, i: F.struct(
                F.try_element_at(F.array_compact(F.slice(known, F.lit(1), i + 1)), F.lit(-1))
                .cast("int").alias("volume"), p.alias("text")))

        return F.when(F.size(pieces) == 1, F.array(F.struct(
            F.lit(None).cast("int").alias("volume"), text.alias("text")))).otherwise(
            let(volumes, above))

    return let(F.split(text, grammar.REGISTER_HEADING), parts)


def reflowed_sentences(region: Column) -> Column:
    """Sentences rebuilt from broken lines; a page marker starts a new one."""
    joined = F.regexp_replace(region, f"[{SPACE_CLASS}]*\n[{SPACE_CLASS}]*", " ")
    joined = F.regexp_replace(joined, f"[{SPACE_CLASS}]{{2,}}", " ")
    joined = F.regexp_replace(joined, grammar.PAGE_MARKER, "\n")
    parts = F.split(joined, f"(?<=[.:])[{SPACE_CLASS}]+(?=[A-Z])|\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def operation(sentence: Column) -> Column:
    """What an instruction asks for; null when the sentence is not one."""
    def found_or(other: Column):
        return lambda found: F.when(found != "", found).otherwise(other)

    verb = F.lit(None).cast("string")
    for pattern in reversed(grammar.INSTRUCTIONS):
        # named, so that no pattern is tried again for what it has found
        verb = let(F.regexp_extract(sentence, pattern, 1), found_or(verb))
    aliases = F.create_map(*[F.lit(x) for pair in fixed.OPERATION_ALIASES.items() for x in pair])
    return F.try_element_at(aliases, F.lower(verb))


def instructions(region: Column) -> Column:
    """Array of struct(_sentence, instruction, operation): the instructions among the sentences.

    Sentences are read inside the array: a filter on rows would read each of them once to
    keep it and again to say what it asks for.
    """
    told = F.transform(reflowed_sentences(region), lambda s, i: F.struct(
        i.alias("_sentence"), s.alias("instruction"), operation(s).alias("operation")))
    return F.filter(told, lambda t: t["operation"].isNotNull())


def expanded(body: Column, connector: Column, other: Column) -> Column:
    """Both ends of a pair, every member of a range with one prefix."""
    split = r"^([A-Z]*)(\d+)$"
    low, high = [F.try_to_number(F.nullif(F.regexp_extract(x, split, 2), F.lit("")),
                                 F.lit("999999999")).cast("int") for x in (body, other)]
    prefix = F.regexp_extract(body, split, 1)
    is_range = ((F.lower(connector) == "to") & body.rlike(split) & other.rlike(split)
                & (prefix == F.regexp_extract(other, split, 1))
                & (high >= low))
    # the prefix is looked up once, not for every member
    run = let(prefix, lambda p: F.transform(F.sequence(low, F.when(is_range, high).otherwise(low)),
                                            lambda n: F.concat(p, n.cast("string"))))
    return (F.when(connector == "", F.array(body))
            .when(F.coalesce(is_range, F.lit(False)), run).otherwise(F.array(body, other)))


def references(sentence: Column) -> Column:
    """Array of struct(noun, body) named by a sentence, in order."""
    groups = [F.regexp_extract_all(sentence, F.lit(_REFERENCE), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("noun", "body", "how", "other"))])
    return F.flatten(F.transform(zipped, lambda m: F.transform(
        expanded(m["body"], m["how"], m["other"]),
        lambda body: F.struct(m["noun"].alias("noun"), body.alias("body")))))


def _noun(noun: Column) -> Column:
    singular = F.rtrim(F.lower(noun), F.lit("s"))
    return F.when(singular == "appendice", "appendix").otherwise(singular)


def reference_name(noun: Column, body: Column) -> Column:
    """The clause number a reference would be stored under."""
    kept = _noun(noun).isin(*fixed.NOUNS_KEPT)
    return F.when(kept, F.concat(F.initcap(_noun(noun)), F.lit(" "), body)).otherwise(body)


def reference_aliases(noun: Column, body: Column) -> Column:
    """Every spelling the reference may be stored under."""
    kept = _noun(noun).isin(*fixed.NOUNS_KEPT)
    return F.when(kept, F.array(reference_name(noun, body), body)).otherwise(F.array(
        body, F.concat(F.lit("Requirement "), body), F.concat(F.lit("Section "), body)))


def parse_booklets(booklets: DataFrame) -> DataFrame:
    """Amendments of booklets given as (booklet, text); the first mention of each is kept."""
    sentences = (
        booklets.select("booklet", F.posexplode(regions(F.col("text"))).alias("_region", "r"))
        .select("booklet", "_region", "r.volume", F.explode(instructions(F.col("r.text"))).alias("s"))
        .select("booklet", "_region", "volume", "s.*")
    )
    named = sentences.select(
        "*", F.posexplode(references(F.col("instruction"))).alias("_reference", "ref")).select(
        "booklet", "volume", "operation", "instruction", "_region", "_sentence", "_reference",
        reference_name(F.col("ref.noun"), F.col("ref.body")).alias("reference"),
        reference_aliases(F.col("ref.noun"), F.col("ref.body")).alias("aliases"))
    first = F.struct("_region", "_sentence", "_reference")
    return (
        named.groupBy("booklet", "volume", "reference", "operation")
        .agg(F.min_by(F.struct("aliases", "instruction", first.alias("position")), first)
             .alias("_first"))
        .select("booklet", "volume", "reference", "_first.aliases", "operation",
                "_first.instruction", "_first.position"))


def of_volume(amendments: DataFrame, volume: int | None) -> DataFrame:
    """Amendments of one volume; those without a volume cannot be ruled out."""
    if volume is None:
        return amendments
    return amendments.filter((F.col("volume") == volume) | F.col("volume").isNull())


def spellings(amendments: DataFrame) -> DataFrame:
    """Distinct spellings of every changed clause."""
    return amendments.select(F.explode("aliases").alias("spelling")).distinct()


def amendment_keys(amendments: DataFrame, *keep: str) -> DataFrame:
    """What each amendment can be joined on: spelling, contained section, contained appendix."""
    section = F.regexp_extract("reference", r"(?i)^Section\s+(\d{1,3})$", 1)
    appendix = F.upper(F.regexp_extract("reference", r"(?i)^Appendix\s+([A-Z])$", 1))
    exact = F.transform("aliases", lambda a: F.concat(F.lit("alias:"), F.lower(a)))
    keys = F.concat(
        exact,
        F.when(section != "", F.array(F.concat(F.lit("section:"), section)))
        .otherwise(F.array().cast("array<string>")),
        F.when(appendix != "", F.array(F.concat(F.lit("appendix:"), appendix)))
        .otherwise(F.array().cast("array<string>")))
    return amendments.select(*(keep or amendments.columns),
                             F.explode(F.array_distinct(keys)).alias("cover_key"))


def number_keys(numbers: DataFrame, *keep: str, number: str = "clause_number") -> DataFrame:
    """The same keys seen from a clause number."""
    name = strip(F.col(number))
    section = F.regexp_extract(name, r"^(\d{1,3})\.\d", 1)
    appendix = F.upper(F.regexp_extract(
        name, r"(?i)^(?:Table\s+|Diagram\s+|Figure\s+)?([A-Z])\d", 1))
    keys = F.array_compact(F.array(
        F.concat(F.lit("alias:"), F.lower(name)),
        F.when(section != "", F.concat(F.lit("section:"), section)),
        F.when(appendix != "", F.concat(F.lit("appendix:"), appendix))))
    return numbers.select(*(keep or numbers.columns), F.explode(keys).alias("cover_key"))


def covers(amendments: DataFrame, numbers: DataFrame, amendment_fields: list[str],
           number_fields: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (amendment, number) pairs where the amendment reaches the clause.

    The three ways to reach a clause are three kinds of one equality key.
    """
    left = amendment_keys(amendments, *amendment_fields)
    right = number_keys(numbers, *number_fields)
    return left.join(right, ["cover_key", *on]).drop("cover_key").distinct()
