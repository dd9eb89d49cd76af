"""Column functions over text: all JVM-side, none of them shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from clauseloom import fixed

# The white space of a Unicode-aware ``strip`` and ``split``; the short classes
# of Java and RE2 are ASCII only, so the characters are spelled out.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
# The same characters for use inside a regular-expression class.
_WIDE_CLASS = "\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = " \t-\r" + _WIDE_CLASS
INLINE_CLASS = " \t\x0b-\r" + _WIDE_CLASS
EXOTIC_CLASS = "\x0b-\r" + _WIDE_CLASS
WORD = rf"[\p{{L}}\p{{N}}]+(?:['’][\p{{L}}\p{{N}}]+)*|[^{SPACE_CLASS}\p{{L}}\p{{N}}]"
TOKEN = rf"[{SPACE_CLASS}]+|{WORD}"


def quick(members: str, among: str = r"\x00- \x7F-　") -> str:
    """A Java class of ``members``, all of which are ``among`` few ranges.

    Java asks the parts of a class one by one; the characters that texts are made of are
    told by these ranges.
    """
    return f"[[{among}]&&[{members}]]"


Body = Callable[[Column], Column]


def let(value: Column, body: Body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column captured by a lambda may be inlined into it by the optimizer and so
    be evaluated per element; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchored(patterns: list[str]) -> str:
    """One pattern for several that all start with ``^``, with the anchor tried once."""
    return "^(?:" + "|".join(p.removeprefix("^") for p in patterns) + ")"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"{quick(SPACE_CLASS)}+"), lambda w: w != "")


def word_total(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(words(text)).cast("long")


def tokens(text: Column) -> Column:
    """Lossless split into words, single punctuation marks and white-space runs."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def token_count(text: Column) -> Column:
    """Tokens that are not white space; punctuation counts."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def set_similarity(left: Column, right: Column) -> Column:
    """Jaccard of two distinct arrays, 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    # named, as it is used twice
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        let(shared, lambda n: n / (F.size(left) + F.size(right) - n)),
    ).otherwise(F.lit(0.0))


def lexical_similarity(left: Column, right: Column) -> Column:
    different = let(token_set(left), lambda a: let(token_set(right), lambda b: set_similarity(a, b)))
    # equal texts share all their tokens, if they have any
    return F.when(left == right, F.lower(left).rlike(WORD).cast("double")).otherwise(different)


def alignment_text(section: Column, title: Column, content: Column) -> Column:
    """Section, title and content joined by spaces, empty parts skipped."""
    return strip(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (section, title, content)]))


def chunks(text: Column) -> Column:
    """Overlapping word windows; a short text is returned unchanged, an empty one as ``['']``."""
    size, stride = fixed.CHUNK_WORDS, fixed.CHUNK_WORDS - fixed.CHUNK_OVERLAP

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride))
        return (
            F.when(F.size(w) == 0, F.array(F.lit("")))
            .when(F.size(w) <= size, F.array(text))
            .otherwise(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " ")))
        )

    return let(words(F.coalesce(text, F.lit(""))), windows)


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    found = ((F.length(text) - F.length(F.replace(text, phrase, F.lit(""))))
             / F.length(phrase)).cast("long")
    # looking for a phrase is far cheaper than replacing it
    return F.when(~F.contains(text, phrase) & (phrase != ""), F.lit(0).cast("long")).otherwise(found)


def positions(flags: Column) -> Column:
    """Indexes of the true elements of a boolean array."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def islands(items: Column, starts: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Apply ``body(start, slice)`` to each run of items between consecutive starts.

    ``items`` and ``starts`` must be lambda variables (see ``let``).
    """
    return F.transform(
        starts,
        lambda s, k: body(s, F.slice(items, s + 1,
                                     F.coalesce(F.get(starts, k + 1), F.size(items)) - s)),
    )


def sentences(text: Column) -> Column:
    """Split behind a full stop or semicolon followed by white space."""
    return F.split(text, f"(?<=[.;])[{SPACE_CLASS}]+")


def without_last_sentence(text: Column) -> Column:
    return let(sentences(text), lambda s: F.when(
        F.size(s) >= 3, F.array_join(F.slice(s, 1, F.size(s) - 1), " ")))


def ends_swapped(text: Column) -> Column:
    """First and last sentence exchanged, the middle kept."""
    def swap(s: Column) -> Column:
        moved = F.concat(F.slice(s, -1, 1), F.slice(s, 2, F.size(s) - 2), F.slice(s, 1, 1))
        return F.when(F.size(s) >= 3, F.array_join(moved, " "))

    return let(sentences(text), swap)


def measurements_bumped(text: Column) -> Column:
    """Every measurement raised by a quarter; null when the text has none."""
    from clauseloom.grammar import MEASUREMENT

    numbers = F.regexp_extract_all(text, F.lit(MEASUREMENT), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(MEASUREMENT), F.lit(2))
    between = F.split(text, MEASUREMENT)

    def bumped(number: Column) -> Column:
        value = number.cast("double")
        raised = F.when(value == 0, F.lit(1.0)).otherwise(value * 1.25)
        # rounded half to even on the value itself, as a formatted float is
        whole = F.bround(raised).cast("decimal(38,0)").cast("string")
        tenth = F.bround(raised, 1).cast("decimal(38,1)").cast("string")
        return F.when(raised >= 10, whole).otherwise(tenth)

    def rebuilt(parts: Column) -> Column:
        pieces = F.zip_with(
            F.zip_with(numbers, units, lambda n, u: F.concat(bumped(n), u)),
            F.slice(parts, 2, F.size(parts)),
            lambda changed, gap: F.concat(changed, gap),
        )
        return F.concat(F.get(parts, F.lit(0)), F.array_join(pieces, ""))

    altered = let(between, rebuilt)
    return F.when(text.rlike(MEASUREMENT) & (altered != text), altered)


def clip(text: Column, limit: int | None) -> Column:
    """Carriage returns out, cut to the limit, if there is one, with an ellipsis."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(" "))
    if limit is None:
        return flat
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
