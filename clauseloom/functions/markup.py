"""Redline markup as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from clauseloom import fixed
from clauseloom.functions.text import strip

_ALLOWED = "|".join(re.escape(tag[1:-1]) for tag in (
    fixed.DEL_OPEN, fixed.DEL_CLOSE, fixed.INS_OPEN, fixed.INS_CLOSE,
    fixed.HIT_OPEN, fixed.HIT_CLOSE))
_FOREIGN_TAG = rf"<(?!(?:{_ALLOWED})>)[^>]*>?"
_MARKUP = r"<[^>]+>|&[a-zA-Z]+;|&#\d+;"


def escape(text: Column) -> Column:
    """``& < >`` only; quotes stay."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def wrap(text: Column, opening: str, closing: str) -> Column:
    """Escaped text inside one tag; white space alone is never wrapped."""
    body = escape(text)
    return F.when(strip(body) == "", body).otherwise(
        F.concat(F.lit(opening), body, F.lit(closing)))


def deleted(text: Column) -> Column:
    return wrap(text, fixed.DEL_OPEN, fixed.DEL_CLOSE)


def inserted(text: Column) -> Column:
    return wrap(text, fixed.INS_OPEN, fixed.INS_CLOSE)


def sanitise(html: Column) -> Column:
    """Drop every tag the library does not write itself, an unfinished one included."""
    return F.coalesce(F.regexp_replace(html, _FOREIGN_TAG, ""), F.lit(""))


def highlight(html: Column, term: str) -> Column:
    """Mark case-insensitive hits, never inside a tag or an entity."""
    safe = sanitise(html)
    needle = term.strip()
    if len(needle) < fixed.TERM_MIN_CHARS:
        return safe
    hit = "(?i)" + re.escape(needle)

    # markup[i] precedes text[i + 1]; text[0] has nothing before it
    texts = F.transform(F.split(safe, _MARKUP), lambda part: F.regexp_replace(
        part, hit, f"{fixed.HIT_OPEN}$0{fixed.HIT_CLOSE}"))
    marks = F.concat(F.array(F.lit("")),
                     F.regexp_extract_all(safe, F.lit(f"({_MARKUP})"), F.lit(1)))
    return F.array_join(F.zip_with(marks, texts, lambda m, t: F.concat(m, t)), "")


def excerpt(content: Column, term: str, window: int = fixed.EXCERPT_WINDOW) -> Column:
    """A window of text around the first hit, with an ellipsis at each cut end."""
    half = window // 2
    needle = term.strip()
    hit = F.locate(needle.lower(), F.lower(content)) - 1
    start = F.greatest(F.lit(0), hit - half)
    end = F.least(F.length(content), hit + len(needle) + half)
    cut = strip(content.substr(start + 1, end - start))
    return F.when(hit < 0, strip(F.substring(content, 1, window))).otherwise(F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")), cut,
        F.when(end < F.length(content), F.lit("…")).otherwise(F.lit(""))))
