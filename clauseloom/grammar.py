"""Numbering grammars, one per publishing tradition, as plain tables.

Fixed values.  A rule is ``(pattern, level, is_heading, id_prefix)``; the first
rule that matches a line opens a clause, whose number is the prefix followed by
the first capture group.  Patterns are Java regular expressions.
"""

DOTTED = r"(\d{1,2}(?:\.\d{1,3}){1,4})"

NUMBERED = (rf"^{DOTTED}\s+(?=[A-Z(\"'\d])", 2, False, "")
NUMBER_ALONE = (rf"^{DOTTED}\s*$", 2, False, "")
TABLES = [
    (rf"^(?i:{noun})\s+((?i:[\dA-Z]+)(?:\.\d+)*)\b", 3, False, f"{noun} ")
    for noun in ("Table", "Diagram", "Figure")
]
SECTION_HEADING = (r"^Section\s+(\d{1,2})\b[:.]?\s*", 1, True, "Section ")
APPENDIX_HEADING = (r"^Appendix\s+([A-Z])\b[:.]?\s*", 1, True, "Appendix ")
FUNCTIONAL = (r"^(B[1-5])\s+(?=[A-Z])", 1, True, "")

# name -> label, rules in match order, signature phrases, publisher noise
PROFILES = {
    "approved_document": {
        "label": "Approved Document (England & Wales)",
        "rules": [
            (r"^Requirement\s+(B[1-5])\b", 1, True, "Requirement "),
            SECTION_HEADING,
            APPENDIX_HEADING,
            FUNCTIONAL,
            NUMBERED,
            NUMBER_ALONE,
            *TABLES,
        ],
        "signatures": [
            "approved document b",
            "the building regulations 2010",
            "for use in england",
            "requirement b1",
            "mhclg",
        ],
        "noise": [
            r"^(?i:Approved Document B,? Volume \d)",
            r"^(?i:Fire safety:? Volume)",
        ],
    },
    "technical_handbook": {
        "label": "Technical Handbook (Scotland)",
        "rules": [
            (r"^Standard\s+(\d\.\d{1,2})\b", 1, True, "Standard "),
            (r"^Annex\s+(\d\.[A-Z])\b", 1, True, "Annex "),
            (r"^(\d)\s+(?:Fire|Structure|Environment|Safety|Noise|Energy|General|Sustainability)\b",
             1, True, "Section "),
            NUMBERED,
            NUMBER_ALONE,
            *TABLES,
        ],
        "signatures": [
            "technical handbook",
            "scottish ministers",
            "building (scotland) regulations",
            "mandatory standard",
            "building standards division",
        ],
        "noise": [
            r"^(?i:(?:Domestic|Non-domestic)\s+Technical Handbook)",
            r"^(?i:Scottish Government)",
        ],
    },
    "technical_booklet": {
        "label": "Technical Booklet (Northern Ireland)",
        "rules": [
            (r"^Part\s+([A-Z])\b[:.]?\s*", 1, True, "Part "),
            (r"^(E\d{1,2})\s+(?=[A-Z])", 1, True, ""),
            SECTION_HEADING,
            NUMBERED,
            NUMBER_ALONE,
            *TABLES,
        ],
        "signatures": [
            "technical booklet",
            "building regulations (northern ireland)",
            "department of finance",
            "department of finance and personnel",
        ],
        "noise": [r"^(?i:Technical Booklet [A-Z]\b)"],
    },
    "technical_guidance": {
        "label": "Technical Guidance Document (Ireland)",
        "rules": [
            FUNCTIONAL,
            APPENDIX_HEADING,
            (rf"^Paragraph\s+{DOTTED}\b", 2, False, ""),
            NUMBERED,
            NUMBER_ALONE,
            *TABLES,
        ],
        "signatures": [
            "technical guidance document",
            "building regulations 2006",
            "second schedule",
            "department of housing, local government and heritage",
            "an roinn",
        ],
        "noise": [r"^(?i:Technical Guidance Document B)"],
    },
    "british_standard": {
        "label": "British Standard (BSI)",
        "rules": [
            (r"^Annex\s+([A-Z])\b", 1, True, "Annex "),
            (r"^([A-Z]\.\d{1,2}(?:\.\d{1,2})*)\s+(?=\S)", 2, False, ""),
            (r"^(Foreword|Introduction|Scope|Bibliography)\s*$", 1, True, ""),
            (r"^Clause\s+(\d{1,2}(?:\.\d{1,3})*)\b", 2, False, ""),
            (r"^(\d{1,2}(?:\.\d{1,3})*)\s+(?=[A-Z])", 2, False, ""),
            *TABLES,
        ],
        "signatures": [
            "british standard",
            "bs 9999",
            "bs 9991",
            "bs 7974",
            "bsi standards limited",
            "(normative)",
        ],
        "noise": [r"^(?i:BS \d{4}:\d{4})", r"^(?i:©\s*(?:The )?BSI)"],
    },
    "generic": {
        "label": "Generic numbered document",
        "rules": [
            (r"^(?i:Section|Clause|Part|Article)\s+(\d{1,3}(?:\.\d{1,3})*)\b", 1, True, ""),
            NUMBERED,
            (r"^(\d{1,3})\.\s+(?=[A-Z])", 1, False, ""),
            NUMBER_ALONE,
            *TABLES,
        ],
        "signatures": [],
        "noise": [],
    },
}

# "(a)", "iii)", "2)" and the like, followed by text.
LIST_MARKER = r"^(\(?[a-z]\)|\(?[ivx]{1,4}\)|\d{1,2}\))\s+\S"

# Page furniture.
FURNITURE = [
    r"^[-—]?\s*\d{1,4}\s*[-—]?$",
    r"^(?i:page\s+\d+(?:\s+of\s+\d+)?)$",
    r"^(?i:\d+\s+of\s+\d+)$",
    r"^.{0,120}?[.․‧]{4,}\s*\d{1,4}\s*$",
    r"^[A-Z][^.!?]{3,70}\s{2,}\d{1,4}\s*$",
]

# Characters standardised before cleaning: one to one, deleted, one to many.
ONE_TO_ONE = {
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-",
    "\u00a0": " ", "×": "x",
}
DELETED = "\u200b\u200c\u200d\ufeff\u00ad"
ELLIPSIS = ("…", "...")
BULLETS = ("[•●○▪·]", "- ")
SPLIT_LIGATURE = r"(?<![\p{L}\p{N}_])(ffi|ffl|fi|fl|ff) (?=[a-z])"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"

# A register reference: noun, body, and an optional second body behind "to", "and" or a comma.
REFERENCE_BODY = r"(?:(?-i:[A-Z])\d{0,3}|\d{1,3})(?:\.\d{1,3})*"
REFERENCE_NOUNS = (
    r"(?:paragraphs?|tables?|diagrams?|figures?|appendix|appendices|sections?|clauses?|regulation)"
)
REGISTER_HEADING = r"(?i)List of amendments"
VOLUME_HEADING = r"(?i)Volume\s*([12])\s*[–—-]\s*(?:Dwellings|Buildings)"
PAGE_MARKER = r"(?i)\bPages?\s+\d{1,4}(?:\s*(?:to|-|–)\s*\d{1,4})?\s*"
INSTRUCTIONS = [
    r"(?i)^\s*(replace|delete|insert|add|amend|substitute)\b",
    r"(?i)^\s*(?:after|before)\s+.*?,\s*(insert|add)\b",
    rf"(?i)\b(?:paragraphs?|tables?|diagrams?)\s+{REFERENCE_BODY}\s*,\s*"
    r"(replace|delete|insert|add|amend|substitute)\b",
    r"(?i)^\s*(?:in|at)\s+.*?,\s*(replace|delete|insert|add|amend)\b",
]

MEASUREMENT = r"(?i)\b(\d+(?:\.\d+)?)(\s*(?:mm|m|metres|minutes|min|%)\b)"
