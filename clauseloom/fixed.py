"""Fixed values the results depend on: thresholds, labels, word lists, markup.

Everything here is data.  Behaviour lives in ``functions``, ``operators`` and
``plans``; nothing below is computed from anything else.
"""

# Similarity bands.
UNCHANGED_MIN = 0.95
MINOR_MIN = 0.80

# Word guard: a pair beyond either limit is not "Unchanged" ...
UNCHANGED_MAX_RATIO = 0.05
UNCHANGED_MAX_WORDS = 20
# ... and one at or beyond either of these is not a "Minor Edit".
SIGNIFICANT_MIN_RATIO = 0.35
SIGNIFICANT_MIN_WORDS = 200

# Chunks handed to an encoder.
CHUNK_WORDS = 220
CHUNK_OVERLAP = 40

# Alignment.
IDENTIFIER_OVERLAP_MIN = 0.35
WEIGHT_EMBEDDING = 0.72
WEIGHT_LEXICAL = 0.18
WEIGHT_POSITION = 0.10
ACCEPT_MIN = 0.42
TOP_K = 12

# Parsing.
MIN_CLAUSE_CHARS = 60
HEADING_MAX_CHARS = 90
HEADER_MAX_CHARS = 90
HEADER_MIN_CHARS = 3
HEADER_REPEATS = 8
NAVIGATION_MAX_WORDS = 40

# Redline.
DEL_OPEN = '<del class="rl-del">'
DEL_CLOSE = "</del>"
INS_OPEN = '<ins class="rl-ins">'
INS_CLOSE = "</ins>"
HIT_OPEN = '<mark class="hit">'
HIT_CLOSE = "</mark>"

# Search.
TERM_MIN_CHARS = 2
EXCERPT_WINDOW = 160

# Report.
SPINE_SEGMENTS = 220
UNCHANGED = "Unchanged"
MINOR = "Minor Edit"
SIGNIFICANT = "Significant Change"
ADDED = "Added"
REMOVED = "Removed"
CHANGE_TYPES = [UNCHANGED, MINOR, SIGNIFICANT, ADDED, REMOVED]
SEVERITY = [SIGNIFICANT, ADDED, REMOVED, MINOR, UNCHANGED]
NOT_PRESENT = "(not present)"

IDENTIFIER = "identifier"
SEMANTIC = "semantic"
AUTO = "auto"

# Register of amendments.
OPERATION_ALIASES = {
    "replace": "replace", "substitute": "replace", "amend": "amend",
    "delete": "delete", "remove": "delete", "insert": "insert", "add": "insert",
}
NOUNS_KEPT = ["table", "diagram", "figure", "appendix", "section"]

# Studies.
SWEEP_RATIOS = [0.0, 0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50]
LONG_CLAUSE_WORDS = 180
PERTURB_MIN_CHARS = 200
PERTURB_SAMPLE = 120
SAMPLE_SEED = 20260808
SAMPLE_SIZE = 150
WINDOW_FILLER = (
    " The fire and rescue service shall be provided with vehicle access "
    "to the perimeter of the building at all times."
)
WINDOW_REPEATS = [0, 1, 2, 5, 10, 20, 40]
BLIND_DROP = 0.005
TERM_FAMILIES = {
    "dwelling": ["dwellinghouse", "dwelling house", "dwelling"],
    "escape distance": ["travel distance", "escape route", "means of escape"],
    "protected stair": ["protected stairway", "protected zone", "protected shaft",
                        "protected corridor"],
    "fire door": ["fire doorset", "fire door", "self-closing device"],
    "suppression": ["sprinkler", "suppression system", "residential sprinkler"],
    "compartment": ["compartment wall", "compartment floor", "compartmentation"],
    "external wall": ["external wall", "cladding", "combustible material"],
    "alarm": ["fire detection", "smoke alarm", "fire alarm"],
}

# Jurisdictions: code, name, two-letter mark, authority, instrument, grammar.
DEFAULT_COUNTRY = "INT"
AUTO_COUNTRY = "AUTO"
UNASSIGNED = "Unassigned"
GENERIC = "generic"
JURISDICTIONS = [
    ("EW", "England & Wales", "EW", "Ministry of Housing, Communities & Local Government",
     "Approved Document B", "approved_document"),
    ("SC", "Scotland", "SC", "Scottish Government Building Standards Division",
     "Technical Handbook", "technical_handbook"),
    ("NI", "Northern Ireland", "NI", "Department of Finance (NI)",
     "Technical Booklet E", "technical_booklet"),
    ("IE", "Republic of Ireland", "IE",
     "Department of Housing, Local Government and Heritage",
     "Technical Guidance Document B", "technical_guidance"),
    ("BSI", "British Standards", "BS", "British Standards Institution",
     "BS 9999 / BS 9991 / BS 7974", "british_standard"),
    ("INT", "Other / International", "IN", "", "", "generic"),
]
