"""Word lists, patterns, texts and constants that results depend on.

These are data, not logic. They decide what a published result means (which words
count as a hedge, which order labels are listed in), so they are kept verbatim,
in one place and in natural order.
"""

# Label keys in the order every listing uses.
SUBTYPES = ["IPH", "IVH", "SAH", "EDH", "SDH"]
ANY = "any_hemorrhage"

# Wide label file: column -> label key.
WIDE_COLUMNS = {
    "Intraparenchymal": "IPH",
    "Intraventricular": "IVH",
    "Subarachnoid": "SAH",
    "Epidural": "EDH",
    "Subdural": "SDH",
}

# Long label file: id suffix -> label key.
LONG_SUFFIXES = {
    "intraparenchymal": "IPH",
    "intraventricular": "IVH",
    "subarachnoid": "SAH",
    "epidural": "EDH",
    "subdural": "SDH",
}

# Mentions of each label in free text.
SUBTYPE_PATTERNS = {
    "IPH": r"\b(IPH|intra[\s-]?parenchymal|intra[\s-]?cerebral)\b",
    "IVH": r"\b(IVH|intra[\s-]?ventricular)\b",
    "SAH": r"\b(SAH|sub[\s-]?arachnoid)\b",
    "EDH": r"\b(EDH|epidural|extra[\s-]?dural)\b",
    "SDH": r"\b(SDH|sub[\s-]?dural)\b",
}

# Answer lines.
VERDICT_LINE = r"hemorrhage\s*[:\-]\s*(.+)"
SUBTYPES_LINE = r"subtypes?\s*[:\-]\s*(.*)"

# Verdict words, tested as prefixes in the order uncertain, positive, negative.
UNCERTAIN_WORDS = (
    r"(uncertain|possible|possibly|equivocal|indeterminate|questionable|cannot exclude|cannot rule out)"
)
POSITIVE_WORDS = r"(yes|present|positive|seen|identified|evident)"
NEGATIVE_WORDS = r"(no|none|absent|negative|nil)"

# Hedges and negations around a mention; characters looked at before and after it,
# and how far into the mention the negation window reaches.
HEDGE = (
    r"\b(possible|possibly|probable|likely|suspicious for|concerning for|"
    r"cannot exclude|cannot rule out|may represent|questionable|equivocal|"
    r"could represent|suggestive of)\b"
)
NEGATION = r"\b(no|without|negative for|absence of|no evidence of)\b"
CONTEXT_BEFORE = 40
CONTEXT_AFTER = 25
NEGATION_REACH = 5

GLOBAL_NEGATIVE = r"\bno\b[^.]{0,40}\bhemorrhage\b"

REFUSAL = (
    r"(as an ai|i (?:can ?not|cannot|am unable to|'m unable to|am not able to) "
    r"(?:provide|give|make|offer|assist|help|analyze|interpret|diagnos)|"
    r"consult (?:a|your) (?:doctor|physician|radiologist|healthcare)|"
    r"seek medical|not a (?:substitute|medical)|unable to determine)"
)

# Response classes.
MODALITY_REFUSAL = "does not comply with head CT imaging standards"
QUALITY_REFUSAL = "Image clarity is insufficient"
ERROR_TAG = "[Error]"
REPORT_SECTIONS = ["Objective Findings", "Impression", "Recommendations"]
MIN_REPORT_SECTIONS = 2

# Gate and context texts.
GATE_REFUSAL_TEXT = (
    "This image does not appear to be a head CT slice, so the image-retrieval "
    "hemorrhage assessment was not performed."
)
TEXT_CONTEXT_HEADER = (
    "Reference imaging findings for hemorrhage subtypes (background "
    "knowledge only -- judge strictly by what is visible in THIS "
    "image, not by this list):"
)
DEFAULT_TEXT_QUERY = "acute intracranial hemorrhage findings on a head CT slice"

# Numeric settings.
WINDOW_LEVEL = 40.0
WINDOW_WIDTH = 120.0
GRAY_LEVELS = 256
N_BOOT = 2000
ALPHA = 0.05
N_TRIALS = 1000
NULL_PERCENTILE = 95
TEXT_K = 5
TWO_STAGE_K = 2
IMAGE_K = 3
HIT_RATE_K = 5
CANDIDATE_OVERSAMPLE = 2
MAX_CONSECUTIVE_MISSES = 40
MEMORY_LIMIT_GB = 15.0
