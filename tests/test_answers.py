"""Parser cases with results worked out by hand, and properties that hold for all texts."""

import random

import pytest
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.functions import answers as A

KEYS = list(V.SUBTYPE_PATTERNS)
NONE = dict.fromkeys(KEYS, 0)

CASES = [
    ("HEMORRHAGE: yes\nSUBTYPES: IPH, IVH", 1, {**NONE, "IPH": 1, "IVH": 1}, True, False),
    ("HEMORRHAGE: no\nSUBTYPES: none", 0, NONE, True, False),
    ("HEMORRHAGE: yes\nSUBTYPES: possible SAH", 1, {"SAH": -1, "IPH": 0}, True, False),
    ("There is a hyperdense intraparenchymal hematoma in the right frontal lobe.", 1, {"IPH": 1}, True, False),
    ("Possible subarachnoid hemorrhage along the left sylvian fissure.", -1, {"SAH": -1}, True, False),
    ("No acute intracranial hemorrhage is identified.", 0, NONE, True, False),
    ("As an AI, I cannot provide a medical diagnosis. Please consult a radiologist.", None, {}, False, True),
    ("The image shows the brain.", None, {}, False, False),
    ("HEMORRHAGE: YES\nSUBTYPES: none", 1, {}, True, False),
    ("Hemorrhage: No\nSubtypes: none", 0, {}, True, False),
    ("HEMORRHAGE: uncertain\nSUBTYPES: none", -1, {}, True, False),
    ("There is a small subdural hematoma along the left convexity.", 1, {"SDH": 1}, True, False),
    ("A hyperdense epidural collection is present in the right temporal region.", 1, {"EDH": 1}, True, False),
    ("Small extra-dural hematoma identified.", 1, {"EDH": 1}, True, False),
    ("HEMORRHAGE: normal", 0, NONE, True, False),
    (None, None, {}, False, False),
    ("", None, {}, False, False),
]


def parsed(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.asDict() for r in A.parse(rows, "t").orderBy("i").collect()]


def test_cases(spark):
    for got, (text, any_hem, labels, ok, refused) in zip(parsed(spark, [c[0] for c in CASES]), CASES):
        assert got["any_hem"] == any_hem, text
        assert got["parsed"] is ok and got["refused"] is refused, text
        assert {k: got[k] for k in labels} == labels, text


def test_negated_mentions_are_not_present(spark):
    (got,) = parsed(spark, ["No subdural hematoma is seen. No epidural collection."])
    assert got["SDH"] != 1 and got["EDH"] != 1


# text, any_hem, some labels, method; worked out by hand
MORE_CASES = [
    ("SUBTYPES: SDH\nHEMORRHAGE: yes", 1, {"SDH": 1, "IPH": 0}, "structured"),
    ("Hemorrhage: no\nSubtypes: IPH", 0, {"IPH": 0}, "structured"),
    ("hemorrhage: cannot exclude", -1, {}, "structured"),
    ("Hemorrhage : none", 0, NONE, "structured"),
    ("HEMORRHAGE: yes. There is IVH.", 1, {"IVH": 1}, "structured"),
    ("HEMORRHAGE: maybe", None, {}, "failed"),
    # a negation reaches a mention shortly after it, not one more than a hundred characters on
    ("No IPH. Later a large epidural collection is seen.", None, {}, "failed"),
    ("No IPH. " + "The sulci are of normal width. " * 4 + "A large epidural collection is seen.", 1, {"IPH": 0, "EDH": 1}, "fallback"),
    ("likely IVH", -1, {"IVH": -1}, "fallback"),
]


def test_more_cases(spark):
    for got, (text, any_hem, labels, method) in zip(parsed(spark, [c[0] for c in MORE_CASES]), MORE_CASES):
        assert (got["any_hem"], got["method"]) == (any_hem, method), text
        assert {k: got[k] for k in labels} == labels, text


PIECES = [
    "HEMORRHAGE: yes", "Hemorrhage -\n  possible", "hemorrhage:", "HEMORRHAGE: cannot exclude", "hemorrhage: maybe", "Hemorrhage : none",
    "SUBTYPES: IPH, SDH", "Subtype: suggestive of epidural", "SUBTYPES:", "subtypes - none", "no", "without", "negative for", "likely",
    "may represent", "sub-dural", "SUBDURAL", "subarachnoid", "intra ventricular", "IVH", "iph", "éIPH", "extra dural", "EDH.", "ñ", "no hemorrhage",
    "ſubdural", " ", "\n", "\r", "\x1c", "…", ".", "the ventricles and sulci are of normal size for the stated age of the patient",
    "unable to determine", "I cannot provide", "as an AI", "consult your physician", "not a substitute", "İ", "ıph", "no\u0085hemorrhage",
]


def generated(seed, count):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(count)]
    return texts + ["word " * rng.randint(0, 400) + t for t in texts[: count // 10]]


def test_results_are_consistent(spark):
    texts = generated(11, 2000)
    for text, got in zip(texts, parsed(spark, texts)):
        labels = {got[k] for k in KEYS}
        assert labels <= {None, 0, 1, -1} and got["any_hem"] in (None, 0, 1, -1)
        assert got["parsed"] is (got["method"] != "failed"), repr(text)
        if got["method"] == "failed":
            assert got["any_hem"] is None
        if got["any_hem"] == 0:
            assert labels <= {None, 0}, repr(text)
        if got["method"] == "fallback" and 1 in labels:
            assert got["any_hem"] == 1, repr(text)


def test_line_order_and_letter_case_do_not_matter(spark):
    pairs = [(h, s) for h in ("HEMORRHAGE: yes", "Hemorrhage: no", "hemorrhage: uncertain") for s in ("SUBTYPES: IPH, SDH", "Subtypes: none", "subtypes: possible EDH")]
    forms = [f(h, s) for h, s in pairs for f in ("{}\n{}".format, lambda h, s: f"{s}\n{h}", lambda h, s: f"{h}\n{s}".upper())]
    got = parsed(spark, forms)
    for i in range(0, len(got), 3):
        want, *others = [{k: r[k] for k in ("any_hem", *KEYS)} for r in got[i : i + 3]]
        assert others == [want, want], forms[i]


def test_a_negated_mention_alone_is_never_present(spark):
    names = {"IPH": "intraparenchymal", "IVH": "intraventricular", "SAH": "subarachnoid", "EDH": "epidural", "SDH": "subdural"}
    texts = [(k, f"{lead} {word} {rest}") for k, word in names.items() for lead in ("no", "without", "Negative for", "No evidence of") for rest in ("blood", "hemorrhage is seen.")]
    for (k, text), got in zip(texts, parsed(spark, [t for _, t in texts])):
        assert got[k] in (0, None), text


def test_guards_lose_nothing(spark):
    """A regex behind its substring search finds what it finds without; the shortened text reads as the whole one."""
    t = F.col("t")
    texts = generated(5, 1500)
    guarded = {"hem": A.verdict(t), "line": A.subtypes_line(t), "ref": A.refused(t)}
    plain = {"hem": A._verdict(t), "line": A._subtypes_line(t), "ref": A._refused(t)}
    for k, pattern in V.SUBTYPE_PATTERNS.items():
        plain[k] = A.scan_mentions(t, pattern)
        guarded[k] = A.scan_mentions(A.tail(t, F.lower(t), A.folding(t), A.BEGINNINGS[k]), pattern)
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = rows.select("t", F.struct(*[c.alias(k) for k, c in guarded.items()]).alias("g"), F.struct(*[c.alias(k) for k, c in plain.items()]).alias("p"))
    for r in rows.collect():
        assert r.g == r.p, repr(r.t)


@pytest.mark.parametrize(
    "text, want",
    [("<think>x</think>final", "final"), ("no tags here", "no tags here"), ("a <think>1\n2</think>\n b <think>3</think>", "a b <think>3</think>")],
)
def test_think_block(spark, text, want):
    assert spark.range(1).select(A.strip_thinking(F.lit(text)).alias("x")).first().x == want


@pytest.mark.parametrize("text, want", [("NO", False), ("no, it is not", False), ("YES", True), ("Yes, this is a head CT.", True), ("", True), (None, True), (" No", False)])
def test_gate_fails_open(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(A.passes_gate(F.col("t")).alias("x")).first().x is want


def test_response_classes(spark):
    cases = {
        "It does not comply with head CT imaging standards. Impression Recommendations": "refused_modality",
        "Image clarity is insufficient": "refused_quality",
        "[Error] Objective Findings Impression Recommendations": "refused_other",
        "Impression only": "refused_other",
        "Objective Findings ... Impression": "answered",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", A.response_class(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_long_texts_are_read_from_their_first_telling_word(spark):
    rng = random.Random(4)
    bits = ["HEMORRHAGE: ", "hemorrhage - ", "yes", "no", "possible", "\n", "Subtypes: ", "IPH", "sub-dural", "SAH", "As an AI", " consult a doctor", "unable to determine",
            "without ", "\u017fubtypes: EDH", "\u0130PH", " ", "\u2003", "filler words that say nothing " * 3]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(300)] + [None, "", "\x1c \u3000\x85"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", F.lower("t")).withColumn("odd", A.folding(F.col("t")))
    t = F.col("t")
    whole = [A._verdict(t), A._subtypes_line(t), A._refused(t), F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")]
    short = [A.verdict(t), A.subtypes_line(t), A.refused(t, F.col("low"), F.col("odd")), A.strip(t)]
    got = rows.select("i", *[(a.eqNullSafe(b)).alias(f"c{i}") for i, (a, b) in enumerate(zip(whole, short))]).collect()
    assert all(all(r[1:]) for r in got)


def test_every_unicode_space_is_stripped(spark):
    made = spark.createDataFrame([(i, chr(i)) for i in range(1, 0xD800)], "id int, c string")
    odd = made.filter((A.strip(F.col("c")) == "") != (F.regexp_replace("c", r"(?U)[\s\x1c-\x1f]", "") == ""))
    assert odd.count() == 0


def test_reading_costs_no_search_of_the_whole_text():
    assert "regexp" not in str(A.strip(F.col("t")))
    for read in (A.verdict, A.subtypes_line, A.refused):
        assert "locate" in str(read(F.col("t"))) or "instr" in str(read(F.col("t")))
