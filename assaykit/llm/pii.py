r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four fixed patterns give the seeds. Their surroundings (the two words before, or the word before and the
word after) become lexical patterns; patterns and identifier-like strings form a bipartite graph, scored
in rounds until one adds no string: a pattern is worth the share of its distinct strings that are known, a string what its
trusted patterns say together (noisy or). Strings found that way, which look like their kind, are added.

Defined cases: a null text is empty; rows are independent even with equal or null doc_id; a document without
finds has zero counts, the hash of the empty string and an empty ``spans``; a match that fails its kind's
test is dropped and its characters are not searched again; added spans never overlap seed spans; what is left
of a run of candidates without its seeds is a candidate too, with the words around the run as its context.
"""

from __future__ import annotations

from functools import partial
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import stored, table, whole

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract, written with possessive groups and a look at the character before,
# so that long runs of their characters take linear time and no stack.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be searched at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SIGN = r"[0-9@]|\[at\]|\(at\)"
#: Runs of words with a digit, an @ or what stands for it, one space between them: what may be an identifier.
CANDIDATE = rf"(?i)(?<!\S)\S*?(?:{_SIGN})\S*+(?: \S*?(?:{_SIGN})\S*+)*+"
#: What an added string of a kind must look like.
LOOKS = {
    "email": r"^[^\s@]+(?:@|\[at\]|\(at\))[^\s@]+$",
    "ip": r"^[0-9a-fA-F]{1,4}(?:[.:]{1,2}[0-9a-fA-F]{1,4}){3,7}$",
    "card": r"^(?:[0-9][ -]?){11,22}[0-9]$",
    "phone": r"^\(?[0-9](?:[ ().-]{0,3}[0-9]){6,14}$",
}
SUPPORT, TRUST, ACCEPT = 3, 0.8, 0.8


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(digits)).otherwise(False)


def _pieces(text: Column, pattern: str) -> Column:
    """Hits with the length of what stands before each: enough to place them."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))


def _contexts(text: Column) -> Column:
    """Candidates with the text around them, 120 characters at most: context of two words, not of the whole gap."""
    gaps = F.split(text, CANDIDATE, -1)
    hits = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    lengths = F.transform(gaps, F.length)
    return F.transform(
        hits,
        lambda h, i: F.struct(
            F.get(lengths, i).alias("gap"),
            h.alias("hit"),
            F.lower(F.substring(F.get(gaps, i), -120, 120)).alias("before"),
            F.lower(F.substring(F.get(gaps, i + 1), 1, 120)).alias("after"),
        ),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """One stored row per document: its matches of each pattern and its candidates; texts are read once."""
    text = F.col("__t")
    none, no_context = "array<struct<gap:int,hit:string>>", "array<struct<gap:int,hit:string,before:string,after:string>>"
    found = []
    for kind in KINDS:
        there = text.contains(NEEDS[kind]) & text.rlike("@" if kind == "email" else "[0-9]")
        found.append(F.when(there, _pieces(text, PATTERNS[kind])).otherwise(F.array().cast(none)).alias(kind))
    context = F.when(text.rlike(f"(?i){_SIGN}"), _contexts(text)).otherwise(F.array().cast(no_context)).alias("candidates")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), whole().alias("__t"))
    return stored(rows.select("doc_id", "row", *found, context), "scanned")


def _placed(rows: DataFrame, column: str) -> DataFrame:
    """(row, hit..., start, end) of the hits in ``column``; starts are running sums within a document."""
    w = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    flat = rows.select("row", F.posexplode(column).alias("at", "h")).select("row", "at", "h.*")
    end = F.sum(F.col("gap").cast("long") + F.length("hit")).over(w)
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("at", "gap")


def seeds(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit): what the fixed patterns find."""
    out = None
    for kind in KINDS:
        part = _placed(rows, kind).where(passes(kind, F.col("hit"))).select("row", F.lit(kind).alias("kind"), "start", "end", "hit")
        out = part if out is None else out.unionByName(part)
    return out


def _kind_within(hit: Column) -> Column:
    """The first kind whose pattern matches inside a candidate."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        hits = F.regexp_extract_all(hit, F.lit(PATTERNS[kind]), F.lit(0))
        out = F.when(F.exists(hits, partial(passes, kind)), F.lit(kind)).otherwise(out)
    return out


def _without_seeds(hit: Column, kind: str) -> Column:
    """A candidate with spaces in the place of its seeds of a kind."""
    found = F.regexp_extract_all(hit, F.lit(PATTERNS[kind]), F.lit(0))
    blank = F.transform(found, lambda h: F.when(passes(kind, h), F.regexp_replace(h, "(?s).", " ")).otherwise(h))
    return F.array_join(F.zip_with(F.split(hit, PATTERNS[kind], -1), blank, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def _rests(runs: DataFrame) -> DataFrame:
    """What stays of runs with seeds in them, as candidates of their own."""
    blank = runs.where("known is not null").withColumn("blank", F.col("hit"))
    for kind in KINDS:
        blank = blank.withColumn("blank", _without_seeds(F.col("blank"), kind))
    parts = blank.withColumn("c", F.explode(_placed_within(F.col("blank"))))
    first = lambda n: F.substring(F.col("blank"), F.lit(1), n.cast("int"))
    return parts.select(
        "row",
        F.col("c.hit").alias("hit"),
        F.concat("before", F.lower(first(F.col("c.end") - F.length("c.hit")))).alias("before"),
        F.concat(F.lower(F.substring(F.col("blank"), (F.col("c.end") + 1).cast("int"), F.length("blank"))), "after").alias("after"),
        (F.col("start") + F.col("c.end")).alias("end"),
        (F.col("start") + F.col("c.end") - F.length("c.hit")).alias("start"),
        F.lit(None).cast("string").alias("known"),
    )


def _placed_within(text: Column) -> Column:
    """Candidates of a short text with their ends."""
    pieces = _pieces(text, CANDIDATE)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            p["hit"].alias("hit"),
            F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda s, q: s + q["gap"] + F.length(q["hit"])).alias("end"),
        ),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """(row, start, end, value, known, patterns): identifier-like strings with their lexical patterns."""
    runs = _placed(rows, "candidates").withColumn("known", _kind_within(F.col("hit")))
    flat = runs.unionByName(_rests(runs))
    lead = F.length(F.regexp_extract("hit", r"^([\"'(\[<{]*)", 1))
    tail = F.length(F.regexp_extract("hit", r"([\"')\]>}.,;:!?]*)$", 1))
    left = F.regexp_extract("before", r"(\S+)\s+(\S+)\s*$", 1)
    near = F.regexp_extract("before", r"(\S+)\s*$", 1)
    right = F.regexp_extract("after", r"^\s*(\S+)", 1)
    made = F.array(
        F.when((left != "") & (near != ""), F.concat_ws(" ", F.lit("<"), left, near)),
        F.when((near != "") & (right != ""), F.concat_ws(" ", F.lit("<>"), near, right)),
    )
    inner = F.col("end") - tail - F.col("start") - lead
    return (
        flat.withColumn("patterns", F.filter(made, lambda p: p.isNotNull()))
        .withColumn("value", F.lower(F.substring(F.col("hit"), lead + 1, F.greatest(inner, F.lit(0)).cast("int"))))
        .select("row", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"), "value", "known", "patterns")
        .where("end > start")
    )


def discover(found: DataFrame, rounds: int | None = None, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """(value, kind, confidence): unseen strings that trusted patterns give a kind.

    A pattern is trusted for a kind when at least ``support`` distinct known strings stand in it and
    the known weigh at least ``trust`` of all its strings. Every round scores all patterns on all edges; without
    ``rounds`` they end when one accepts no new string, which comes since no round takes back what another accepted.
    """
    edges = stored(
        found.select("value", "known", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.max("known").alias("known")),
        "edges",
    )
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    plausible = F.lit(False)
    for kind, look in LOOKS.items():
        plausible = plausible | ((F.col("kind") == kind) & F.col("value").rlike(look))
    known = edges.where("known is not null").select("value", F.col("known").alias("kind"), F.lit(1.0).alias("weight")).distinct()
    added, before = None, 0
    for i in count() if rounds is None else range(rounds):
        now = known if added is None else known.unionByName(added.select("value", "kind", F.col("confidence").alias("weight")))
        strength = (
            edges.join(now, "value").groupBy("pattern", "kind").agg(F.sum("weight").alias("f"), F.count("*").alias("c")).where(F.col("c") >= support)
        )
        trusted = strength.join(total, "pattern").withColumn("p", F.col("f") / F.col("n")).where(F.col("p") >= trust)
        # 0.999 keeps the logarithm finite where a pattern has known strings only
        doubt = F.sum(F.log(1 - F.least("p", F.lit(0.999))))
        added = stored(
            edges.where("known is null")
            .join(trusted.select("pattern", "kind", "p"), "pattern")
            .where(plausible)
            .groupBy("value", "kind")
            .agg((1 - F.exp(doubt)).alias("confidence"))
            .where(F.col("confidence") >= accept),
            f"found{i}",
        )
        accepted = added.count()
        if accepted == before:
            break
        before = accepted
    return added


def find(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, row), and their spans as (row, kind, start, end, hit, added)."""
    rows = scanned(docs)
    base = seeds(rows).withColumn("added", F.lit(False))
    found = candidates(rows)
    new = discover(found, **how)
    places = found.where("known is null").join(new, "value").select("row", "kind", "start", "end", F.col("value").alias("hit"), F.lit(True).alias("added"))
    # an added span that meets a seed span gives way; a string with two kinds takes the first listed
    clash = places.alias("p").join(base.alias("b"), F.expr("p.row = b.row and p.start < b.end and b.start < p.end"), "left_anti")
    first = clash.groupBy("row", "start", "end").agg(F.min(F.struct(_rank().alias("__k"), "kind", "hit", "added")).alias("s"))
    extra = first.select("row", F.col("s.kind").alias("kind"), "start", "end", F.col("s.hit").alias("hit"), F.col("s.added").alias("added"))
    return rows.select("doc_id", "row"), base.unionByName(extra)


def _rank() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: counts by kind, hash of the seed spans, all spans as text, number of added spans."""
    rows, spans = find(docs, **how)
    listed = F.struct(_rank().alias("k"), F.col("start").alias("s"), F.concat_ws(":", "kind", "start", "end").alias("t"), F.col("added").alias("a"))
    per = spans.groupBy("row").agg(
        *[F.count(F.when((F.col("kind") == k) & ~F.col("added"), 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(F.col("added"), 1)).alias("n_added"),
        F.sort_array(F.collect_list(listed)).alias("l"),
    )
    texts = lambda keep: F.array_join(F.transform(keep, lambda x: x["t"]), ",")
    base = texts(F.filter(F.col("l"), lambda x: ~x["a"]))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in KINDS), "n_added")]
    return rows.join(per, "row", "left").select(
        "doc_id",
        *zero,
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"),
        F.coalesce(texts(F.col("l")), F.lit("")).alias("spans"),
    )


QUERY = "op4_pii"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
