"""Label vectors: sets, packed strings, answer grammar and binarisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.fixed_values import SUBTYPES

POLICIES = ("negative", "positive", "ignore")


def present_array(labels: Sequence[str] = SUBTYPES) -> Column:
    """The label keys whose flag is 1, in listing order."""
    return F.array_compact(F.array(*[F.when(F.col(k) == 1, F.lit(k)) for k in labels]))


def present_text(labels: Sequence[str] = SUBTYPES, sep: str = "; ") -> Column:
    return F.concat_ws(sep, *[F.when(F.col(k) == 1, F.lit(k)) for k in labels])


def any_flag(labels: Sequence[str] = SUBTYPES) -> Column:
    return F.greatest(*[F.coalesce((F.col(k) == 1).cast("int"), F.lit(0)) for k in labels])


def shares_label(a: str | Column, b: str | Column) -> Column:
    return F.arrays_overlap(a, b)


def answer_text(labels: Sequence[str] = SUBTYPES) -> Column:
    """The two-line answer a labelled exemplar would give."""
    present = present_array(labels)
    return F.when(F.size(present) == 0, F.lit("HEMORRHAGE: no\nSUBTYPES: none")).otherwise(
        F.concat(F.lit("HEMORRHAGE: yes\nSUBTYPES: "), F.array_join(present, ", "))
    )


def binarise(label: Column, policy: str = "negative") -> Column:
    """Four-valued label to 0/1 under an uncertainty policy.

    A null label (not parsed) is 0 under every policy; any value but 0 and 1 is
    uncertain and becomes 0, 1 or (``ignore``) null, which drops the row.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown uncertainty policy: {policy!r}")
    uncertain = {"negative": F.lit(0), "positive": F.lit(1), "ignore": F.lit(None).cast("int")}[policy]
    return F.when(label.isNull() | (label == 0), F.lit(0)).when(label == 1, F.lit(1)).otherwise(uncertain)


def outcome(gt: Column, pred: Column, policy: str = "negative") -> Column:
    """'tp', 'fp', 'fn' or 'rest' (true negative or dropped by the policy)."""
    g, p = binarise(gt, policy), binarise(pred, policy)
    return (
        F.when((g == 1) & (p == 1), F.lit("tp"))
        .when((g == 0) & (p == 1), F.lit("fp"))
        .when((g == 1) & (p == 0), F.lit("fn"))
        .otherwise(F.lit("rest"))
    )
