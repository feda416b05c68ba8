"""Leakage-free splits: exclusions, availability splits, disjointness and fidelity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.membership import key_bitmap, may_be_in
from assaykit.session import written


def todo(manifest: DataFrame, done: DataFrame, keys: Sequence[str] = ("image_file",)) -> DataFrame:
    """Work left: manifest rows whose key has no result yet."""
    return manifest.join(done.select(*keys), list(keys), "left_anti")


def exclude_rows(index: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("patient", "slice")) -> DataFrame:
    """Drop the rows already used elsewhere, by composite key."""
    return index.join(manifest.select(*keys), list(keys), "left_anti")


def touched_groups(listing: DataFrame, excluded: DataFrame, group: str = "study_id", member: str = "image_id") -> DataFrame:
    """Groups that hold at least one excluded member, one row each, stored.

    One scan of the listing's two columns: a bitmap of the excluded members sorts out nearly all rows where they lie, and only the others are
    checked against the members themselves.
    """
    ids = written(excluded.select(member).distinct(), "excluded")
    near = may_be_in(listing.select(member, group), member, key_bitmap(ids, member))
    return written(near.join(ids, member, "left_semi").select(group).distinct(), "touched")


def exclude_groups(
    listing: DataFrame, excluded: DataFrame, group: str = "study_id", member: str = "image_id", touched: DataFrame | None = None
) -> DataFrame:
    """Drop every member of a group that holds at least one excluded member.

    ``touched`` saves finding the groups again. They are stored, so that Spark knows their size: it broadcasts them where they are
    small, and the listing then is not shuffled. A group with a third of all rows is one row there; adaptive
    execution splits the other side where it is joined by shuffle.
    """
    groups = touched_groups(listing, excluded, group, member) if touched is None else touched
    return listing.join(groups, group, "left_anti")


def candidates(listing: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    """Listed and labelled; either side alone is dropped."""
    return listing.join(labels, key, "inner")


def split_by_presence(wanted: DataFrame, available: DataFrame, key: str | Sequence[str], out: str = "found") -> DataFrame:
    """Flag each wanted row by presence on the other side; nothing is dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    seen = available.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return wanted.join(seen, keys, "left").withColumn(out, F.col("__seen").isNotNull()).drop("__seen")


def valid_slices(index: DataFrame, volumes: DataFrame, volume: str = "patient", position: str = "slice", depth: str = "n_slices") -> DataFrame:
    """Flag rows whose one-based position lies inside an existing volume."""
    return (
        index.join(volumes.select(volume, depth), volume, "left")
        .withColumn("valid", F.coalesce((F.col(position) >= 1) & (F.col(position) <= F.col(depth)), F.lit(False)))
        .drop(depth)
    )


def align_sources(*sources: DataFrame) -> DataFrame:
    """Union by name; a field a source lacks is null, No_Hemorrhage is derived."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if "any_hemorrhage" in out.columns:
        known = F.col("No_Hemorrhage") if "No_Hemorrhage" in out.columns else F.lit(None).cast("int")
        out = out.withColumn("No_Hemorrhage", F.coalesce(known, 1 - F.col("any_hemorrhage")))
    return out


def overlap_counts(a: DataFrame, b: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Per level (image, study, patient): distinct values, and how many occur in both sets.

    Each side is read once for all levels; values are folded on the map side, so one
    value on most rows is one row of the shuffle.
    """

    def values(df: DataFrame, side: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("v")) for c in levels])
        return df.select(F.inline(pairs), F.lit(side).alias("side"))

    sides = values(a, 1).unionByName(values(b, 2)).groupBy("level", "v").agg(F.bit_or("side").alias("s"))
    wide = sides.agg(
        *[
            F.count_if((F.col("level") == c) & F.col("s").isin(*which)).alias(f"__{name}{i}")
            for i, c in enumerate(levels)
            for name, which in (("a", (1, 3)), ("b", (2, 3)), ("shared", (3,)))
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("level"),
            F.col(f"__a{i}").alias("n_a"),
            F.col(f"__b{i}").alias("n_b"),
            F.col(f"__shared{i}").alias("n_shared"),
        )
        for i, c in enumerate(levels)
    ]
    return wide.select(F.inline(F.array(*rows)))


def combination_shares(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    text = F.concat_ws("", *[F.col(k).cast("string") for k in labels])
    counts = df.select(text.alias("combination")).groupBy("combination").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per combination
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything))


def fidelity(sample: DataFrame, population: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: total variation distance of combination shares, and the multi-label shares."""
    s, p = combination_shares(sample, labels), combination_shares(population, labels)
    multi: Column = F.length(F.regexp_replace("combination", "[^1]", "")) > 1
    both = (
        s.select("combination", F.col("share").alias("s"), F.lit(0.0).alias("p"))
        .unionByName(p.select("combination", F.lit(0.0).alias("s"), F.col("share").alias("p")))
        .groupBy("combination")
        .agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    )
    return both.agg(
        (F.sum(F.abs(F.col("s") - F.col("p"))) / 2).alias("total_variation"),
        F.coalesce(F.sum(F.when(multi, F.col("s"))), F.lit(0.0)).alias("sample_multi_share"),
        F.coalesce(F.sum(F.when(multi, F.col("p"))), F.lit(0.0)).alias("population_multi_share"),
        F.count(F.lit(1)).alias("n_combinations"),
    )


def label_prevalence(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(class, n, positives, share), one aggregation for all labels."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(k).cast("long")).alias(f"__{k}") for k in labels])
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"__{k}").alias("positives")) for k in labels])
    return wide.select("n", F.inline(rows)).withColumn("share", F.col("positives") / F.col("n"))
