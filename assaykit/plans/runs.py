"""Run specifications: argument checks and the experiment grid."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.retrieval import NEG_POSITIONS

CONTEXTS = ("none", "text", "text-twostage", "image")


@dataclass(frozen=True)
class RunSpec:
    """One experiment setting."""

    run: str
    context: str = "none"
    k: int = 3
    random: bool = False
    contrastive: bool = False
    neg_position: str = "last"
    n_pos: int = 2
    n_neg: int = 1
    random_neg: bool = False
    index: str = "default"

    def __post_init__(self) -> None:
        if self.context not in CONTEXTS:
            raise ValueError(f"unknown context: {self.context!r}")
        if self.neg_position not in NEG_POSITIONS:
            raise ValueError(f"unknown negative position: {self.neg_position!r}")
        if self.k < 1 or self.n_pos < 0 or self.n_neg < 0:
            raise ValueError("k must be positive, counts must not be negative")


def resolve_mode(
    two_stage: bool | None = None, image: bool | None = None, default_two_stage: bool = False, default_image: bool = False
) -> str:
    """Retrieval mode from two flags, each with its own default; both at once is an error."""
    two = default_two_stage if two_stage is None else two_stage
    img = default_image if image is None else image
    if two and img:
        raise ValueError("two_stage and image retrieval exclude each other")
    return "image" if img else "text-twostage" if two else "none"


def experiment_grid(queries: DataFrame, specs: Iterable[RunSpec]) -> DataFrame:
    """Every query under every setting: the settings are a literal array, exploded per row."""
    specs = list(specs)
    names = [s.run for s in specs]
    if len(set(names)) != len(names):
        raise ValueError("run names must be unique")
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in asdict(s).items()]) for s in specs])
    return queries.select("*", F.inline(rows))
