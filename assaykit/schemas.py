"""StructTypes of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

from assaykit.fixed_values import SUBTYPES, WIDE_COLUMNS

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


WIDE_LABELS = _struct(
    ("PatientNumber", _D),
    ("SliceNumber", _D),
    *((c, _D) for c in WIDE_COLUMNS),
    ("No_Hemorrhage", _D),
    ("Fracture_Yes_No", _D),
)

LONG_LABELS = _struct(("ID", _S), ("Label", _I))

# is_normal arrives as text ("True", "1", "true") and is re-typed on read.
MANIFEST_FILE = _struct(
    ("image_file", _S),
    ("patient", _I),
    ("slice", _I),
    ("any_hemorrhage", _I),
    ("is_normal", _S),
    ("present_subtypes", _S),
    *((k, _I) for k in SUBTYPES),
    ("Fracture", _I),
    ("No_Hemorrhage", _I),
)

POOL_MANIFEST_FILE = _struct(
    ("image_file", _S),
    ("study_id", _S),
    ("any_hemorrhage", _I),
    ("is_normal", _S),
    ("present_subtypes", _S),
    *((k, _I) for k in SUBTYPES),
)

RESULTS = _struct(
    ("run", _S),
    ("seq", _L),
    ("image_file", _S),
    ("patient", _I),
    ("slice", _I),
    ("pred_any_hem", _I),
    *((f"pred_{k}", _I) for k in SUBTYPES),
    ("refused", _B),
    ("parsed", _B),
    ("method", _S),
    ("raw_text", _S),
    ("gen_seconds", _D),
    ("n_tokens", _I),
    ("stage1_findings", _S),
)

ANSWERS = _struct(
    ("run", _S),
    ("image_file", _S),
    ("raw_text", _S),
    ("gen_seconds", _D),
    ("n_tokens", _I),
)

MODEL_RUNS = _struct(
    ("timestamp", _S),
    ("model", _S),
    ("quant", _S),
    ("status", _S),
    ("load_seconds", _D),
    ("generation_seconds", _D),
    ("new_tokens", _L),
    ("tokens_per_second", _D),
    ("peak_vram_reserved_gb", _D),
    ("fits_16gb", _B),
)
