"""Benchmark cases from a JSON array or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom.functions.text import is_json_array

TEXT_KEYS = ("text", "sentence", "content")
WANT_KEYS = ("lang", "label", "code", "expected", "language")


def _pick(v: Column, names: tuple[str, ...]) -> Column:
    """The value of the first name that is there, if it is a string; null otherwise."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        at = F.try_variant_get(v, f"$.{name}", "variant")
        own = F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        out = F.when(F.array_contains(F.json_object_keys(F.to_json(v)), name), own).otherwise(out)
    return out


def pick_cases(objects: DataFrame) -> DataFrame:
    """case_id, text, want of rows (case_id, v VARIANT) that are objects with both as strings."""
    rows = objects.where(F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select("case_id", _pick(F.col("v"), TEXT_KEYS).alias("text"), _pick(F.col("v"), WANT_KEYS).alias("want")).where("text IS NOT NULL AND want IS NOT NULL")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id (the object's place), text, want. Malformed JSON is an error.

    A file that starts with a bracket is an array and is parsed as one document; JSON lines are split.
    """
    first = spark.read.text(path).where(~F.col("value").rlike(r"^\p{IsWhite_Space}*$")).select(is_json_array(F.col("value"))).first()
    if first is None:
        raise ValueError(f"no benchmark cases in {path}")
    if first[0]:
        whole = spark.read.option("wholetext", True).text(path)
        items = whole.select(F.posexplode(F.from_json("value", "array<variant>", {"mode": "FAILFAST"})).alias("case_id", "v"))
        return pick_cases(items.select(F.col("case_id").cast("long"), "v"))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("case_id"), "value").where(~F.col("value").rlike(r"^\p{IsWhite_Space}*$"))
    return pick_cases(lines.select("case_id", F.parse_json("value").alias("v")))
