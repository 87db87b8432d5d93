"""Rules over JSON texts: each row's faults as (path, reason), by variant values; maps that later entries win."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What the value at a path (``$.a.b``) should be: of a kind (long, double, string, boolean, array, object), there, within bounds, like a pattern."""

    path: str
    kind: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    pattern: str | None = None


def _kind(value: Column) -> Column:
    """The kind of a variant; numbers without a fraction are long."""
    name = F.schema_of_variant(value)
    return F.when(value.isNull() | (name == "VOID"), F.lit(None).cast("string")).when(name == "BIGINT", "long").when(name == "DOUBLE", "double").when(name.startswith("DECIMAL"), "double").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("other")


def _faults(variant: Column, rule: Rule) -> Column:
    value = F.try_variant_get(variant, rule.path, "variant")
    kind = _kind(value)
    fits = kind == rule.kind if rule.kind != "double" else kind.isin("double", "long")
    number, text = F.try_variant_get(variant, rule.path, "double"), F.try_variant_get(variant, rule.path, "string")
    checks = [F.when(kind.isNull(), "missing" if rule.required else None), F.when(~fits, F.concat(F.lit(f"expected {rule.kind}, found "), kind))]
    if rule.least is not None:
        checks.append(F.when(number < rule.least, f"less than {rule.least:g}"))
    if rule.most is not None:
        checks.append(F.when(number > rule.most, f"more than {rule.most:g}"))
    if rule.pattern is not None:
        checks.append(F.when(~text.rlike(rule.pattern), f"not like {rule.pattern}"))
    reason = F.coalesce(*[c.cast("string") for c in checks])
    return F.when(reason.isNotNull(), F.struct(F.lit(rule.path).alias("path"), reason.alias("reason")))


def validated(rows: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """The rows with ``faults``, an array of (path, reason) in the order of the rules; ($, no JSON) alone for a text that cannot be read, ($, missing) for null.

    A value that is JSON's null is missing. Only the first reason of a path counts. Of an object that names a key twice
    the session decides (``spark.sql.variant.allowDuplicateKeys``); by default its text cannot be read.
    """
    fault = lambda why: F.array(F.struct(F.lit("$").alias("path"), F.lit(why).alias("reason")))
    read = rows.withColumn("__variant", F.try_parse_json(column))
    found = F.filter(F.array(*[_faults(F.col("__variant"), r) for r in rules]), lambda f: f.isNotNull())
    whole = F.when(F.col(column).isNull(), fault("missing")).when(F.col("__variant").isNull(), fault("no JSON")).otherwise(found)
    return read.withColumn("faults", whole).drop("__variant")


def merged_maps(*maps: Column) -> Column:
    """The entries of all maps; of equal keys the last map wins. A null map has no entries."""
    return reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)), maps)


def last_entries(entries: Column) -> Column:
    """A map from an array of (key, value); of equal keys the last entry wins. Null keys are left out."""
    keyed = F.filter(entries, lambda e: e["key"].isNotNull())
    latest = F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(latest)
