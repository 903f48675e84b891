"""Declarative filter specs: lists of ``{"column", "op", "value"}`` compiled to Spark columns."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "in", "gt", "gte", "lt", "lte", "notnull")
Spec = dict


def as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _numbers(values: list) -> list[float] | None:
    try:
        return [float(v) for v in values]
    except (TypeError, ValueError):
        return None


def _always_false() -> Column:
    return F.lit(False)


def compile_filter(schema: T.StructType, spec: Spec) -> Column:
    """One filter as a never-null boolean.

    Numbers compare as numbers, everything else as lower-case text; order comparisons coerce to a
    number and drop what does not convert; ``ne`` keeps nulls; an unknown column matches nothing.
    """
    column, op, value = spec["column"], spec["op"], spec.get("value")
    if op not in OPS:
        raise ValueError(f"unknown filter op {op!r}; known: {OPS}")
    if column not in schema.names:
        return _always_false()
    c = F.col(f"`{column}`")
    if op == "notnull":
        return c.isNotNull()
    if op in ("gt", "gte", "lt", "lte"):
        n = c.try_cast("double")
        test = {"gt": n > value, "gte": n >= value, "lt": n < value, "lte": n <= value}[op]
        return F.coalesce(test, F.lit(False))
    numbers = _numbers(as_list(value)) if isinstance(schema[column].dataType, T.NumericType) else None
    if numbers is not None:
        if op == "in":
            return F.coalesce(c.isin(numbers), F.lit(False))
        same = c.eqNullSafe(F.lit(numbers[0]))
        return same if op == "eq" else ~same
    low = F.lower(c.cast("string"))
    if op == "in":
        return F.coalesce(low.isin([str(v).lower() for v in as_list(value)]), F.lit(False))
    same = low.eqNullSafe(F.lit(str(value).lower()))
    return same if op == "eq" else ~same


def scope(specs: Sequence[Spec]) -> Column:
    """Restriction to the listed event types; the last event_type filter wins."""
    types: list = []
    for s in specs:
        if s["column"] == "event_type":
            types = as_list(s["value"])
    return F.coalesce(F.col("event_type").isin(types), F.lit(False)) if types else F.lit(True)


def conditions(df: DataFrame, specs: Sequence[Spec]) -> list[tuple[Spec, Column]]:
    return [(s, compile_filter(df.schema, s)) for s in specs if s["column"] != "event_type"]


def execute(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Rows of the scope on which every filter holds."""
    return df.where(reduce(lambda a, b: a & b, [c for _, c in conditions(df, specs)], scope(specs)))


def _counts(df: DataFrame, specs: Sequence[Spec]) -> tuple[DataFrame, list[Spec | None]]:
    """One row with arrays ``rows`` (filters ANDed on one by one) and ``alone``, from one scan."""
    running, all_rows, alone, labels = scope(specs), [], [], [None]
    base = running
    all_rows.append(F.count_if(base))
    alone.append(F.count_if(base))
    for spec, cond in conditions(df, specs):
        running = running & cond
        labels.append(spec)
        all_rows.append(F.count_if(running))
        alone.append(F.count_if(base & cond))
    return df.agg(F.array(*all_rows).alias("rows"), F.array(*alone).alias("alone")), labels


def describe(spec: Spec | None) -> str | None:
    return None if spec is None else f"{spec['column']} {spec['op']} {spec.get('value')}"


def funnel(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """step, filter, rows, alone: how each filter narrows the result and what it matches by itself."""
    counts, labels = _counts(df, specs)
    names = F.array(*[F.lit(describe(s)).cast("string") for s in labels])
    steps = F.arrays_zip(names.alias("filter"), F.col("rows"), F.col("alone"))
    return counts.select(F.posexplode(steps).alias("step", "s")).select(
        "step", F.col("s.filter").alias("filter"), F.col("s.rows").alias("rows"), F.col("s.alone").alias("alone"))


def explain_empty(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """One row: final row count and, when it is zero, which filter emptied the result and why.

    reason is ``no_scope_rows``, ``impossible`` (matches nothing alone), ``conflict`` (matches alone
    but not together with an earlier filter) or null when rows remain.
    """
    counts, labels = _counts(df, specs)
    names = F.array(*[F.lit(describe(s)).cast("string") for s in labels])
    final = F.element_at("rows", -1)
    at = F.array_position(F.col("rows"), F.lit(0)).cast("int")
    hit = (final == 0) & (at > 1)
    return counts.select(
        final.alias("rows"),
        F.when(hit, at - 1).alias("step"),
        F.when(hit, F.try_element_at(names, at)).alias("filter"),
        F.when(hit, F.try_element_at("rows", F.greatest(at - 1, F.lit(1)))).alias("rows_before"),
        F.when(hit, F.try_element_at("alone", F.greatest(at, F.lit(1)))).alias("alone"),
        F.when(final > 0, F.lit(None)).when(at == 1, "no_scope_rows")
        .when(F.try_element_at("alone", F.greatest(at, F.lit(1))) == 0, "impossible").otherwise("conflict").alias("reason"))
