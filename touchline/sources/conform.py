"""Give text columns the type that holds their values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _whole(value: Column) -> Column:
    """A whole number, also when written with a fraction of zero; null for anything else."""
    number = value.try_cast("double")
    return F.coalesce(value.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))


def profile_text(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Kind of each text column: empty, boolean, long, double or text; one scan, all rows."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        value = F.col(f"`{c}`")
        aggs += [F.count(value).alias(f"n{i}"), F.count_if(value.isin("True", "False")).alias(f"b{i}"),
                 F.count(_whole(value)).alias(f"w{i}"), F.count(value.try_cast("double")).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(names):
        n = r[f"n{i}"]
        kinds[c] = "empty" if n == 0 else "boolean" if r[f"b{i}"] == n else "long" if r[f"w{i}"] == n else "double" if r[f"d{i}"] == n else "text"
    return kinds


def conform(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns holding only True and False become nullable booleans, those holding only numbers become numbers.

    ``columns`` names the columns to look at (all text columns by default); declared text such as ids is left out by the caller.
    """
    typed = {"boolean": lambda c: c.try_cast("boolean"), "long": _whole, "double": lambda c: c.try_cast("double")}
    kinds = profile_text(df, columns)
    return df.withColumns({c: typed[k](F.col(f"`{c}`")) for c, k in kinds.items() if k in typed})
