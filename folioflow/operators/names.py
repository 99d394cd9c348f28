"""Names that don't collide, for any number of rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A name that numbering could have made: a base, a dash and a number from 2 on.
_MADE = r"^(.*)-([2-9]|[1-9][0-9]{1,8})$"


def with_free_names(df: DataFrame, within: list[str], name: str, order: str | list[str], existing: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name`` unique within the columns ``within``.

    The first row of a name keeps it; the others get the name with -2, -3, .., in order, skipping every number whose name some row has of itself or
    that ``existing`` (within, name) holds. A name that exists already is given to no row. So no two rows meet, whichever names come in.
    Rows with a null name count as one name. One window over equal names, and joins on names that repeat; nothing is collected but a name's taken numbers.
    """
    key = [*within, name]
    order = [order] if isinstance(order, str) else list(order)
    mine = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    if existing is None:
        known = mine.withColumn("_exists", F.lit(False))
    else:
        there = existing.select(*key).distinct().withColumn("_exists", F.lit(True))
        both = mine.alias("m").join(there.alias("e"), _same("m", "e", key), "full")
        known = both.select(*(F.coalesce(F.col(f"m.{c}"), F.col(f"e.{c}")).alias(c) for c in key),
            F.coalesce("_rows", F.lit(0)).alias("_rows"), F.coalesce("_exists", F.lit(False)).alias("_exists"))
    base, number = F.regexp_extract(name, _MADE, 1), F.regexp_extract(name, _MADE, 2)
    taken = known.where(F.col(name).rlike(_MADE)).select(*within, base.alias("_base"), number.cast("int").alias("_k"))
    taken = taken.groupBy(*within, "_base").agg(F.sort_array(F.collect_set("_k")).alias("_taken"))
    busy = known.where("_rows > 1 OR _exists").select(*key, "_exists")
    busy = busy.alias("b").join(taken.alias("t"), _same("b", "t", within) & (F.col(f"b.{name}") == F.col("t._base")),
        "left").select(*(F.col(f"b.{c}").alias(c) for c in key), "_exists", "_taken")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    joined = ranked.alias("r").join(busy.alias("b"), _same("r", "b", key), "left").select("r.*", "b._exists", "b._taken")
    # the j-th number from 2 on that is free; j = 0 keeps the name
    j = F.col("_r") - F.when(F.coalesce("_exists", F.lit(False)), 0).otherwise(1)
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), (j + 1).cast("int"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    out = F.when(j == 0, F.col(name)).otherwise(F.concat(F.coalesce(name, F.lit("")), F.lit("-"), free.cast("string")))
    return joined.withColumn(name, out).select(*df.columns)


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out
