"""Writing cell changes into a table: the one join every repair and every injector shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions.columns import named


def overlay(df: DataFrame, row_id: str, changes: DataFrame, types: dict[str, str] | None = None,
            columns: list[str] | None = None) -> DataFrame:
    """`df` with the cells in `changes(row_id, column, value)` replaced; `value` is text and is cast to the column's type.

    Changes become one row per changed table row first, so the table meets them in a single join on the unique row id.
    A null value blanks the cell. At most one change per cell is expected.
    """
    known = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or known) if c != row_id]
    wide = changes.groupBy("row_id").agg(*[
        F.max(F.when(F.col("column") == c, F.struct(F.lit(1).alias("set"), F.col("value").alias("value")))).alias(f"_c{i}")
        for i, c in enumerate(columns)])
    joined = df.join(wide.withColumnRenamed("row_id", "_row"), named(row_id) == F.col("_row"), "left")
    place = {c: i for i, c in enumerate(columns)}
    projection = []
    for name, data_type in known.items():
        if name not in place:
            projection.append(named(name))
            continue
        target = (types or {}).get(name, data_type)
        change = F.col(f"_c{place[name]}")
        projection.append(F.when(change.isNotNull(), change["value"].cast(target))
                          .otherwise(named(name).cast(target)).alias(name))
    return joined.select(*projection)
