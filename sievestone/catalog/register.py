"""How catalog modules register their queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.functions.columns import named


def registry():
    """(queries, sql, decorator) of one catalog module."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str | None = None):
        def register(function):
            queries[name] = function
            if text:
                sql[name] = text
            return function

        return register

    return queries, sql, query


def rounded(df, digits=4, columns=None):
    """Double columns rounded for a value-by-value comparison."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select(*[F.round(named(c), digits).alias(c) if c in columns else named(c) for c in df.columns])
