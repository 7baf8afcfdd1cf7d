"""The registered queries: each runs an operator over the given tables, most with the same result stated as SQL."""
