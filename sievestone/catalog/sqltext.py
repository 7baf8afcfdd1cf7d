"""Pieces of SQL text for the oracle side: hashes, exact-count picks and the injectors stated with plain joins."""

from __future__ import annotations


def md5_of(seed, *parts: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(parts)}))"


def number_at(hashed: str, at: int = 1) -> str:
    return f"CAST(concat('0x', substr({hashed}, {at}, 8)) AS BIGINT)"


def below(hashed: str, n, at: int = 1) -> str:
    return f"({number_at(hashed, at)} % {n})"


def unit(hashed: str, at: int = 1) -> str:
    return f"({number_at(hashed, at)} / 4294967296.0::DOUBLE)"


def picked_cells(base: str, out: str, columns: list[str], rate: float, seed) -> str:
    """CTE `out`(row_id, col, h): exactly floor(rows * columns * rate) cells in hash order."""
    each = " UNION ALL ".join(f"SELECT row_id, '{c}' AS col, {md5_of(seed, 'row_id', repr(c))} AS h FROM {base}" for c in columns)
    return (f"{out} AS (SELECT row_id, col, h FROM (SELECT *, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS total "
            f"FROM ({each})) WHERE rn <= floor(total * {rate}::DOUBLE + 1e-9))")


def picked_rows(base: str, out: str, rate: float, seed) -> str:
    """CTE `out`(row_id, h, rn): exactly floor(rows * rate) rows in hash order."""
    return (f"{out} AS (SELECT row_id, h, rn FROM (SELECT row_id, h, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS total "
            f"FROM (SELECT row_id, {md5_of(seed, 'row_id')} AS h FROM {base})) WHERE rn <= floor(total * {rate}::DOUBLE + 1e-9))")


def with_missing(base: str, out: str, all_columns: list[str], columns: list[str], rate: float, seed, literal="NULL") -> str:
    """CTEs giving `out`: `base` with the picked cells blanked."""
    joins = " ".join(f"LEFT JOIN (SELECT row_id FROM {out}_hit WHERE col = '{c}') {out}_{c} ON {out}_{c}.row_id = b.row_id"
                     for c in columns)
    fields = ", ".join(f"CASE WHEN {out}_{c}.row_id IS NULL THEN b.{c} ELSE {literal} END AS {c}" if c in columns else f"b.{c}"
                       for c in all_columns)
    return f"{picked_cells(base, out + '_hit', columns, rate, seed)}, {out} AS (SELECT b.row_id, {fields} FROM {base} b {joins})"


def with_outliers(base: str, out: str, all_columns: list[str], numbers: list[str], rate: float, seed) -> str:
    chance = md5_of(f"{seed}/column", "b.row_id")
    sign = f"CASE WHEN {below(chance, 2, 9)} = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    fields = []
    for c in all_columns:
        if c in numbers:
            i = numbers.index(c)
            fields.append(f"CASE WHEN k.row_id IS NOT NULL AND {below(chance, len(numbers))} = {i} "
                          f"THEN b.{c} + {sign} * (6.0::DOUBLE * s.s_{c}) ELSE b.{c} END AS {c}")
        else:
            fields.append(f"b.{c}")
    spreads = ", ".join(f"stddev_samp({c}) AS s_{c}" for c in numbers)
    return (f"{picked_rows(base, out + '_hit', rate, seed)}, {out}_sd AS (SELECT {spreads} FROM {base}), "
            f"{out} AS (SELECT b.row_id, {', '.join(fields)} FROM {base} b LEFT JOIN {out}_hit k ON k.row_id = b.row_id "
            f"CROSS JOIN {out}_sd s)")


def with_duplicates(base: str, out: str, all_columns: list[str], rate: float, seed) -> str:
    fields = ", ".join(f"b.{c}" for c in all_columns)
    return (f"{picked_rows(base, out + '_hit', rate, seed)}, {out} AS (SELECT row_id, {', '.join(all_columns)} FROM {base} "
            f"UNION ALL SELECT k.rn + (SELECT max(row_id) FROM {base}) AS row_id, {fields} "
            f"FROM {base} b JOIN {out}_hit k ON k.row_id = b.row_id)")


def with_swaps(base: str, out: str, all_columns: list[str], columns: list[str], rate: float, seed, kinds: dict[str, str]) -> str:
    """Picked cells of a column take the value of the next picked cell in hash order, cyclically."""
    parts = [picked_cells(base, out + "_hit", columns, rate, seed)]
    for c in columns:
        parts.append(
            f"{out}_{c} AS (SELECT row_id, old, CASE WHEN rn = n THEN first_old ELSE next_old END AS new FROM (SELECT k.row_id, "
            f"b.{c} AS old, lead(b.{c}) OVER (ORDER BY k.h) AS next_old, first_value(b.{c}) OVER (ORDER BY k.h) AS first_old, "
            f"row_number() OVER (ORDER BY k.h) AS rn, count(*) OVER () AS n FROM {out}_hit k JOIN {base} b ON b.row_id = k.row_id "
            f"WHERE k.col = '{c}'))")
    joins = " ".join(f"LEFT JOIN {out}_{c} ON {out}_{c}.row_id = b.row_id" for c in columns)
    fields = ", ".join(f"CASE WHEN {out}_{c}.row_id IS NOT NULL THEN {out}_{c}.new ELSE b.{c} END AS {c}" if c in columns
                       else f"b.{c}" for c in all_columns)
    return ", ".join(parts) + f", {out} AS (SELECT b.row_id, {fields} FROM {base} b {joins})"


def is_token(value: str) -> str:
    return f"lower(trim({value}, ' \t\n\r')) IN ('', '?', '-', '--', 'n/a', 'na', 'n.a.', '#n/a', 'null', 'nan')"


def fences(base: str, out: str, columns: list[str], k: float = 1.5, tails=(0.005, 0.995)) -> str:
    """CTE `out`(col, lo, hi, by_tails) with one row per column."""
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS col, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, {tails[0]}) AS t1, "
        f"quantile_cont({c}, {tails[1]}) AS t2 FROM {base}" for c in columns)
    return (f"{out} AS (SELECT col, CASE WHEN q3 = q1 THEN t1 ELSE q1 - {k}::DOUBLE * (q3 - q1) END AS lo, "
            f"CASE WHEN q3 = q1 THEN t2 ELSE q3 + {k}::DOUBLE * (q3 - q1) END AS hi, q3 = q1 AS by_tails FROM ({rows}))")
