"""Registered queries: inconsistent spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import read
from sievestone.functions.hashing import draw, draw_below
from sievestone.operators import spelling as sp
from sievestone.catalog import sqltext as q

QUERIES, SQL, query = registry()

# Spellings planted by key hash: case, padding, separators, a trailing dot, short forms, a chain and one-letter slips.
PLANTED = [("lower", "lower(c_mktsegment)"), ("pad", "' ' || c_mktsegment"), ("dot", "c_mktsegment || '.'"),
           ("short", "substr(c_mktsegment, 1, 3)"), ("slip", "substr(c_mktsegment, 1, 3) || substr(c_mktsegment, 5)")]
SPOT = q.below(q.md5_of("spelling", "c_custkey"), 100)
BASE_SQL = (f"""spelled AS (SELECT c_custkey AS row_id, CASE {SPOT} {' '.join(f'WHEN {i} THEN {sql}' for i, (_, sql) in enumerate(PLANTED))}
 ELSE c_mktsegment END AS segment, CASE WHEN {SPOT} = 7 THEN 'nation-' || c_nationkey WHEN {SPOT} = 8 THEN 'NATION_' || c_nationkey ELSE
 'Nation ' || c_nationkey END AS nation, c_name AS name FROM customer)""")


def spelled(spark, sf):
    spot = draw_below(draw("spelling", F.col("c_custkey")), 100)
    segment = F.col("c_mktsegment")
    forms = [F.lower(segment), F.concat(F.lit(" "), segment), F.concat(segment, F.lit(".")), F.substring(segment, 1, 3),
             F.concat(F.substring(segment, 1, 3), F.substring(segment, 5, 100))]
    chosen = F.when(spot == 0, forms[0])
    for i, form in enumerate(forms[1:], start=1):
        chosen = chosen.when(spot == i, form)
    number = F.col("c_nationkey").cast("string")
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), chosen.otherwise(segment).alias("segment"),
        F.when(spot == 7, F.concat(F.lit("nation-"), number)).when(spot == 8, F.concat(F.lit("NATION_"), number))
        .otherwise(F.concat(F.lit("Nation "), number)).alias("nation"), F.col("c_name").alias("name"))


KEY = r"regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents(value)), ' .,;:''\"'), '(\w)[\s_.-]+(\w)', '\1 \2', 'g'), '(\w)[\s_.-]+(\w)', '\1 \2', 'g'), '\s+', ' ', 'g')"
RULES_SQL = f"""WITH {BASE_SQL}, d AS (SELECT 'segment' AS col, segment AS value, count(*) AS n FROM spelled GROUP BY 2 UNION ALL
  SELECT 'nation', nation, count(*) FROM spelled GROUP BY 2),
 w AS (SELECT col, value, n, {KEY} AS key FROM d),
 k AS (SELECT col, key, sum(n)::BIGINT AS total, first(value ORDER BY n DESC, value) AS canon FROM w GROUP BY 1, 2),
 variants AS (SELECT w.col, w.value, canon AS proposed, 'format_variant' AS rule, 'strict' AS tier, 2 AS p FROM w JOIN k USING (col, key) WHERE value <> canon),
 cand AS (SELECT a.col, a.key AS short, a.total AS st, b.key AS long, b.total AS lt, b.canon AS lcanon FROM k a JOIN k b ON a.col = b.col AND a.key <> b.key
  AND length(b.key) > length(a.key) WHERE length(replace(a.key, ' ', '')) <= 3 AND NOT regexp_full_match(replace(a.key, ' ', ''), '\\d+') AND
  (starts_with(b.key, a.key) OR (len(string_split(b.key, ' ')) >= 2 AND
   array_to_string(list_transform(string_split(b.key, ' '), lambda x: x[1]), '') = replace(a.key, ' ', '')))),
 judged AS (SELECT col, short, any_value(st) AS st, count(*) AS c, max(lt) AS lt, min(long) AS long FROM cand GROUP BY 1, 2),
 m AS (SELECT col, short, long FROM judged WHERE c = 1 AND st <= lt AND st / (st + lt)::DOUBLE <= 0.3),
 m2 AS (SELECT a.col, a.short, coalesce(b.long, a.long) AS long FROM m a LEFT JOIN m b ON a.col = b.col AND a.long = b.short),
 abbr AS (SELECT w.col, w.value, k.canon AS proposed, 'abbreviation' AS rule, 'strict' AS tier, 1 AS p FROM m2 JOIN k ON k.col = m2.col AND k.key = m2.long
  JOIN w ON w.col = m2.col AND w.key = m2.short),
 amb AS (SELECT w.col, w.value, NULL AS proposed, 'ambiguous_abbreviation' AS rule, 'loose' AS tier, 3 AS p FROM judged j JOIN w ON w.col = j.col AND w.key = j.short
  WHERE c > 1 AND st / (st + lt)::DOUBLE <= 0.3),
 o AS (SELECT k.* FROM k ANTI JOIN m ON m.col = k.col AND m.short = k.key WHERE length(key) >= 5),
 pairs AS (SELECT a.col, a.key, a.total, b.total AS bt, b.canon AS bc FROM o a JOIN o b ON a.col = b.col AND a.key <> b.key WHERE
  damerau_levenshtein(a.key, b.key) = 1 AND regexp_replace(a.key, '[0-9]', '', 'g') <> regexp_replace(b.key, '[0-9]', '', 'g')),
 t AS (SELECT col, key, any_value(total) AS total, any_value(bt) AS bt FROM pairs GROUP BY 1, 2 HAVING count(*) = 1),
 typo AS (SELECT w.col, w.value, NULL AS proposed, 'possible_typo' AS rule, 'loose' AS tier, 4 AS p FROM t JOIN w USING (col, key) WHERE t.total <= 0.05 * bt),
 every AS (SELECT * FROM abbr UNION ALL SELECT * FROM variants UNION ALL SELECT * FROM amb UNION ALL SELECT * FROM typo),
 flags AS (SELECT col, value, proposed, rule, tier FROM (SELECT *, row_number() OVER (PARTITION BY col, value ORDER BY p) AS rn FROM every) WHERE rn = 1) """
COLUMNS = ["segment", "nation", "name"]


@query("spelling_value_keys", f"""WITH {BASE_SQL}, d AS (SELECT DISTINCT segment AS value FROM spelled UNION SELECT DISTINCT nation FROM spelled)
 SELECT value, {KEY} AS key FROM d""")
def _(spark, sf):
    frame = spelled(spark, sf)
    values = frame.select(F.col("segment").alias("value")).union(frame.select("nation")).distinct()
    return values.select("value", sp.value_key("value").alias("key"))


@query("spelling_rules", RULES_SQL + 'SELECT col AS "column", value, proposed, rule, tier FROM flags')
def _(spark, sf):
    return sp.analyse_spelling(spelled(spark, sf), COLUMNS).flags.select("column", "value", "proposed", "rule", "tier")


@query("spelling_flagged_cells", RULES_SQL + """SELECT s.row_id, f.col AS "column", f.value AS original_value, f.proposed AS proposed_value, f.rule,
 f.tier FROM spelled s JOIN flags f ON (f.col = 'segment' AND f.value = s.segment) OR (f.col = 'nation' AND f.value = s.nation)""")
def _(spark, sf):
    frame = spelled(spark, sf)
    cells = sp.spelling_cells(frame, "row_id", sp.analyse_spelling(frame, COLUMNS))
    return cells.select("row_id", "column", "original_value", "proposed_value", "rule", "tier")


@query("spelling_rate", RULES_SQL + """, r AS (SELECT count(*) AS rows, count(*) FILTER (WHERE segment IN (SELECT value FROM flags WHERE col = 'segment') OR
 nation IN (SELECT value FROM flags WHERE col = 'nation')) AS flagged_rows FROM spelled) SELECT flagged_rows, rows, round(flagged_rows / rows::DOUBLE, 6) AS rate FROM r""")
def _(spark, sf):
    frame = spelled(spark, sf)
    return rounded(sp.spelling_rate(frame, "row_id", sp.analyse_spelling(frame, COLUMNS)), 6)


@query("spelling_free_text_guard", """SELECT 'c_name' AS "column", count(DISTINCT c_name) > 50 AS skipped FROM customer
 UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) > 50 FROM customer""")
def _(spark, sf):
    frame = read(spark, sf, "customer")
    _, kept, skipped, _ = sp.value_dictionary(frame, ["c_name", "c_mktsegment"])
    return spark.createDataFrame([(c, c in skipped) for c in list(skipped) + kept], "column string, skipped boolean")
