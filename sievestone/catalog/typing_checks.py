"""Registered queries: typing, masking and the side checks on columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog import sqltext as q
from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import MESSY_SQL, SALES_SQL, messy, read, sales
from sievestone.functions.columns import count_when, squeezed
from sievestone.operators import prepare as typing
from sievestone.operators.prepare import prepare

QUERIES, SQL, query = registry()


@query("prepare_typed_table", f"""WITH {MESSY_SQL} SELECT row_id,
 CASE WHEN {q.is_token('segment')} THEN NULL ELSE segment END AS segment, CASE WHEN balance = -999 THEN NULL ELSE balance END AS balance,
 CASE WHEN comma_price = '-' THEN NULL ELSE CAST(replace(comma_price, ',', '.') AS DOUBLE) END AS comma_price,
 CASE WHEN text_price = '' THEN NULL ELSE CAST(text_price AS DOUBLE) END AS text_price, zip,
 CASE WHEN word = 'Unknown / missing' THEN NULL ELSE word END AS word, mostly_code,
 CASE WHEN text_code IN ('-9', '-9.0') THEN NULL ELSE text_code END AS text_code,
 CAST(even AS VARCHAR) AS even, CAST(nation AS DOUBLE) AS nation FROM messy""")
def _(spark, sf):
    return prepare(messy(spark, sf), "row_id").frame


@query("prepare_declared_and_kept", f"""WITH {MESSY_SQL} SELECT row_id, CASE WHEN segment IS NULL OR {q.is_token('segment')} OR
 lower(trim(segment)) = 'machinery' THEN NULL ELSE segment END AS segment, balance, CASE WHEN nation = 7 THEN NULL ELSE CAST(nation AS DOUBLE) END AS nation FROM messy""")
def _(spark, sf):
    frame = messy(spark, sf).select("row_id", "segment", "balance", "nation")
    return prepare(frame, "row_id", declared={"segment": ["Machinery"], "nation": ["7"]}, keep=["balance"]).frame


@query("placeholder_cells", f"""WITH {MESSY_SQL} SELECT count(*) FILTER (WHERE {q.is_token('segment')}) AS segment,
 count(*) FILTER (WHERE {q.is_token('comma_price')}) AS comma_price, count(*) FILTER (WHERE {q.is_token('text_price')}) AS text_price FROM messy""")
def _(spark, sf):
    return messy(spark, sf).agg(*[count_when(typing.is_token(F.col(c))).alias(c) for c in ("segment", "comma_price", "text_price")])


@query("numeric_text_decision", f"""WITH {MESSY_SQL}, u AS (SELECT 'comma_price' AS "column", comma_price AS v FROM messy UNION ALL
 SELECT 'text_price', text_price FROM messy UNION ALL SELECT 'zip', zip FROM messy UNION ALL SELECT 'segment', segment FROM messy),
 m AS (SELECT "column", v FROM u WHERE NOT ({q.is_token('v')}))
 SELECT "column", bool_and(regexp_full_match(trim(v), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')) AND NOT bool_or(length(trim(v)) > 1
  AND starts_with(trim(v), '0') AND NOT starts_with(trim(v), '0.') AND NOT starts_with(trim(v), '0,')) AS is_number,
  bool_and(regexp_full_match(v, '\\s*-?\\d+(,\\d+)?\\s*')) AND bool_or(contains(v, ',')) AS is_comma_number FROM m GROUP BY 1""")
def _(spark, sf):
    frame = messy(spark, sf)
    out = None
    for c in ("comma_price", "text_price", "zip", "segment"):
        masked = typing.mask_tokens(F.col(c))
        row = frame.agg(
            (F.bool_and(typing.is_number(masked)) & ~F.bool_or(typing.has_leading_zero(masked))).alias("is_number"),
            (F.bool_and(masked.rlike(typing.COMMA_NUMBER)) & F.bool_or(masked.contains(","))).alias("is_comma_number")
        ).select(F.lit(c).alias("column"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("placeholder_codes_found", f"""WITH {MESSY_SQL} SELECT 'balance' AS "column", 'flag' AS status, count(*) FILTER (WHERE balance = -999) AS cells FROM messy
 UNION ALL SELECT 'word', 'flag', count(*) FILTER (WHERE word = 'Unknown / missing') FROM messy
 UNION ALL SELECT 'text_code', 'flag', count(*) FILTER (WHERE text_code IN ('-9', '-9.0')) FROM messy
 UNION ALL SELECT 'mostly_code', 'majority', count(*) FILTER (WHERE mostly_code = -1) FROM messy""")
def _(spark, sf):
    out = prepare(messy(spark, sf), "row_id")
    rows = [(c, f.status, f.count) for found in (out.codes, out.majority) for c, items in found.items() for f in items]
    return spark.createDataFrame(rows, "column string, status string, cells long")


@query("prepare_notes")
def _(spark, sf):
    return typing.prepared_notes(prepare(messy(spark, sf), "row_id"))


@query("suggest_task", """SELECT 'regression' AS task, 1.0::DOUBLE AS numeric_share, count(DISTINCT o_totalprice) AS n_distinct FROM orders
 UNION ALL SELECT 'classification', 0.0::DOUBLE, count(DISTINCT o_orderstatus) FROM orders UNION ALL
 SELECT 'classification', 1.0::DOUBLE, count(DISTINCT quality) FROM labels""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    return (typing.suggest_task(orders, "o_totalprice").unionByName(typing.suggest_task(orders, "o_orderstatus"))
            .unionByName(typing.suggest_task(read(spark, sf, "labels"), "quality")))


@query("prepare_regression_target", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def _(spark, sf):
    frame = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_orderstatus",
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(-999.0)).otherwise(F.col("o_totalprice")).alias("price"))
    return prepare(frame, "row_id", target="price", task="regression").frame.select("row_id", "price")


@query("range_and_glued_text", """WITH t AS (SELECT CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' - ' || CAST(CAST(floor(o_totalprice) AS BIGINT) + 10 AS VARCHAR) AS band,
  o_orderpriority || chr(10) || CAST(o_custkey AS VARCHAR) AS glued, o_custkey, o_orderkey FROM orders)
 SELECT 'band' AS "column", 'o_custkey' AS other, 1.0::DOUBLE AS range_share, 0.0::DOUBLE AS glued_share, NULL::DOUBLE AS equal_share, true AS is_range, false AS is_glued
 UNION ALL SELECT 'band', 'o_orderkey', 1.0, 0.0, NULL, true, false UNION ALL SELECT 'glued', 'o_custkey', 0.0, 1.0,
  round(avg((abs(regexp_extract(glued, '\\n\\s*(-?\\d+)', 1)::DOUBLE - o_custkey) <= 1e-8 + 1e-5 * o_custkey)::INT), 6), false, true FROM t
 UNION ALL SELECT 'glued', 'o_orderkey', 0.0, 1.0, round(avg((abs(o_custkey - o_orderkey) <= 1e-8 + 1e-5 * o_custkey)::INT), 6), false, false FROM t""")
def _(spark, sf):
    low = F.floor("o_totalprice").cast("long")
    frame = read(spark, sf, "orders").select(
        F.concat(low.cast("string"), F.lit(" - "), (low + 10).cast("string")).alias("band"),
        F.concat("o_orderpriority", F.lit("\n"), F.col("o_custkey").cast("string")).alias("glued"), "o_custkey", "o_orderkey")
    return typing.diagnostics(frame, ["band", "glued"], ["o_custkey", "o_orderkey"])


@query("suggest_target_column", """SELECT 'quality' AS "column", count(DISTINCT quality) AS n_distinct, true AS is_candidate, false AS suggested FROM labels
 UNION ALL SELECT 'toxic', count(DISTINCT toxic), true, true FROM labels""")
def _(spark, sf):
    return typing.suggest_targets(read(spark, sf, "labels"), "doc_id")


@query("columns_too_wide_for_models", """SELECT 'o_clerk' AS "column", count(DISTINCT o_custkey) AS levels FROM orders HAVING count(DISTINCT o_custkey) > 100
 UNION ALL SELECT 'day', count(DISTINCT o_orderdate::DATE) FROM orders HAVING count(DISTINCT o_orderdate::DATE) > 100""")
def _(spark, sf):
    frame = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("o_clerk"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    counted = read(spark, sf, "orders").agg(F.count_distinct("o_custkey").alias("o_clerk"),
                                            F.count_distinct(F.to_date("o_orderdate")).alias("day"))
    wide = typing.wide_text_columns(prepare(frame, "row_id"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("levels")) for c in wide])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


@query("labelled_rows", """SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL""")
def _(spark, sf):
    joined = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return joined.filter("quality is not null").select("doc_id", "lang", "quality")


@query("formatted_numbers", """WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '$' || printf('%.2f', round(o_totalprice, 2)) WHEN o_orderkey % 3 = 1 THEN
  CAST(o_orderkey % 100 AS VARCHAR) || '%' ELSE CAST(o_orderkey AS VARCHAR) END AS shown, o_orderpriority FROM orders)
 SELECT 'shown' AS "column", true AS is_formatted, count(*) FILTER (WHERE shown LIKE '$%' OR shown LIKE '%\\%' ESCAPE '\\') AS formatted_cells FROM t UNION ALL
 SELECT 'o_orderpriority', false, 0 FROM t LIMIT 2""")
def _(spark, sf):
    frame = read(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), F.format_string("%.2f", F.round("o_totalprice", 2))))
        .when(F.col("o_orderkey") % 3 == 1, F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%")))
        .otherwise(F.col("o_orderkey").cast("string")).alias("shown"), "o_orderpriority")
    out = None
    for c in ("shown", "o_orderpriority"):
        formatted = typing.is_formatted_number(F.col(c))
        row = frame.agg((F.bool_or(formatted) & F.bool_and(formatted | typing.is_number(F.col(c)))).alias("is_formatted"),
                        count_when(formatted).alias("formatted_cells")).select(F.lit(c).alias("column"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("squeezed_text", """SELECT doc_id, md5(lower(regexp_replace(trim(text, ' \t\n\r' || chr(11) || chr(12)), '\\s+', ' ', 'g'))) AS squeezed_md5 FROM documents""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(squeezed(F.col("text"))).alias("squeezed_md5"))


@query("row_predicates", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000
 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '1%'""")
def _(spark, sf):
    return read(spark, sf, "orders").filter(
        F.col("o_totalprice").between(100000, 200000) & F.col("o_orderstatus").isin("F", "P")
        & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("derived_columns", f"""WITH {SALES_SQL} SELECT row_id, round(ln(1 + price), 6) AS log_price, round(balance * balance, 2) AS balance_squared,
 CASE WHEN price < 100000 THEN 'small' WHEN price < 300000 THEN 'middle' ELSE 'large' END AS size,
 starts_with(priority, '1')::INT AS urgent, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS status_code, nation AS country FROM sales""")
def _(spark, sf):
    return sales(spark, sf).select(
        "row_id", F.round(F.log1p("price"), 6).alias("log_price"), F.round(F.col("balance") * F.col("balance"), 2).alias("balance_squared"),
        F.when(F.col("price") < 100000, "small").when(F.col("price") < 300000, "middle").otherwise("large").alias("size"),
        F.col("priority").startswith("1").cast("int").alias("urgent"),
        F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 0).alias("status_code"), F.col("nation").alias("country"))


@query("typing_applied_to_other_rows", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_totalprice END AS price,
 CASE WHEN o_orderkey % 5 = 0 THEN -9.0 ELSE o_custkey % 40 END::DOUBLE AS visits, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS code FROM orders WHERE o_orderkey % 4 = 0""")
def _(spark, sf):
    """Codes and placeholders are decided on three quarters of the rows; a code that only the others hold stays a number."""
    key, kept = F.col("o_orderkey"), F.col("o_orderkey") % 4 != 0
    raw = read(spark, sf, "orders").select(
        key.alias("row_id"), F.when(key % 7 == 1, -999.0).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(~kept & (key % 5 == 0), -9).otherwise(F.col("o_custkey") % 40).alias("visits"),
        F.when(key % 3 == 0, "n/a").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(~kept & (key % 11 == 0), "not a number").otherwise(F.col("o_custkey").cast("string")).alias("code"))
    return prepare(raw.filter("row_id % 4 <> 0"), "row_id").apply(raw.filter("row_id % 4 = 0"))
