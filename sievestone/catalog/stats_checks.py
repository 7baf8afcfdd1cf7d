"""Registered queries: statistics, transforms, encodings, joins and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.catalog import sqltext as q
from sievestone.catalog.register import registry, rounded
from sievestone.catalog.tables import SALES_SQL, read, sales
from sievestone.operators import relational as rel
from sievestone.operators import stats

QUERIES, SQL, query = registry()
NUMS = ["l_quantity", "l_extendedprice", "l_discount"]
PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i:]]


@query("pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def _(spark, sf):
    return rounded(stats.correlation(read(spark, sf, "lineitem"), NUMS), 6)


@query("covariance_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 2) AS cov FROM lineitem" for a, b in PAIRS))
def _(spark, sf):
    return rounded(stats.covariance(read(spark, sf, "lineitem"), NUMS), 2)


RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMS)


@query("spearman_matrix", f"WITH r AS (SELECT {RANKS} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in PAIRS))
def _(spark, sf):
    return rounded(stats.correlation(read(spark, sf, "lineitem"), NUMS, "spearman"), 6)


@query("chi_square_cramers_v", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1),
 k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
 x AS (SELECT sum((coalesce(n, 0) - na * nb / total) * (coalesce(n, 0) - na * nb / total) / (na * nb / total)) AS chi2, any_value(total) AS total FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
 SELECT round(chi2, 4) AS chi2, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) AS dof, total::BIGINT AS n,
 round(sqrt(chi2 / (total * ((SELECT least(count(DISTINCT a), count(DISTINCT b)) FROM c) - 1))), 4) AS cramers_v FROM x""")
def _(spark, sf):
    return rounded(stats.chi_square(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), 4)


@query("welch_test", """WITH g AS (SELECT avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m2,
  var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS v2,
  count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2 FROM lineitem)
 SELECT round(m1, 2) AS m1, round(m2, 2) AS m2, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t,
 round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 2) AS dof,
 round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS cohens_d FROM g""")
def _(spark, sf):
    out = stats.welch(read(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R")
    return rounded(rounded(rounded(out, 2, ["m1", "m2", "dof"]), 4, ["t"]), 6, ["cohens_d"])


@query("mean_confidence_interval", """SELECT round(avg(l_quantity), 4) AS mean, round(avg(l_quantity) - 1.959993 * stddev_samp(l_quantity) / sqrt(count(*)), 3) AS low,
 round(avg(l_quantity) + 1.959993 * stddev_samp(l_quantity) / sqrt(count(*)), 3) AS high, count(*) AS n FROM lineitem""")
def _(spark, sf):
    out = stats.mean_interval(read(spark, sf, "lineitem"), "l_quantity")
    return rounded(rounded(out, 4, ["mean"]), 3, ["low", "high"])


@query("level_tests_bonferroni", """WITH c AS (SELECT o_orderpriority AS level, count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS a FROM orders GROUP BY 1),
 t AS (SELECT sum(n) AS total, sum(a) AS hits FROM c), x AS (SELECT level, n, a, total * power(a * (total - hits - n + a) - (hits - a) * (n - a), 2) / (hits * (total - hits) * n * (total - n)) AS chi2 FROM c, t)
 SELECT level, n::BIGINT AS n, a::BIGINT AS hits, round(chi2, 4) AS chi2, chi2 > 3.841458820694124 AS significant, chi2 > 6.634896601021213 AS significant_corrected FROM x""")
def _(spark, sf):
    return rounded(stats.level_tests(read(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"), 4)


@query("sampled_means", f"""WITH s AS (SELECT row_id, price, size, replicate FROM (SELECT o_orderkey AS row_id, o_totalprice AS price FROM orders), (SELECT unnest([30, 300]) AS size), (SELECT unnest(range(1, 41)) AS replicate)
  WHERE {q.unit(q.md5_of(3, 'row_id', 'size', 'replicate'))} < size / (SELECT count(*) FROM orders)::DOUBLE), m AS (SELECT size, replicate, avg(price) AS m FROM s GROUP BY 1, 2)
 SELECT size, round(avg(m), 2) AS mean_of_means, round(stddev_samp(m), 2) AS observed_spread, count(*) AS samples FROM m GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.replicate_means(read(spark, sf, "orders"), "o_orderkey", "o_totalprice", [30, 300], 40, 3), 2)


@query("biased_sample", """SELECT round(avg(o_totalprice), 2) AS population_mean, round(avg(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%'), 2) AS biased_mean,
 count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS biased_rows FROM orders""")
def _(spark, sf):
    return rounded(stats.biased_sample(read(spark, sf, "orders"), "o_totalprice", F.col("o_orderpriority").startswith("1")), 2)


@query("scalers", """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.25) AS q1,
 quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice_minmax,
 round((o_totalprice - m) / sd, 6) AS o_totalprice_z, round((o_totalprice - q2) / (q3 - q1), 6) AS o_totalprice_robust FROM orders, s""")
def _(spark, sf):
    out = stats.scale(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")
    return rounded(out, 6)


@query("skew_transforms", """SELECT 'value' AS "column", round(skewness(value), 4) AS original, round(skewness(sqrt(value)), 4) AS sqrt, round(skewness(ln(1 + value)), 4) AS log1p FROM events""")
def _(spark, sf):
    return rounded(stats.skew_by_transform(read(spark, sf, "events"), ["value"]).drop("yeo_johnson"), 4)


@query("yeo_johnson_skew")
def _(spark, sf):
    return stats.skew_by_transform(read(spark, sf, "events"), ["value"])


@query("binning", """WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.75) AS q3 FROM part)
 SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS size_band, least(4, floor((p_retailprice - lo) / ((hi - lo) / 5)))::INT AS width_bin,
 ((p_retailprice > q1)::INT + (p_retailprice > q2)::INT + (p_retailprice > q3)::INT) AS frequency_bin FROM part, e""")
def _(spark, sf):
    part = read(spark, sf, "part")
    return part.select("p_partkey", F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large").alias("size_band"),
                       stats.equal_width_bins(part, "p_retailprice", 5).alias("width_bin"), stats.equal_frequency_bins(part, "p_retailprice", 4).alias("frequency_bin"))


@query("encodings", """WITH l AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part GROUP BY 1)
 SELECT p_partkey, (p_type = 'ECONOMY')::INT AS binary_code, code AS label_code, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS ordinal_code,
 (p_type = 'ECONOMY')::INT AS "p_type=ECONOMY", (p_type = 'SMALL')::INT AS "p_type=SMALL" FROM part JOIN l USING (p_brand)""")
def _(spark, sf):
    part = read(spark, sf, "part")
    codes = stats.label_codes(part, "p_brand").select(F.col("value").alias("p_brand"), F.col("code").cast("long").alias("label_code"))
    shaped = part.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_type") == "ECONOMY", 1).otherwise(0).alias("binary_code"),
                         stats.ordinal_code("p_type", ["SMALL", "MEDIUM", "LARGE"]).cast("int").alias("ordinal_code")).join(codes, "p_brand")
    return stats.one_hot(shaped, "p_type", ["ECONOMY", "SMALL"]).drop("p_brand", "p_type")


@query("frequency_encoding", """WITH t AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW'), f AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM t)::DOUBLE AS freq FROM t GROUP BY 1)
 SELECT o_orderkey, round(coalesce(freq, 0), 6) AS freq FROM orders LEFT JOIN f USING (o_orderpriority)""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    train = orders.filter((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderpriority") != "5-LOW"))
    return rounded(stats.frequency_encoding(train, orders, "o_orderpriority", "freq").select("o_orderkey", "freq"), 6)


@query("target_encoding", """WITH t AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW'), g AS (SELECT avg((o_orderstatus = 'F')::INT::DOUBLE) AS rate FROM t),
 f AS (SELECT o_orderpriority, (sum((o_orderstatus = 'F')::INT) + 20 * any_value(rate)) / (count(*) + 20) AS enc FROM t, g GROUP BY 1)
 SELECT o_orderkey, round(coalesce(enc, rate), 6) AS enc FROM orders CROSS JOIN g LEFT JOIN f USING (o_orderpriority)""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    train = orders.filter((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderpriority") != "5-LOW"))
    return rounded(stats.target_encoding(train, orders, "o_orderpriority", F.col("o_orderstatus") == "F", "enc").select("o_orderkey", "enc"), 6)


@query("ordered_category_summary", """WITH c AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS code, o_orderpriority FROM orders),
 s AS (SELECT *, row_number() OVER (ORDER BY code) - 1 AS i, count(*) OVER () AS n FROM c WHERE code IS NOT NULL)
 SELECT min_by(o_orderpriority, code) AS lowest, max_by(o_orderpriority, code) AS highest, (SELECT o_orderpriority FROM s WHERE i = n // 2) AS median_level,
 round(avg((code >= 3)::INT), 6) AS share_at_least FROM s""")
def _(spark, sf):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return rounded(stats.ordered_summary(read(spark, sf, "orders"), "o_orderpriority", order, "2-HIGH"), 6)


@query("chance_macro_f1", """WITH c AS (SELECT quality, count(*)::DOUBLE AS n FROM labels GROUP BY 1), p AS (SELECT max(n) / sum(n) AS p, count(*) AS k FROM c) SELECT round(2 * p / (1 + p) / k, 6) AS chance_macro_f1 FROM p""")
def _(spark, sf):
    return rounded(stats.chance_macro_f1(read(spark, sf, "labels"), "quality"), 6)


@query("banded_robust_z", """WITH r AS (SELECT p_partkey AS row_id, p_retailprice - 900 - p_size * 2 AS res, p_retailprice AS by_ FROM part), e AS (SELECT quantile_cont(by_, 0.2) AS e1, quantile_cont(by_, 0.4) AS e2,
  quantile_cont(by_, 0.6) AS e3, quantile_cont(by_, 0.8) AS e4 FROM r), b AS (SELECT row_id, res, (by_ > e1)::INT + (by_ > e2)::INT + (by_ > e3)::INT + (by_ > e4)::INT AS band FROM r, e),
 m AS (SELECT band, quantile_cont(res, 0.5) AS med, stddev_pop(res) AS sd FROM b GROUP BY 1), g AS (SELECT row_id, band, abs(res - med) AS gap, sd FROM b JOIN m USING (band)),
 s AS (SELECT band, quantile_cont(gap, 0.5) * 1.4826 AS mad, any_value(sd) AS sd FROM g GROUP BY 1)
 SELECT row_id, band, round(CASE WHEN mad > 0 THEN gap / mad WHEN s.sd > 0 THEN gap / s.sd ELSE 0 END, 5) AS z FROM g JOIN s USING (band)""")
def _(spark, sf):
    frame = read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_retailprice") - 900 - F.col("p_size") * 2).alias("res"), F.col("p_retailprice").alias("by"))
    return rounded(stats.banded_robust_z(frame, "row_id", "res", "by"), 5)


# --- joins and grouping ------------------------------------------------------------------------------------------
@query("join_kinds", """SELECT (SELECT count(*) FROM documents d JOIN labels l USING (doc_id)) AS inner_rows, (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id)) AS left_rows,
 (SELECT count(*) FROM documents d RIGHT JOIN labels l USING (doc_id)) AS right_rows, (SELECT count(*) FROM documents d FULL JOIN labels l USING (doc_id)) AS outer_rows""")
def _(spark, sf):
    return rel.join_sizes(read(spark, sf, "documents"), read(spark, sf, "labels"), ["doc_id"])


@query("checked_many_to_one_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, sf):
    customer = read(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = rel.checked_join(read(spark, sf, "orders"), customer, ["o_custkey"], "inner", "many_to_one")
    nation = read(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return rel.checked_join(joined, nation, ["c_nationkey"], "left", "many_to_one").select("o_orderkey", "c_mktsegment", "n_name")


@query("join_indicator", """SELECT CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'both' WHEN d.doc_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge_side, count(*) AS n
 FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(spark, sf):
    docs = read(spark, sf, "documents").filter(F.col("doc_id") % 3 != 0).select("doc_id")
    return rel.join_indicator(docs, read(spark, sf, "labels"), ["doc_id"]).groupBy("merge_side").agg(F.count(F.lit(1)).alias("n"))


@query("aggregate_joined_back", """SELECT o_orderkey, round(o_totalprice - m, 2) AS above_mean FROM orders JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1) USING (o_orderpriority)""")
def _(spark, sf):
    return rounded(rel.group_deviation(read(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "above_mean").select("o_orderkey", "above_mean"), 2)


@query("semi_and_anti_join", """SELECT 'labelled' AS side, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents SEMI JOIN labels USING (doc_id) UNION ALL
 SELECT 'unlabelled', count(*), sum(n_chars)::BIGINT FROM documents ANTI JOIN labels USING (doc_id)""")
def _(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    sized = lambda how, name: docs.join(labels, "doc_id", how).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(name).alias("side"), "*")
    return sized("left_semi", "labelled").unionByName(sized("left_anti", "unlabelled"))


@query("named_aggregation", """SELECT l_returnflag, l_linestatus, count(*) AS items, round(avg(l_quantity), 4) AS mean_quantity, round(avg((l_discount > 0.05)::INT), 6) AS discounted FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"),
        F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("discounted"))


@query("keep_large_groups", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 15)""")
def _(spark, sf):
    return rel.keep_large_groups(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 15)


@query("pivot_table", """SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) AS F, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return rounded(read(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity")), 4)


@query("crosstab_shares", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)::DOUBLE, 6) AS row_share FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(rel.crosstab_share(read(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"), 6)


@query("value_shares", """SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM events GROUP BY 1""")
def _(spark, sf):
    events = read(spark, sf, "events")
    total = events.count()
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.lit(total), 6).alias("share"))


@query("group_mean_with_error", """SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(value)), 4) AS standard_error FROM events GROUP BY 1""")
def _(spark, sf):
    return rounded(rel.mean_with_error(read(spark, sf, "events"), "event_type", "value"), 4)


MONTHS = "SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INT AS month, count(*) AS n, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1"


def months(spark, sf):
    return read(spark, sf, "lineitem").groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity"))


@query("moving_average", f"""WITH m AS ({MONTHS}) SELECT month, CASE WHEN count(*) OVER w >= 3 THEN round(avg(mean_quantity) OVER w, 6) END AS smoothed FROM m
 WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, sf):
    return rounded(rel.moving_average(months(spark, sf), "month", "mean_quantity", 5, 3).select("month", "smoothed"), 6)


@query("suppressed_dense_axis", """WITH m AS (SELECT p_size AS size, count(*) AS n, avg(p_retailprice) AS price FROM part WHERE p_size % 5 <> 0 GROUP BY 1), r AS (SELECT unnest(range((SELECT min(size) FROM m), (SELECT max(size) + 1 FROM m)))::INT AS size)
 SELECT size, n, CASE WHEN n >= 40 THEN round(price, 4) END AS price FROM r LEFT JOIN m USING (size)""")
def _(spark, sf):
    points = read(spark, sf, "part").filter(F.col("p_size") % 5 != 0).groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price"))
    return rounded(rel.dense_axis(points, "size", "price", "n", 40), 4)


@query("grid_interpolation", """WITH m AS (SELECT p_size AS size, avg(p_retailprice) AS price FROM part WHERE p_size % 5 <> 0 GROUP BY 1), r AS (SELECT unnest(range((SELECT min(size) FROM m), (SELECT max(size) + 1 FROM m)))::INT AS size),
 j AS (SELECT size, price FROM r LEFT JOIN m USING (size)) SELECT a.size, round(coalesce(a.price, (SELECT l.price + (h.price - l.price) * (a.size - l.size) / (h.size - l.size) FROM j l, j h WHERE l.price IS NOT NULL AND h.price IS NOT NULL AND l.size < a.size
 AND h.size > a.size ORDER BY l.size DESC, h.size LIMIT 1)), 4) AS filled FROM j a""")
def _(spark, sf):
    points = read(spark, sf, "part").filter(F.col("p_size") % 5 != 0).groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price"))
    return rounded(rel.interpolate(rel.dense_axis(points, "size", "price", "n", 0), "size", "price").select("size", "filled"), 4)


@query("average_ranks", """SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE AS mean_rank FROM orders""")
def _(spark, sf):
    return stats.attach_ranks(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "mean_rank").select("o_orderkey", "mean_rank")


@query("multi_key_sort_top", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def _(spark, sf):
    return read(spark, sf, "lineitem").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").limit(10)


@query("top_k_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def _(spark, sf):
    return rel.top_k_per_group(read(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority",
                               [F.desc("o_totalprice"), F.col("o_orderkey")], 3, F.col("o_orderkey"))


@query("first_row_per_key", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("strongest_row_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(spark, sf):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"), "o_orderkey"))
    return read(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("tagged_stack", "SELECT part, count(*) AS n, count(c_name) AS customers, count(s_name) AS suppliers FROM (SELECT 'customer' AS part, c_name, NULL AS s_name FROM customer UNION ALL SELECT 'supplier', NULL, s_name FROM supplier) GROUP BY 1")
def _(spark, sf):
    stacked = rel.tagged_stack({"customer": read(spark, sf, "customer").select("c_name"), "supplier": read(spark, sf, "supplier").select("s_name")})
    return stacked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("c_name").alias("customers"), F.count("s_name").alias("suppliers"))


@query("key_set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only_documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def _(spark, sf):
    docs, labels = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id")
    count = lambda frame, kind: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(docs.intersect(labels), "both").unionByName(count(docs.subtract(labels), "only_documents"))


@query("distinct_rows", "SELECT DISTINCT lang, source FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("lang", "source").dropDuplicates()


@query("explore_confirm_halves", f"""WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY {q.md5_of(9, 'o_orderkey')}) AS rn, count(*) OVER () AS n FROM orders)
 SELECT CASE WHEN rn <= n // 2 THEN 'explore' ELSE 'confirm' END AS half, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM r GROUP BY 1, 2""")
def _(spark, sf):
    halves = rel.halves(read(spark, sf, "orders"), "o_orderkey", 9)
    return rounded(halves.groupBy("half", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")), 2)


@query("four_summary_questions", f"""WITH {SALES_SQL} SELECT 'mean price by status' AS question, status AS key, round(avg(price), 2) AS answer FROM sales GROUP BY 2 UNION ALL
 SELECT 'orders by segment', segment, count(*) FROM sales GROUP BY 2 UNION ALL SELECT 'mean balance by priority', priority, round(avg(balance), 2) FROM sales GROUP BY 2 UNION ALL
 SELECT 'share finished by segment', segment, round(avg((status = 'F')::INT), 6) FROM sales GROUP BY 2""")
def _(spark, sf):
    frame = sales(spark, sf)
    ask = lambda name, key, answer: frame.groupBy(F.col(key).alias("key")).agg(answer.cast("double").alias("answer")).select(F.lit(name).alias("question"), "key", "answer")
    return (ask("mean price by status", "status", F.round(F.avg("price"), 2)).unionByName(ask("orders by segment", "segment", F.count(F.lit(1))))
            .unionByName(ask("mean balance by priority", "priority", F.round(F.avg("balance"), 2)))
            .unionByName(ask("share finished by segment", "segment", F.round(F.avg((F.col("status") == "F").cast("int")), 6))))
