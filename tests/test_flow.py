"""Audit, repair and injection end to end: every change is logged, the truth log undoes it, like rows follow their rule."""

import random

import numpy as np
from pyspark.sql import functions as F

from sievestone.operators import apply as ap
from sievestone.operators import inject, joint, policy, ranks
from sievestone.operators.knn import like_row_cells
from sievestone.operators.models import auc, least_squares
from sievestone.operators.prepare import prepare
from sievestone.operators.propose import propose_missing
from sievestone.operators.quantiles import quantiles
from sievestone.operators.ranks import rotated
from sievestone.operators.spelling import analyse_spelling
from sievestone.plans.audit import audit, repair
from sievestone.sources import readers, writers


def frame(spark, n=400):
    random.seed(11)
    rows = [(i, float(random.randint(18, 80)), random.gauss(100, 15), random.choice(["red", "green", "blue"]), random.choice(["a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, age double, spend double, colour string, y string")


COLUMNS = ["age", "spend", "colour", "y"]


def test_injected_errors_are_undone_by_their_log(spark):
    clean = frame(spark)
    hurt = inject.inject_all(clean, "row_id", COLUMNS, "y", 0.05, 3)
    back = ap.oracle_repair(hurt.frame, "row_id", hurt.log, COLUMNS)
    assert back.exceptAll(clean).count() == 0 and clean.exceptAll(back).count() == 0
    counts = {r["error_type"]: r["count"] for r in hurt.log.groupBy("error_type").count().collect()}
    assert counts["missing_values"] == 60 and counts["duplicates"] == 20 and counts["label_errors"] == 20 and counts["outliers"] == 20


def test_injection_is_repeatable_and_leaves_the_input_alone(spark):
    clean = frame(spark)
    a = inject.inject_swaps(clean, "row_id", ["age", "colour"], 0.2, 5)
    b = inject.inject_swaps(clean, "row_id", ["age", "colour"], 0.2, 5)
    assert a.frame.exceptAll(b.frame).count() == 0
    values = lambda f: sorted(r[0] for r in f.select("age").collect())
    assert values(a.frame) == values(clean)


def test_every_change_is_in_the_log(spark):
    hurt = inject.inject_all(frame(spark), "row_id", COLUMNS, "y", 0.05, 3).frame
    state = audit(hurt, "row_id", "y", detectors={"missing_values", "duplicates", "outliers", "inconsistency"})
    for issues in (ap.AGGRESSIVE, {"missing_values"}, {"duplicates", "outliers"}):
        out = ap.apply_proposals(state.prepared, state.proposals, issues)
        assert {r["violations"] for r in ap.audit_log(hurt, out, "row_id", COLUMNS).collect()} == {0}
        assert out.log.count() == state.proposals.count()


def test_without_evidence_nothing_is_applied(spark):
    hurt = inject.inject_missing(frame(spark), "row_id", COLUMNS[:3], 0.05, 3).frame
    state = audit(hurt, "row_id", detectors={"missing_values"})
    result = repair(state)
    assert policy.auto_issues(state.policy) == set()
    assert result.cleaned.exceptAll(hurt).count() == 0
    assert result.aggressive.cleaned.filter("age is null or spend is null or colour is null").count() == 0


def test_conflicting_writers_and_dropped_rows(spark):
    proposals = spark.createDataFrame([
        ("inconsistency", 1, "c", "p", "a", "A", None, "m", "strict", None, None), ("missing_values", 1, "c", "p", None, "B", None, "m", "exact", None, None),
        ("outliers", 2, "x", "p", "9", "3", 3.0, "m", "strict", None, None), ("duplicates", 2, None, "p", "copy", "drop row", None, "m", "exact", None, None),
        ("outliers", 3, "x", "p", "9", None, None, "m", "loose", None, None), ("missing_values", 4, "x", "p", "-1", "5", 5.0, "m", "exact", None, "code")],
        "issue_key string, row_id long, column string, problem string, original_value string, proposed_value string, proposed_number double, method string, tier string, detector_score double, read_as string")
    actions = {(r["issue_key"], r["row_id"]): r["action"] for r in ap.decide_actions(
        proposals, {"inconsistency", "missing_values", "outliers", "duplicates"}, hold_codes=True).collect()}
    assert actions == {("inconsistency", 1): "applied", ("missing_values", 1): "skipped_conflict", ("outliers", 2): "skipped_row_dropped",
                       ("duplicates", 2): "applied", ("outliers", 3): "flagged_only", ("missing_values", 4): "flagged_for_review"}


def test_like_rows_match_brute_force(spark):
    names = ["age", "spend", "both"]
    hurt = inject.inject_missing(frame(spark, 400).select("row_id", "age", "spend", (F.col("age") * 2 + F.col("spend")).alias("both")), "row_id", names, 0.1, 2).frame
    data = hurt.orderBy("row_id").toPandas()
    got = {(r["row_id"], r["column"]): r["value"] for r in like_row_cells(hurt, "row_id", names).collect()}
    cuts = {c: np.nanquantile(data[c], [k / 10 for k in range(1, 10)]) for c in names}
    deciles = {c: [0 if np.isnan(v) else 1 + int((cuts[c] < v).sum()) for v in data[c]] for c in names}
    seen = 0
    for c in names:
        others = sorted((o for o in names if o != c), key=lambda o: -round(abs(data[c].corr(data[o])), 6))
        for i in np.flatnonzero(data[c].isna()):
            value = data[c].median()
            for take in (1, 2):
                like = [v for k, v in enumerate(data[c]) if not np.isnan(v) and all(deciles[o][k] == deciles[o][i] for o in others[:take])]
                value = np.mean(like) if len(like) >= 5 else value
            assert abs(got[(int(data.row_id[i]), c)] - value) < 1e-6
            seen += 1
    assert seen == len(got) > 100


def test_one_imputation_rule_at_every_size(spark):
    for rows in (40_000, 40_001):
        df = spark.range(rows).select(F.col("id").alias("row_id"), F.when(F.col("id") % 50 != 0, F.col("id") / 7).alias("a"), (F.col("id") / 3).alias("b"))
        methods = {r["method"] for r in propose_missing(prepare(df, "row_id")).select("method").distinct().collect()}
        assert methods == {"mean of 5 or more rows in the same deciles of up to 3 related columns"}


def test_auc_counts_ties_half(spark):
    random.seed(2)
    rows = [(random.randint(0, 5) / 5, random.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows if y for b, n in rows if not n)
    total = sum(y for _, y in rows) * sum(not y for _, y in rows)
    assert abs(auc(df, F.col("y"), F.col("s")) - wins / total) < 1e-12


def test_least_squares_recovers_a_line(spark):
    rows = [(float(i), float(i % 7), 3.0 + 2.0 * i - 0.5 * (i % 7) + (0.1 if i % 2 else -0.1)) for i in range(200)]
    fit = least_squares(spark.createDataFrame(rows, "a double, b double, y double"), "y", ["a", "b"])
    assert abs(fit["coef"][1] - 2.0) < 1e-3 and abs(fit["coef"][2] + 0.5) < 1e-2 and fit["r2"] > 0.999


def test_normal_scores_draw_once_a_column(spark):
    df = spark.createDataFrame([(i, float(i % 40) if i % 7 else None, float(i % 3)) for i in range(300)], "row_id long, a double, b double")
    scored = joint.normal_scores(df, "row_id", ["a", "b"], 5)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2
    assert scored.columns == ["b", "a", "row_id", "z0", "z1"] and scored.filter("a is null").agg(F.count("z0"), F.count("z1"), F.count("row_id")).first() == (0, 43, 43)
    assert scored.filter("a is not null and not isnan(z0)").count() == 257


def test_joint_outliers_find_swapped_rows(spark):
    random.seed(4)
    rows = []
    for i in range(1500):
        a = random.gauss(0, 1)
        rows.append((i, a, a + random.gauss(0, 0.2), random.gauss(0, 1)))
    rows[7] = (7, 1.5, -1.5, 0.0)
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    found = joint.joint_outliers(df, "row_id", ["a", "b", "c"], set())
    hits = {r["row_id"] for r in found.records.collect()}
    assert 7 in hits and len(hits) < 40


def test_readers(spark, tmp_path):
    text = "name;price;qty\nJosé;3,5;1\nAnna;4,25;2\n"
    (tmp_path / "euro.csv").write_bytes(text.encode("cp1252"))
    df, info = readers.load_table(spark, str(tmp_path / "euro.csv"))
    assert info["delimiter"] == ";" and info["decimal"] == "," and info["encoding"] == "windows-1252"
    assert {r["name"] for r in df.collect()} == {"José", "Anna"}
    (tmp_path / "wrapped.json").write_text('{"data": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}]}')
    wrapped, _ = readers.load_table(spark, str(tmp_path / "wrapped.json"))
    assert wrapped.columns == ["a", "b.c"] and wrapped.count() == 2
    (tmp_path / "columns.json").write_text('{"a": [1, 2, 3], "b": ["x", "y", "z"]}')
    assert readers.load_table(spark, str(tmp_path / "columns.json"))[0].count() == 3
    assert readers.unique_headers(["a", "", "a", " a "]) == ["a", "Unnamed: 1", "a.1", "a.2"]
    (tmp_path / "empty.csv").write_text("")
    try:
        readers.load_table(spark, str(tmp_path / "empty.csv"))
        raise AssertionError("an empty file must be refused")
    except ValueError:
        pass


def test_row_ids_over_many_files(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "many"))
    ids = sorted(r["row_id"] for r in readers.with_row_id(spark.read.parquet(str(tmp_path / "many"))).select("row_id").collect())
    assert ids == list(range(1000))


def test_outputs_are_written(spark, tmp_path):
    hurt = inject.inject_missing(frame(spark), "row_id", COLUMNS[:3], 0.05, 3).frame
    state = audit(hurt, "row_id", detectors={"missing_values", "duplicates"})
    names = writers.write_outputs(state, repair(state), str(tmp_path))
    assert {"cleaned", "cleaned_aggressive", "repair_log", "policy", "review_worklist"} <= set(names)
    assert spark.read.parquet(str(tmp_path / "cleaned")).count() == 400


def test_csv_late_bytes_and_quoted_breaks(spark, tmp_path):
    rows = ["id|name|note"] + [f"{i}|name {i}|" + "x" * 60 for i in range(3000)]
    (tmp_path / "late.csv").write_bytes("\n".join(rows).encode() + "\n3000|Andr\xe9|caf\xe9 \u20ac".encode("cp1252"))
    df, info = readers.read_csv(spark, str(tmp_path / "late.csv"))
    assert info["encoding"] == "windows-1252" and info["delimiter"] == "|" and not info["multiline"] and df.count() == 3001
    assert df.filter("id = '3000'").first()[1:] == ("Andr\xe9", "caf\xe9 \u20ac")
    (tmp_path / "breaks.csv").write_text('id\ttext\n1\t"two\nlines"\n2\t"a ""b"" c"\n')
    df, info = readers.read_csv(spark, str(tmp_path / "breaks.csv"))
    assert info["multiline"] and [tuple(r) for r in df.orderBy("id").collect()] == [("1", "two\nlines"), ("2", 'a "b" c')]


def test_json_shapes_from_files(spark, tmp_path):
    shapes = {"wrapped": '{"data": [{"a": 1}, {"a": 2}]}', "columns": '{"a": [1, 2], "b": ["x", "y"]}', "records": '[{"a": [1], "b": [2]}, {"a": [3, 4], "b": [5]}]',
              "lines": '{"a": [1], "b": [2]}\n{"a": [3, 4], "b": [5]}', "single": '{"a": 1,\n "b": {"c": 2}}'}
    seen = {}
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
        seen[name] = sorted(tuple(r) for r in readers.read_json(spark, str(tmp_path / f"{name}.json")).collect())
    arrays = [("[1]", "[2]"), ("[3,4]", "[5]")]
    assert seen == {"wrapped": [(1,), (2,)], "columns": [(1, "x"), (2, "y")], "records": arrays, "lines": arrays, "single": [(1, 2)]}


def test_spelling_beyond_hundreds_of_values(spark):
    letters = "bcdfghklmn"
    word = F.concat(*[F.substring(F.lit(letters), (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int"), F.lit(1)) for k in (0, 1, 2)], F.lit("a"),
                    *[F.substring(F.lit(letters), (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int"), F.lit(1)) for k in (2, 1, 0)])
    names = spark.range(1000).select(word.alias("c")).crossJoin(spark.range(30)).select("c")
    slips = spark.createDataFrame([("BBBABBB",), ("cbbabbxc",)], "c string")
    found = analyse_spelling(names.unionByName(slips), ["c"])
    assert found.analysed == ["c"]
    assert {(r["value"], r["rule"]) for r in found.flags.collect()} == {("BBBABBB", "format_variant"), ("cbbabbxc", "possible_typo")}


def test_quantiles_with_infinities(spark):
    values = [float("-inf"), -1e308, 1.0, 2.0, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {"v": (F.col("v"), [0.0, 0.2, 0.5, 0.8, 1.0])}
    small, refined = quantiles(df, wanted)["v"], quantiles(df, wanted, in_task_rows=0)["v"]
    assert small == refined == [float("-inf"), -1e308, 1.5, 1e308, float("inf")]


def test_rotation_is_one_cycle(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
    rows = df.orderBy("g", "h").collect()
    expected = {}
    for g in (0, 1):
        own = [r for r in rows if r["g"] == g]
        expected |= {r["id"]: own[(i + 1) % len(own)]["v"] for i, r in enumerate(own)}
    assert {r["id"]: r["n"] for r in rotated(df, ["g"], "h", "v", "n").collect()} == expected


def test_cuts_count_without_sorting(spark, monkeypatch):
    plans = []
    frame = type(spark.range(1))
    collect = frame.collect

    def noted(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    hashed = spark.range(5000).select(F.lit("all").alias("grp"), F.md5(F.col("id").cast("string")).alias("h"))
    hashes = sorted(r["h"] for r in hashed.collect())
    monkeypatch.setattr(frame, "collect", noted)
    for few in (0, ranks.COLLECT_HASHES):
        monkeypatch.setattr(ranks, "COLLECT_HASHES", few)
        assert ranks.hash_cuts(hashed, {"all": [1, 2500, 5000, 5001]}) == {"all": [hashes[0], hashes[2499], hashes[4999], "g"]}
    assert plans and not any("SortAggregate" in p for p in plans)


def test_combined_errors_are_read_from_written_steps(spark):
    left = spark.range(400).select(F.col("id").alias("row_id"), F.rand(1).alias("a"), F.concat(F.lit("t"), F.col("id") % 5).alias("b"))
    table = left.join(spark.range(400).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("y")), "row_id")
    step = inject.inject_all(table, "row_id", ["a", "b"], "y", 0.1, 3)
    counts = {r["error_type"]: r["count"] for r in step.log.groupBy("error_type").count().collect()}
    assert counts.pop("feature_corruption") <= 80 and counts == {"missing_values": 80, "outliers": 40, "label_errors": 40, "duplicates": 40}
    plan = step.log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the numbers of the copies meet the starts of their prefixes


def test_cells_to_propose_leave_after_the_explode(spark):
    rows = frame(spark).withColumn("spend", F.when(F.col("row_id") % 10 > 0, F.col("spend")))
    for proposals in (propose_missing(prepare(rows, "row_id"), knn=False), audit(rows, "row_id", detectors={"missing_values"}).proposals):
        assert proposals.filter("column = 'spend'").count() == 40
    assert "lambda" not in propose_missing(prepare(rows, "row_id"), knn=False)._jdf.queryExecution().optimizedPlan().toString()


def test_cleaned_rows_are_written_before_they_are_checked(spark, monkeypatch):
    from sievestone.operators import detect
    from sievestone.plans.audit import after_cleaning

    rows = frame(spark)
    joined = rows.join(rows.select(F.col("row_id").alias("other")).filter("other < 300"), F.col("row_id") == F.col("other")).drop("other")
    state, seen, rates = prepare(rows, "row_id"), [], detect.missing_rates
    monkeypatch.setattr(detect, "missing_rates", lambda df, columns: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or rates(df, columns))
    found = {r["issue_key"]: r["rate_after_cleaning"] for r in after_cleaning(joined, state).collect()}
    assert found["missing_values"] == 0 and found["duplicates"] == 0
    assert seen and "Join" not in seen[0]
