import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segflow.functions import samples
from segflow.operators import cohort, curves, evaluate, forms, ids, items, joins, models, norms, profile, quality, quantiles, reshape, sessions
from segflow.plans.cohort import class_rates
from segflow.sources import files
from segflow.streaming.segments import windowed_class_summary


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_class_rates(spark):
    segs = spark.createDataFrame([("P2", "adult_female", 1.0), ("P2", "key_child", 1.0)], "id string, label string, dur double")
    hours = spark.createDataFrame([("P1", None), ("P2", 2.0)], "id string, hours double")
    found = {r["id"]: r for r in class_rates(segs, hours, "id", "label", "dur", ["adult_female", "adult_male", "key_child"]).collect()}
    assert found["P1"]["adult_female_count"] is None and found["P1"]["key_child_count_hour"] is None
    assert found["P2"]["adult_female_count_hour"] == 0.5 and found["P2"]["key_child_duration_hour"] == 0.5 and found["P2"]["adult_male_count"] == 0.0


def test_ids(spark):
    df = spark.createDataFrame([(" BBB ",), ("AAA",), ("BBB",), ("CCC",), (None,)], "par_id string")
    assert rows(ids.dense_ids(df, "par_id"), "par_id", "anon_id") == [("AAA", "P001"), ("BBB", "P002"), ("CCC", "P003")]
    seen = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", None)], "k string, t int")
    assert rows(ids.first_seen_ids(seen, "k", ["t"]), "participant_id", "k") == [("P000001", "b"), ("P000002", "a"), ("P000003", "c")]


def test_sessions(spark):
    made = [("P1", "20250201", 1.0), ("P1", "20250201", 2.0), ("P1", "20250202", 5.0), ("P2", "session_a", 1.5), ("P2", "session_b", 2.5)]
    df = spark.createDataFrame(made, "p string, s string, d double")
    assert sessions.earliest_session(df, "p", "s").count() == 4
    audit = {r["p"]: r for r in sessions.session_audit(df, "p", "s", "d").collect()}
    assert (audit["P1"]["selected_session"], audit["P1"]["n_files"], audit["P1"]["total_sec"], audit["P1"]["ignored_sessions"]) == ("20250201", 2, 3.0, "20250202")
    assert (audit["P2"]["n_files"], audit["P2"]["total_sec"]) == (2, 4.0)
    candidates = spark.createDataFrame([("p", "a", 3), ("p", "b", 6), ("q", "c", 1)], "p string, path string, size int")
    assert rows(sessions.pick_one_file(candidates, "p"), "p", "path", "n_candidates") == [("p", "b", 2), ("q", "c", 1)]


def test_evaluation(spark):
    df = spark.createDataFrame([("adult_female", "adult_female"), ("adult_male", "adult_female"), (None, "x"), (" ", "x")], "t string, p string")
    labels = ["adult_female", "adult_male", "key_child"]
    assert evaluate.accuracy(df, "t", "p").first().asDict() == {"n_rows": 4, "accuracy": 0.5}
    found = {r["label"]: r for r in evaluate.classwise_metrics(evaluate.confusion_matrix(df, "t", "p", labels)).collect()}
    assert (found["adult_female"]["precision"], found["adult_female"]["recall"]) == (0.5, 1.0)
    assert found["key_child"]["f1"] == 0.0 and found["key_child"]["tn"] == 2


def test_sample_is_stable(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    a, b = (rows(evaluate.sample_n(df, ["g"], 5, 42, ["id"]), "id") for _ in range(2))
    assert a == b and len(a) == 10


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    good = spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.join_validated(left, good, ["k"]).count() == 3
    with pytest.raises(quality.ContractError):
        joins.join_validated(left, good.union(good), ["k"])
    linked = joins.link_chain(left, [(good, "k", "k", "good")])
    assert rows(linked.where("k IS NOT NULL"), "k", "has_good_link") == [(1, True), (2, False)]


def test_forms(spark):
    df = spark.createDataFrame([("k", "c2", 2, "", "b"), ("k", "c1", 1, "m", None), ("k", "c1", 3, "n", "a")], "key string, id string, t int, mobile string, email string")
    found = forms.contact_rollup(df, "key", "id", "t", "mobile", "email").first()
    assert (found["n_contact_rows"], found["first_contact_id"], found["mobile"], found["email"], found["contact_ids"]) == (3, "c1", "m", "b", "c1 | c2")
    assert forms.conflict_flags(df, "key", "mobile", "email").first()["many_mobiles"]
    assert forms.duplicate_counts(df, ["id"]).first()["n"] == 2


def test_criteria_and_reasons(spark):
    columns = {"consent": "c", "linked": "l", "mother_tongue": "m", "exposure_ok": "l", "exposure_unknown": "u", "exposure_invalid": "u", "preterm": "p", "impairment": "p", "age_answer": "c", "age_valid": "l", "age_form_match": "f"}
    made = [("हाँ", True, "yes", False, None, True), (None, True, "no", None, "no", True), ("Yes", True, "हां", False, "no", False), ("yes", True, "yes", False, "yes", True)]
    found = forms.reasons(forms.criteria(spark.createDataFrame(made, "c string, l boolean, m string, u boolean, p string, f boolean"), columns)).collect()
    assert [r["included_final"] for r in found] == [True, False, False, False]
    assert [r["all_reasons"] for r in found] == ["", "no_consent; failed_eligibility", "age_form_mismatch", "failed_eligibility"]
    assert found[1]["primary_reason"] == "no_consent"


def test_exclusions_are_grouped(spark):
    df = spark.createDataFrame([("age_form_mismatch", "CDI-I"), ("age_outside_form_range", "CDI-II"), ("no_consent", "CDI-I"), ("hindi_exposure_invalid", "CDI-I"), ("", "CDI-I")], "primary_reason string, form string")
    found = {r["exclusion"]: (r["CDI-I"], r["CDI-II"], r["total"]) for r in forms.exclusion_table(df, "form", ["CDI-I", "CDI-II"]).collect()}
    assert found["Age outside form range"] == (1, 1, 2) and found["No consent"] == (1, 0, 1) and sum(n for _, _, n in found.values()) == 3 and len(found) == 7


def test_evidence(spark):
    rows = [("strong", 3.0, 1.0), ("moderate", 2.2, 1.0), ("weak", 1.0, 1.0), ("against", -3.0, 1.0), ("against", 3.0, 1.0), ("open", -1.0, 1.0)]
    effects = spark.createDataFrame([(k, e, s, e - 1.96 * s, e + 1.96 * s) for k, e, s in rows], "k string, estimate double, se double, low double, high double")
    said = {r["k"]: r["category"] for r in models.evidence(effects, "k").collect()}
    assert said == {"strong": "Strong evidence supporting the hypothesis", "moderate": "Moderate evidence supporting the hypothesis", "weak": "Weak evidence supporting the hypothesis", "against": "Evidence inconsistent with the hypothesis", "open": "Inconclusive evidence"}


def test_gvif_of_aliased_columns():
    r = {(a, b): 1.0 if a == b or {a, b} == {"x", "z"} else 0.5 for a in "xyz" for b in "xyz"}
    found = {t: (v, flag) for t, v, _, flag in models.gvif(r, {"x": ["x"], "y": ["y"], "z": ["z"]})}
    assert found["z"][1] and not found["x"][1] and abs(found["x"][0] - 1 / 0.75) < 1e-9 and abs(found["y"][0] - 1 / 0.75) < 1e-9


def test_items_and_norms(spark):
    long = spark.createDataFrame([("a", i, "x" if i <= 2 else "") for i in range(1, 5)] + [("b", 1, "x")], "id string, pos int, r string")
    found = {r["id"]: (r["trailing_blank_run"], r["status"]) for r in items.completeness(long, ["id"], "pos", "r", 4, 1).collect()}
    assert found == {"a": (2, "trailing_blank_block"), "b": (None, "missing_item_columns")}
    df = spark.createDataFrame([(8, 1.0), (8, 2.0), (8, 4.0)], "age int, y double")
    table = {r["age"]: r for r in norms.norm_table(df, "age", "y", 8, 9).collect()}
    assert table[8]["p50"] == 2.0 and table[8]["n"] == 3 and table[9]["n"] == 0 and table[9]["mean"] is None


def test_curves(spark):
    made = [(float(m), 3.0 * m + (i % 3)) for m in range(8, 30) for i in range(6)]
    df = spark.createDataFrame(made, "age double, y double")
    mean = curves.mean_curves(df, "age", "y", [10.0, 20.0], 1000.0).orderBy("age").toPandas()
    assert np.allclose(mean["predicted"], [31.0, 61.0], atol=0.2) and (mean["r2"] > 0.99).all()
    quant = curves.quantile_curves(df, "age", "y", [10.0, 20.0], 1000.0, (0.1, 0.5, 0.9)).toPandas()
    wide = quant.pivot(index="age", columns="quantile", values="predicted")
    assert (wide.diff(axis=1).iloc[:, 1:] >= 0).all().all() and abs(wide.loc[10.0, 0.5] - 31) < 0.5
    few = curves.mean_curves(df.limit(3), "age", "y", [10.0], 1000.0)
    assert few.first()["method"] == "median"


def test_linear_and_mixed_models(spark):
    draw = np.random.default_rng(3)
    shift = draw.normal(0, 2, 40)
    made = [(g, float(x), float(1 + 2 * x + shift[g] + draw.normal(0, 0.5))) for g in range(40) for x in draw.uniform(0, 5, 12)]
    df = spark.createDataFrame(made, "g int, x double, y double")
    fixed = {r["term"]: r["estimate"] for r in models.fit_linear(df, ["x"], "y").collect()}
    slope, intercept = np.polyfit([m[1] for m in made], [m[2] for m in made], 1)
    assert np.isclose(fixed["x"], slope) and np.isclose(fixed["(intercept)"], intercept)
    mixed = models.fit_random_intercept(df, ["x"], "y", "g").where("term = 'x'").first()
    assert abs(mixed["estimate"] - 2) < 0.05 and abs(mixed["sigma2"] - 0.25) < 0.06 and 2 < mixed["tau2"] < 7
    bounds = models.bootstrap_ci(df, ["x"], "y", "g", [{"x": 1.0}], nsim=300, seed=5).first()
    assert bounds["low"] < bounds["fit"] < bounds["high"]
    wide = 2 * 1.96 * (mixed["tau2"] / 40) ** 0.5
    assert 0.8 * wide < bounds["high"] - bounds["low"] < 1.25 * wide
    other = models.bootstrap_ci(df.repartition(3, "x"), ["x"], "y", "g", [{"x": 1.0}], nsim=300, seed=5).first()
    assert np.allclose([*bounds], [*other])


def dense_likelihood(made: list[tuple], ratio: float) -> tuple[float, np.ndarray, float]:
    """(log-likelihood, beta, sigma2) from the whole covariance matrix of the rows."""
    g, x, y = (np.array(v, float) for v in zip(*made))
    v = np.eye(len(g)) + ratio * (g[:, None] == g[None])
    design, w = np.stack([np.ones(len(x)), x], 1), np.linalg.inv(v)
    beta = np.linalg.solve(design.T @ w @ design, design.T @ w @ y)
    left = y - design @ beta
    sigma2 = left @ w @ left / len(g)
    return -0.5 * (len(g) * (np.log(2 * np.pi * sigma2) + 1) + np.linalg.slogdet(v)[1]), beta, sigma2


def test_random_intercept_equals_brute_force(spark):
    draw = np.random.default_rng(8)
    made = [(g, float(x), float(3 - x + draw.normal(0, 1) + (g % 3) * 1.5)) for g in range(12) for x in draw.uniform(0, 4, 1 + g % 4)]
    df = spark.createDataFrame(made, "g int, x double, y double")
    found = {r["term"]: r for r in models.fit_random_intercept(df, ["x"], "y", "g").collect()}
    got = found["x"]
    loglik, beta, sigma2 = dense_likelihood(made, got["tau2"] / got["sigma2"])
    assert np.allclose([got["loglik"], got["sigma2"], got["estimate"], found["(intercept)"]["estimate"]], [loglik, sigma2, beta[1], beta[0]])
    assert loglik >= max(dense_likelihood(made, r)[0] for r in np.exp(np.linspace(-12, 6, 400))) - 1e-9
    flat = models.fit_random_intercept(spark.createDataFrame([(i, float(x), 2.0 * x + (-1) ** x) for i in range(4) for x in range(4)], "g int, x double, y double"), ["x"], "y", "g").first()
    assert flat["tau2"] == 0
    assert models.fit_random_intercept(df.limit(0), ["x"], "y", "g").first()["n"] == 0


def test_tails():
    assert abs(models.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(models.chi2_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert np.allclose(models.normal_quantile(np.array([0.025, 0.5])), [-1.959963984540054, 0.0], atol=1e-9)


@pytest.mark.parametrize("accuracy", [100, 100_000])
def test_exact_quantiles_equal_percentiles(spark, accuracy):
    draw = np.random.default_rng(4)
    made = [(("a", "b", None)[min(i % 7, 2)], None if i % 11 == 0 else float(draw.normal()), float(draw.integers(0, 4))) for i in range(5000)] + [("empty", None, 1.0)]
    df = spark.createDataFrame(made, "g string, x double, `y z` double").repartition(7)
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    for by in ([], ["g"]):
        got = {(*(r[b] for b in by), r["variable"]): (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, by, ["x", "y z"], shares, accuracy).collect()}
        frame = pd.DataFrame(made, columns=["g", "x", "y z"])
        groups = [((), frame)] if not by else [((g,), part) for g, part in frame.assign(g=frame["g"].fillna("none")).groupby("g")]
        expected = {(*(None if k == "none" else k for k in key), c): part[c].dropna() for key, part in groups for c in ("x", "y z") if part[c].notna().any()}
        assert got.keys() == expected.keys()
        for key, values in expected.items():
            assert got[key][0] == len(values) and np.allclose(got[key][1], np.quantile(values, shares))
    assert quantiles.exact_quantiles(df.limit(0), [], ["x"], shares).count() == 0
    assert profile.numeric_summary(df.where("g = 'empty'"), ["x"]).first()["median"] is None
    assert {r["metric"]: r["value"] for r in profile.duration_profile(df.limit(0), "x", [1.0]).collect()}["p50"] is None


def test_profile(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    found = {r["variable"]: r for r in profile.numeric_summary(df, ["a", "b"]).collect()}
    assert found["a"]["non_missing"] == 2 and found["a"]["std"] == 0.5 and found["b"]["median"] == 2.0
    assert {r["variable"]: r["missing"] for r in profile.missing_summary(df).collect()} == {"a": 1, "b": 0}
    assert {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b"]).collect()}["a", "b"] == pytest.approx(1.0)


def test_quality(spark):
    df = spark.createDataFrame([("P1", "seen SECRET123 here"), ("P2", "none")], "participant_id string, note string")
    secrets = spark.createDataFrame([("SECRET123",)], "s string")
    assert quality.leak_scan(df, secrets, "s").collect()[0]["column"] == "note"
    with pytest.raises(quality.ContractError):
        quality.assert_public(df, "participant_id", ["note"])
    issues = quality.issue(df, "participant_id", "x", F.lit("m"))
    assert [r["participant_id"] for r in quality.validation_report(issues).collect()] == ["P1", "P2"]


def test_zscore(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (-5.0,), (None,)], "x double")
    assert rows(cohort.zscore(df, "x").where("x IS NOT NULL"), "x", "x_z") == [(-5.0, -7.0), (1.0, -1.0), (3.0, 1.0)]
    assert rows(cohort.zscore(df.limit(1), "x"), "x_z") == [(0.0,)]


def test_samples(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.25],)], "s array<float>")
    got = df.select(samples.peak(F.col("s")).alias("p"), samples.crop_or_pad(F.col("s"), 4).alias("c"), samples.slice_samples(F.col("s"), 10, F.lit(0.1), F.lit(9.0)).alias("x")).first()
    assert got["p"] == 1.0 and got["c"] == [0.5, -1.0, 0.25, 0.0] and got["x"] == [-1.0, 0.25]


def test_scan_recordings(spark, tmp_path):
    for name, seconds in (("P1/20250201/a.wav", 1), ("P1/20250201/b.WAV", 2)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(files.wave_bytes(b"\0\0" * 8000 * seconds, 8000))
    (tmp_path / "P1/20250201/bad.wav").write_bytes(b"nothing")
    made = files.wave_bytes(b"\0\0" * 4000, 8000)
    (tmp_path / "P1/20250201/cut.wav").write_bytes(made[:20])
    (tmp_path / "P1/20250201/long.wav").write_bytes(made[:12] + (b"LIST" + (9001).to_bytes(4, "little") + b"x" * 9002) * 3 + made[12:])
    good, bad = files.scan_recordings(spark, str(tmp_path))
    assert rows(good, "recording_id", "participant_id", "session_date", "duration_sec") == [("a", "P1", "20250201", 1.0), ("b", "P1", "20250201", 2.0), ("long", "P1", "20250201", 0.5)]
    assert bad.count() == 2 and files.scan_recordings(spark, str(tmp_path), case_sensitive=True)[0].count() == 2


def test_segment_sources(spark, tmp_path):
    (tmp_path / "P9").mkdir()
    (tmp_path / "P9" / "rttm.csv").write_text("uid,start_time_s,duration_s,label\nA,0.0,0.5,FEM\nA,1.0,-1,KCHI\nA,2.0,1,NOISE\n")
    found = files.read_segments(spark, f"{tmp_path}/*/rttm.csv", "vtc")
    assert rows(found, "participant_id", "start_sec", "end_sec", "label") == [("P9", 0.0, 0.5, "adult_female"), ("P9", 2.0, 3.0, "noise")]
    df = spark.createDataFrame([("FEM ", "1.0", "2.5")], "Speaker string, start string, end string")
    names = {"uid": ["uid"], "label": ["label", "speaker"], "start": ["start_time_s", "start"], "end": ["end"], "duration": ["duration_s"]}
    assert tuple(files.resolve_columns(df, names).select("label", "start", "duration").first()) == ("FEM", 1.0, 1.5)
    with pytest.raises(quality.ContractError, match="duration_s"):
        files.resolve_columns(df.select("Speaker"), names)


def test_delimited_strings(spark, tmp_path):
    (tmp_path / "f.txt").write_text("﻿a;b  c;a\n1;2;3\n")
    got = files.read_delimited_strings(spark, str(tmp_path / "f.txt"))
    assert got.columns == ["a", "b c", "a.1"] and tuple(got.first()) == ("1", "2", "3")


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "r", "x", 2.0), ("2024-01-01 00:02:00", "r", "x", 3.0)], "ts string, rec string, label string, dur double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windowed_class_summary(stream, "ts", ["rec"], "label", "dur").writeStream.outputMode("complete").format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "ck")).start()
    out.processAllAvailable()
    out.stop()
    assert rows(spark.table("summary"), "count", "duration_sec") == rows(windowed_class_summary(df, "ts", ["rec"], "label", "dur"), "count", "duration_sec") == [(2, 5.0)]


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    assert reshape.to_long_items(df, ["id"], ["a", "b"]).count() == 2
    assert reshape.select_available(df, ["b", "zz", "id"]).columns == ["b", "id"]
    assert reshape.complete_cases(df, ["a", "b"]).count() == 0


def test_leaks_inside_longer_tokens(spark):
    import random

    rng = random.Random(4)
    ids = [f"PART-2020-{i:04d}" for i in range(40)] + ["k7", "9", "", None, "ünï", "  ", "PART 2020 k", "PART-2020-0001"]
    noise = lambda: "".join(rng.choice("PART-2020k79ünï ") for _ in range(rng.randrange(60)))
    rows = [(noise() + rng.choice([*(i or "" for i in ids), "", ""]) + noise(), rng.choice([None, "x" + (ids[3] or ""), noise()]), i) for i in range(120)]
    rows += [(rows[0][0], rows[0][1], 1), (None, "", 2), ("y" * 20_000 + ids[7] + "z" * 20_000, None, 3)]
    public = spark.createDataFrame(rows, "note string, other string, n int")
    found = {r["column"]: r["n"] for r in quality.leak_scan(public, spark.createDataFrame([(i,) for i in ids], "id string"), "id").collect()}
    known = {i for i in ids if i and i.strip()}
    assert found == {c: sum(i in (r[k] or "") for r in rows for i in known) for k, c in enumerate(("note", "other"))}
    plan = quality.leak_scan(public, spark.createDataFrame([("abc",)], "id string"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert quality.leak_scan(public, spark.createDataFrame([], "id string"), "id").count() == 0 and quality.leak_scan(public.select("n"), public.select("note"), "note").count() == 0


def test_shared_prefixes_are_no_anchors(spark):
    ids = spark.createDataFrame([(f"STUDY-PARTICIPANT-{i:05d}",) for i in range(500)], "id string")
    shared = quality.anchors(ids, "id").groupBy("gram").count().agg({"count": "max"}).first()[0]
    assert shared <= 2


def test_leak_scan_broadcasts_nothing(spark, tmp_path):
    """A small file of texts that pack well is not taken for a small table."""
    spark.createDataFrame([(f"word id-{i % 7}-secret " * 50,) for i in range(2000)], "text string").write.parquet(str(tmp_path / "texts"))
    public, ids = spark.read.parquet(str(tmp_path / "texts")), spark.createDataFrame([(f"id-{i}-secret",) for i in range(9)], "id string")
    found = quality.leak_scan(public, ids, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("text", 2000)]
    assert "Broadcast" not in plan and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_exact_quantiles_are_ranked_in_ranges(spark):
    """A hundred shares over groups with ties, nulls and a null group; no sketch is taken and no window holds a whole group."""
    draw = np.random.default_rng(5)
    made = [((("a", "b", None)[min(i % 7, 2)]), None if i % 11 == 0 else float(draw.choice([draw.normal(), draw.integers(-2, 3), -0.0]))) for i in range(4000)]
    df = spark.createDataFrame(made, "g string, x double").repartition(5)
    shares = tuple((i + 0.5) / 100 for i in range(100)) + (0.0, 1.0)
    for by in ([], ["g"]):
        found = quantiles.exact_quantiles(df, by, ["x"], shares, 500)
        assert "approx" not in found._jdf.queryExecution().optimizedPlan().toString()
        for r in found.collect():
            values = [x for g, x in made if x is not None and (not by or g == r["g"])]
            assert r["n"] == len(values) and np.allclose(r["q"], np.quantile(values, shares))
        assert found.count() == (3 if by else 1)
    assert quantiles.exact_quantiles(df.where("x IS NULL"), ["g"], ["x"], shares, 10).count() == 0


def test_large_groups_are_not_dealt_by_group(spark):
    """Brackets and quartiles of few groups are told to all tasks: a join by group would put each group into one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.range(3000).selectExpr("CAST(id % 2 AS string) AS g", "CAST(id * 7 % 1000 AS double) AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantiles.exact_quantiles(df, ["g"], ["x"], (0.5,), 100)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (found, profile.box_stats(df, "g", "x"))]
        assert all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in plans)
        assert {r["g"]: r["q"][0] for r in found.collect()} == {g: float(np.median([i * 7 % 1000 for i in range(int(g), 3000, 2)])) for g in "01"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
