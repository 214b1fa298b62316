import datetime as dt

from pyspark.sql import functions as F

from segflow.functions import age, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_labels(spark):
    rows = spark.createDataFrame([("FEM",), ("mal",), ("noise",), (None,), ("FEM ",)], "x string")
    assert [r[0] for r in rows.select(text.normalize_vtc_label(F.col("x"))).collect()] == ["adult_female", "adult_male", None, None, "adult_female"]
    assert [r[0] for r in rows.select(text.normalize_label(F.col("x"), "vtc")).collect()] == ["adult_female", "mal", "noise", None, "adult_female"]
    assert [r[0] for r in rows.select(text.normalize_label(F.col("x"), "xgb")).collect()][2] == "background"


def test_parsers(spark):
    assert one(spark, "९", text.parse_completed_months) == 9
    assert one(spark, "1 year", text.parse_completed_months) == 12
    assert one(spark, "12 months", text.parse_completed_months) == 12
    assert one(spark, "1 year 6 months", text.parse_completed_months) == 18
    assert one(spark, "2 yr 3 mo", text.parse_completed_months) == 27
    assert one(spark, "1 Yrs 2 mos", text.parse_completed_months) == 14
    assert one(spark, "लागू नहीं", text.parse_percent) is None
    assert one(spark, " A b@X.org ", text.normalize_email) == "a b@x.org"
    assert one(spark, "10 से 20", text.parse_percent) == 15.0
    assert one(spark, " ", text.parse_percent) is None
    assert one(spark, "NA", text.parse_percent) is None
    assert one(spark, " हाँ ", text.parse_yes_no) is True
    assert one(spark, "No", text.parse_yes_no) is False
    assert one(spark, "?", text.parse_yes_no) is None
    assert one(spark, "session_a", lambda c: text.parse_dates(c)) is None
    assert one(spark, "01/02/2024", lambda c: text.parse_dates(c)) == dt.date(2024, 2, 1)


def test_parsers_read_entities_and_wide_forms(spark):
    """Expected values are those of the forms' own rules: entities are resolved and wide forms made narrow before anything is read."""
    said = {"yes&nbsp;": True, "ＹＥＳ": True, "&#x928;&#x939;&#x940;&#x902;": False, " &amp; ": None, "Ｎｏ\u3000": False}
    assert [one(spark, k, text.parse_yes_no) for k in said] == list(said.values())
    assert [one(spark, k, text.parse_completed_months) for k in ("２ years 3 mo", "२&nbsp;yr", "１８", "1&#32;year&#32;6 months", None)] == [27, 24, 18, 18, None]
    assert [one(spark, k, text.parse_percent) for k in ("１０&nbsp;से २०", "４０％", "Ｎ/Ａ", "&lt;5")] == [15.0, 40.0, None, 5.0]
    assert one(spark, " ９८&nbsp;7 ", text.normalize_phone) == "987" and one(spark, "Ａ&amp;b@X.org", text.normalize_email) == "a&b@x.org"
    assert tuple(one(spark, "केवल&nbsp;समझता/समझती\u2003है", lambda c: text.score_response(c, 1))) == (1, 0, False)
    assert tuple(one(spark, "कहता&#47;कहती है", lambda c: text.score_response(c, 2))) == (None, 1, False)


def test_equal_parsers_share_one_pass(spark):
    df = spark.createDataFrame([("yes&nbsp;",)], "x string").select(text.parse_yes_no(F.col("x")).alias("a"), text.parse_percent(F.col("x")).alias("b"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_normalize(spark):
    assert one(spark, " a \t\n b१ ", text.normalize_text) == "a b1"
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "ﬁ&amp;x", text.normalize_full) == "fi&x"


def test_scores(spark):
    assert tuple(one(spark, "समझता/समझती है और कहता/कहती है", lambda c: text.score_response(c, 1))) == (1, 1, False)
    assert tuple(one(spark, "केवल समझता/समझती है", lambda c: text.score_response(c, 1))) == (1, 0, False)
    assert tuple(one(spark, "कहता/कहती है", lambda c: text.score_response(c, 2))) == (None, 1, False)
    assert tuple(one(spark, text.UNDERSTANDS, lambda c: text.score_response(c, 1))) == (1, 0, False)
    assert tuple(one(spark, text.SAYS, lambda c: text.score_response(c, 1))) == (1, 1, False)
    assert tuple(one(spark, "", lambda c: text.score_response(c, 2))) == (None, 0, False)
    assert one(spark, "huh", lambda c: text.score_response(c, 2))["unknown"]


def test_exposure_of_exactly_the_limit_fails(spark):
    share = lambda c: age.exposure([(F.lit("x"), c)])
    assert one(spark, 25.0, share, "double")["passed"] is False
    assert one(spark, 24.0, share, "double")["passed"] is True
    assert one(spark, None, share, "double")["unknown"] is True
    assert one(spark, -1.0, share, "double")["invalid"] is True


def test_forms_by_age(spark):
    rows = spark.createDataFrame([(m,) for m in (None, 7.9, 8.0, 18.99, 19.0, 36.999999, 37.0)], "m double")
    assert [r[0] for r in rows.select(age.expected_form(F.col("m"))).collect()] == ["unknown", "out_of_range", "CDI-I", "CDI-I", "CDI-II", "CDI-II", "out_of_range"]
    assert one(spark, "mid", lambda c: age.ordered_level(c, ["low", "mid", "high"])) == 2
    assert one(spark, "none", lambda c: age.ordered_level(c, ["low"])) is None


def test_unicode_forms_of_many_texts(spark):
    """Only texts beyond ASCII (or with an entity) are sent to Python, and no more than HELD of them are strings there at once."""
    import unicodedata

    made = [None, "", "plain", "é", "Å &amp; x", "&lt;b&gt;", "가", "q̣̇"]
    rows = [(i, None if t is None else t * (1 + i % 3)) for i, t in enumerate(made * 80)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(2)
    found = df.select("i", text.unicode_fixed(F.col("t"), "NFC", unescape=False).alias("t"))
    assert {r.i: r.t for r in found.collect()} == {i: t and unicodedata.normalize("NFC", t) for i, t in rows}
    assert "ArrowEvalPython" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "RLIKE" in plan and len(rows) > 2 * text.HELD
