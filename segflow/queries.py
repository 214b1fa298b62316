"""The library's queries over the tables, each with the DuckDB SQL that it must equal (None where SQL cannot state it)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.functions import age as fage
from segflow.functions import samples as fsamples
from segflow.functions import text as ftext
from segflow.operators import cohort, curves, design, evaluate, forms, ids, intervals, items, joins, models, norms, profile, quality, reshape, sessions
from segflow.plans import backends
from segflow.plans import cohort as cohort_plan
from segflow.plans import segments as segment_plan
from segflow.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
CLASSES = ["click", "error", "purchase", "signup", "view"]
SOURCES = [f"src{i}" for i in range(20)]


class Tables:
    """The folder's tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def segments(self, scale: float = 60.0) -> DataFrame:
        """Events as segments: a user's recording, the event's class, a start, and an end that the value gives."""
        start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        return self.events.select("event_id", "user_id", "event_type", "value", start.alias("start_sec"), (start + F.col("value") * scale).alias("end_sec"))


SEG = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS start_sec, epoch_us(ts) / 1e6 + value * 60 AS end_sec FROM events)"


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    def add(make: Callable[[Tables], DataFrame]) -> Callable:
        name = make.__name__
        _QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return make

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- cohort ------------------------------------------------------------------

_RATES = ", ".join(f"CASE WHEN s.user_id IS NOT NULL THEN coalesce(n_{c}, 0) END::DOUBLE AS {c}_count, round(CASE WHEN s.user_id IS NOT NULL THEN coalesce(d_{c}, 0) END, 6) AS {c}_duration_sec, round(CASE WHEN s.user_id IS NOT NULL AND hours > 0 THEN coalesce(n_{c}, 0) / hours END, 6) AS {c}_count_hour, round(CASE WHEN s.user_id IS NOT NULL AND hours > 0 THEN coalesce(d_{c}, 0) / hours END, 6) AS {c}_duration_hour" for c in CLASSES)
_SUMS = ", ".join(f"sum(CASE WHEN event_type = '{c}' THEN 1 END) AS n_{c}, sum(CASE WHEN event_type = '{c}' THEN value END) AS d_{c}" for c in CLASSES)


@query(f"""WITH s AS (SELECT user_id, {_SUMS} FROM events WHERE event_type <> 'error' OR value > 1 GROUP BY user_id), h AS (SELECT user_id, sum(value) / 3600 AS hours FROM events GROUP BY user_id)
SELECT h.user_id, round(hours, 6) AS hours, s.user_id IS NOT NULL AS matched, {_RATES} FROM h LEFT JOIN s USING (user_id)""")
def class_rates(t: Tables) -> DataFrame:
    hours = t.events.groupBy("user_id").agg(reshape.seconds_to_hours(F.sum("value")).alias("hours"))
    marked = t.events.where("event_type <> 'error' OR value > 1")  # the shortest errors are noise
    return rounded(cohort_plan.class_rates(marked, hours, "user_id", "event_type", "value", CLASSES))


@query("SELECT c_name, 'P' || lpad(CAST(dense_rank() OVER (ORDER BY c_name) AS VARCHAR), 9, '0') AS anon_id FROM (SELECT DISTINCT c_name FROM customer)")
def dense_ids(t: Tables) -> DataFrame:
    return ids.dense_ids(t.customer, "c_name", "P", 9)


@query("SELECT o_custkey, 'P' || lpad(CAST(row_number() OVER (ORDER BY d, k, o_custkey) AS VARCHAR), 6, '0') AS participant_id FROM (SELECT o_custkey, min(o_orderdate) AS d, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1)")
def first_seen_ids(t: Tables) -> DataFrame:
    return ids.first_seen_ids(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("WITH i AS (SELECT c_name, 'P' || lpad(CAST(dense_rank() OVER (ORDER BY c_name) AS VARCHAR), 6, '0') AS anon_id FROM customer) SELECT anon_id, c_nationkey, c_acctbal, c_mktsegment FROM customer JOIN i USING (c_name)")
def anonymous_customers(t: Tables) -> DataFrame:
    lookup = ids.dense_ids(t.customer, "c_name", "P", 6)
    _, public = ids.private_split(t.customer.select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), lookup, "c_name", "anon_id")
    return quality.assert_public(public, "anon_id", ["c_name"])


_Z = "WITH m AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS s FROM part WHERE p_retailprice >= 0)"


@query(f"{_Z} SELECT p_partkey, round((p_retailprice - a) / s, 6) AS p_retailprice_z, round(((p_retailprice - a) / s) * ((p_retailprice - a) / s), 6) AS p_retailprice_z2 FROM part, m")
def zscore_price(t: Tables) -> DataFrame:
    return rounded(cohort.zscore(t.part, "p_retailprice").select("p_partkey", "p_retailprice_z", "p_retailprice_z2"))


_SCALED = {"right": ("p_retailprice_z", "p_retailprice_z2"), "shifted": ("p_retailprice_z + p_size / 1e6", "p_retailprice_z2"), "squares": ("p_retailprice_z", "p_retailprice_z2 + CASE WHEN p_size = 7 THEN 1 ELSE 0 END")}


@query(f"""{_Z}, z AS (SELECT p_size, (p_retailprice - a) / s AS p_retailprice_z, power((p_retailprice - a) / s, 2) AS p_retailprice_z2 FROM part, m),
k AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, {z} AS z, {z2} AS z2 FROM z" for k, (z, z2) in _SCALED.items())}),
c AS (SELECT kind, abs(avg(z)) < 1e-9 AS mean, abs(stddev_pop(z) - 1) < 1e-9 AS deviation, count(*) FILTER (abs(z2 - z * z) > 1e-9) = 0 AS square FROM k GROUP BY kind) UNPIVOT c ON mean, deviation, square INTO NAME "check" VALUE passed""")
def zscore_checks(t: Tables) -> DataFrame:
    """Of right scores, of shifted ones, and of squares that are off in some rows."""
    scaled = cohort.zscore(t.part, "p_retailprice")
    found = [quality.zscore_checks(scaled.select(F.expr(z).alias("z"), F.expr(z2).alias("z2")), "z", "z2").withColumn("kind", F.lit(k)) for k, (z, z2) in _SCALED.items()]
    return found[0].union(found[1]).union(found[2])


_L = "SELECT l_orderkey, l_linenumber, '{0}' AS speaker, l_{0} AS input_count_hour, l_{0} * 2 AS input_duration_hour FROM lineitem"


@query(" UNION ALL ".join(_L.format(c) for c in ("quantity", "discount", "tax")))
def long_speakers(t: Tables) -> DataFrame:
    names = ["quantity", "discount", "tax"]
    wide = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(f"l_{c}").alias(f"{c}_count_hour") for c in names], *[(F.col(f"l_{c}") * 2).alias(f"{c}_duration_hour") for c in names])
    return reshape.to_long_speakers(wide, names, ["l_orderkey", "l_linenumber"])


@query(" UNION ALL ".join(f"SELECT c_custkey, '{c}' AS speaker, c_acctbal AS key_count_hour, c_acctbal + 1 AS key_duration_hour, c_nationkey * {k}.0 AS input_count_hour, c_nationkey * {k}.5 AS input_duration_hour FROM customer" for k, c in enumerate(("female", "male"))))
def long_input_output(t: Tables) -> DataFrame:
    wide = t.customer.select("c_custkey", F.col("c_acctbal").alias("key_count_hour"), (F.col("c_acctbal") + 1).alias("key_duration_hour"), *[(F.col("c_nationkey") * f).alias(f"{n}_{m}") for k, n in enumerate(("female", "male")) for m, f in (("count_hour", float(k)), ("duration_hour", k + 0.5))])
    return reshape.to_long_input_output(wide, ["female", "male"], "key", ["c_custkey"])


@query("SELECT user_id, event_type, count(*) AS count, round(sum(value), 6) AS duration_sec FROM events GROUP BY ALL")
def class_summary(t: Tables) -> DataFrame:
    return rounded(cohort.class_summary(t.events, ["user_id"], "event_type", "value"))


@query("SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{c}'), 0), 6) AS {c}_sec" for c in CLASSES) + " FROM events GROUP BY user_id")
def class_durations(t: Tables) -> DataFrame:
    return rounded(cohort.class_durations(t.events, ["user_id"], "event_type", "value", CLASSES))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_all, round(coalesce(a.s, 0), 6) AS all_sec, coalesce(b.n, 0) AS n_long, round(coalesce(b.s, 0), 6) AS long_sec FROM (SELECT user_id, count(*) n, sum(value) s FROM events GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) n, sum(value) s FROM events WHERE value >= 100 GROUP BY 1) b USING (user_id)")
def recording_summary(t: Tables) -> DataFrame:
    return rounded(cohort.recording_summary({"all": t.events, "long": reshape.min_duration(t.events, 100.0, "value")}, "user_id", "value"))


@query("WITH s AS (SELECT user_id, event_type, sum(value) AS total, min(ts) AS f FROM events GROUP BY ALL) SELECT user_id, event_type AS dominant, round(total, 6) AS total_sec FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, f) = 1")
def dominant_speaker(t: Tables) -> DataFrame:
    return rounded(cohort.dominant_speaker(t.segments(), ["user_id"], "event_type", "value"))


@query("""SELECT 'participants' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'matched_orders', count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'missing_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'issue_negative_age', count(*) FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'rows_orders', count(*) FROM orders""")
def build_report(t: Tables) -> DataFrame:
    matched = t.customer.join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders")), F.col("c_custkey") == F.col("o_custkey"), "left")
    return cohort.build_report(matched, quality.age_issues(t.customer, "c_custkey", "c_acctbal"), {"orders": "n_orders"}, {"orders": t.orders})


@query("SELECT CAST(c_custkey AS VARCHAR) AS participant_id, 'missing_orders' AS issue_type, 'no match: missing_orders' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'short_recording', printf('%.3f hours, fewer than 100', c_acctbal) FROM customer WHERE c_acctbal < 100")
def validation_report(t: Tables) -> DataFrame:
    missing = quality.match_issues(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "missing_orders")
    return quality.validation_report(missing.union(quality.short_recordings(t.customer, "c_custkey", "c_acctbal", 100.0)))


# --- intervals ---------------------------------------------------------------


@query(f"WITH s AS {SEG} SELECT a.event_id, a.user_id, round(greatest(a.start_sec, b.start_sec), 6) AS start_sec, round(least(a.end_sec, b.end_sec), 6) AS end_sec FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) >= 1")
def overlap_join(t: Tables) -> DataFrame:
    s = t.segments()
    found = intervals.overlap_join(s.where("event_type = 'click'"), s.where("event_type = 'view'"), ["user_id"], 1.0)
    return rounded(found.select("event_id", "user_id", "start_sec", "end_sec"))


_PAIRS = f"WITH s AS {SEG}, p AS (SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id, a.event_type AS first_speaker, b.event_type AS second_speaker, greatest(a.start_sec, b.start_sec) AS overlap_start, least(a.end_sec, b.end_sec) AS overlap_end FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND (a.start_sec, a.end_sec, a.event_id) < (b.start_sec, b.end_sec, b.event_id) AND greatest(a.start_sec, b.start_sec) < least(a.end_sec, b.end_sec))"


def _pairs(t: Tables) -> DataFrame:
    return intervals.pairwise_overlaps(t.segments(), ["user_id"], "event_type", "event_id")


@query(f"{_PAIRS} SELECT user_id, first_id, second_id, first_speaker, second_speaker, round(overlap_start, 6) AS overlap_start, round(overlap_end, 6) AS overlap_end, round(overlap_end - overlap_start, 5) AS overlap_sec FROM p")
def pairwise_overlaps(t: Tables) -> DataFrame:
    return rounded(_pairs(t).withColumn("overlap_sec", F.round("overlap_sec", 5)))


@query(f"{_PAIRS}, o AS (SELECT DISTINCT unnest([first_id, second_id]) AS e FROM p) SELECT (SELECT count(*) FROM o) AS overlapping, (SELECT count(*) FROM events) AS total, round((SELECT count(*) FROM o) / (SELECT count(*) FROM events), 6) AS share")
def overlap_share(t: Tables) -> DataFrame:
    return rounded(profile.overlap_share(_pairs(t), t.segments(), ["user_id"], "event_id"))


@query(f"{_PAIRS} SELECT first_id, second_id, round(overlap_end - overlap_start, 4) AS overlap_sec FROM p ORDER BY overlap_end - overlap_start DESC, first_id, second_id LIMIT 10")
def top_overlaps(t: Tables) -> DataFrame:
    return rounded(profile.top_overlaps(_pairs(t)).select("first_id", "second_id", "overlap_sec"), 4)


@query(f"""WITH s AS {SEG}, m AS (SELECT * FROM s WHERE event_type = 'view'), c AS (SELECT a.event_id, sum(greatest(0, least(a.end_sec, m.end_sec) - greatest(a.start_sec, m.start_sec))) AS cov FROM s a JOIN m USING (user_id) WHERE a.event_type <> 'view' GROUP BY 1),
f AS (SELECT s.event_id, s.user_id, coalesce(cov, 0) AS cov, coalesce(cov, 0) >= 0.5 * (end_sec - start_sec) AS kept FROM s LEFT JOIN c USING (event_id) WHERE event_type <> 'view')
SELECT event_id, user_id, round(cov, 4) AS covered_sec FROM (SELECT *, bool_or(kept) OVER (PARTITION BY user_id) AS any_kept FROM f) WHERE kept OR NOT any_kept""")
def overlap_coverage(t: Tables) -> DataFrame:
    s = t.segments()
    found = intervals.overlap_coverage(s.where("event_type <> 'view'"), s.where("event_type = 'view'"), ["user_id"], "event_id", 0.5)
    return rounded(found.select("event_id", "user_id", "covered_sec"), 4)


_MERGE = f"""WITH s AS {SEG}, f AS (SELECT *, start_sec - lag(end_sec) OVER w AS space FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY start_sec, end_sec)),
g AS (SELECT *, sum(CASE WHEN space BETWEEN 0 AND 36000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS g FROM f)"""


@query(f"{_MERGE} SELECT user_id, event_type, g::BIGINT AS group_id, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, count(*) AS n_merged, round(max(end_sec) - min(start_sec), 4) AS duration_sec FROM g GROUP BY ALL")
def merge_close(t: Tables) -> DataFrame:
    return rounded(intervals.merge_close(t.segments(), ["user_id", "event_type"], 36000.0).withColumn("duration_sec", F.round("duration_sec", 4)))


@query("""WITH f AS (SELECT user_id, value > 40 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events), i AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS island FROM f WHERE flag)
SELECT user_id, round(min(frame) * 0.03, 6) AS start_sec, round((max(frame) + 1) * 0.03, 6) AS end_sec FROM i GROUP BY user_id, island HAVING count(*) >= 2""")
def flag_regions(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    frames = t.events.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("frame"), (F.col("value") > 40).alias("flag"))
    return rounded(intervals.flags_to_regions(frames, ["user_id"], "frame", "flag", 480, 16000, 45.0))


@query(f"WITH s AS {SEG}, p AS (SELECT *, max(end_sec) OVER (PARTITION BY user_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) SELECT event_id, user_id, round(greatest(start_sec, coalesce(b, start_sec)), 6) AS start_sec, round(end_sec, 6) AS end_sec FROM p WHERE end_sec > greatest(start_sec, coalesce(b, start_sec))")
def non_overlap_tier(t: Tables) -> DataFrame:
    return rounded(intervals.non_overlap(t.segments(), ["user_id"]).select("event_id", "user_id", "start_sec", "end_sec"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w - 1 AS source_index, round(coalesce(sum(l_quantity + 0.5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS combined_start, round(coalesce(sum(l_quantity + 0.5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + l_quantity, 6) AS combined_end FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)")
def combined_offsets(t: Tables) -> DataFrame:
    placed = intervals.combined_offsets(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_quantity", 0.5)
    return rounded(placed.select("l_orderkey", "l_linenumber", "l_partkey", "source_index", "combined_start", "combined_end"))


@query("""WITH s AS (SELECT event_id, user_id, event_type, event_id * 1.0 AS start_sec, event_id + value AS end_sec FROM events), l AS (SELECT *, (round_even(end_sec * 16000, 0) - round_even(start_sec * 16000, 0)) / 16000 AS n FROM s),
p AS (SELECT *, coalesce(sum(n + 0.15) OVER (PARTITION BY user_id, event_type ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l WHERE n > 0) SELECT event_id, round(a, 5) AS stream_start, round(a + n, 5) AS stream_end FROM p""")
def class_stream_offsets(t: Tables) -> DataFrame:
    s = t.events.select("event_id", "user_id", "event_type", F.col("event_id").cast("double").alias("start_sec"), (F.col("event_id") + F.col("value")).alias("end_sec"))
    return rounded(intervals.class_stream_offsets(s, ["user_id"], "event_type").select("event_id", "stream_start", "stream_end"), 5)


@query("WITH d AS (SELECT o_orderkey, o_totalprice / 100 AS dur FROM orders), n AS (SELECT *, 1 + greatest(0, ceil((dur - 900) / 890))::BIGINT AS k FROM d WHERE dur > 0) SELECT o_orderkey, i AS chunk_id, round(i * 890.0, 6) AS chunk_start, round(least(i * 890 + 900, dur), 6) AS chunk_end FROM n, unnest(range(k)) r(i)")
def chunks(t: Tables) -> DataFrame:
    found = intervals.chunks(t.orders.select("o_orderkey", (F.col("o_totalprice") / 100).alias("dur")), "dur", 900.0, 10.0)
    return rounded(found.select("o_orderkey", "chunk_id", "chunk_start", "chunk_end"))


@query("""WITH s AS (SELECT event_id, 0.0 AS s, value AS d FROM events), k AS (SELECT *, floor((d - 10) / 5 + 1e-9)::BIGINT AS k FROM s),
w AS (SELECT event_id, i * 5.0 AS a FROM k, unnest(range(greatest(k, 0) + 1)) r(i) UNION ALL SELECT event_id, d - 10 FROM k WHERE d > 10 AND k * 5 + 10 < d - 1e-9) SELECT event_id, round(a, 6) AS window_start, round(a + 10, 6) AS window_end FROM w""")
def sliding_windows(t: Tables) -> DataFrame:
    s = t.events.select("event_id", F.lit(0.0).alias("start_sec"), F.col("value").alias("end_sec"))
    return rounded(intervals.sliding_windows(s, 10.0, 5.0).select("event_id", "window_start", "window_end"))


@query("WITH c AS (SELECT event_id, user_id, sum(value + 0.15) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 0.15 AS c FROM events) SELECT event_id, user_id, round(c, 6) AS cumulative_sec FROM c WHERE c <= 500.005")
def cap_total(t: Tables) -> DataFrame:
    s = t.events.select("event_id", "user_id", F.lit(0.0).alias("zero"), "value").withColumn("start_sec", F.col("event_id") * 1000.0).withColumn("end_sec", F.col("start_sec") + F.col("value"))
    return rounded(intervals.cap_total(s, ["user_id"], 500.005, 0.15).select("event_id", "user_id", "cumulative_sec"))


@query("SELECT event_id, round(greatest(value, 10), 6) AS start_sec, round(least(value + 50, 100), 6) AS end_sec FROM events WHERE least(value + 50, 100) > greatest(value, 10)")
def clamp_intervals(t: Tables) -> DataFrame:
    s = t.events.select("event_id", F.col("value").alias("start_sec"), (F.col("value") + 50).alias("end_sec"))
    return rounded(intervals.clamp_intervals(s, 10.0, 100.0))


@query(f"""WITH s AS {SEG}, i AS (SELECT a.user_id, a.event_type, greatest(a.start_sec, b.start_sec) AS s, least(a.end_sec, b.end_sec) AS e FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type IN ('click', 'error') AND b.event_type = 'view' AND least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) >= 0.2 AND greatest(a.start_sec, b.start_sec) < least(a.end_sec, b.end_sec)),
f AS (SELECT *, s - lag(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e) AS sp FROM i), g AS (SELECT *, sum(CASE WHEN sp BETWEEN 0 AND 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, event_type, g::BIGINT AS group_id, round(min(s), 6) AS start_sec, round(max(e), 6) AS end_sec, count(*) AS n_merged FROM g GROUP BY ALL HAVING max(e) - min(s) >= 30""")
def speech_turns(t: Tables) -> DataFrame:
    s = t.segments()
    found = segment_plan.speech_turns(s.where("event_type IN ('click', 'error')"), s.where("event_type = 'view'"), "user_id", ["event_type"], 0.2, 3600.0, 30.0)
    return rounded(found.select("user_id", "event_type", "group_id", "start_sec", "end_sec", "n_merged"))


@query("""WITH s AS (SELECT event_id, value AS d FROM events WHERE value > 0), k AS (SELECT *, floor((d - 10) / 5 + 1e-9)::BIGINT AS k FROM s), w AS (SELECT event_id, i * 5.0 AS a FROM k, unnest(range(greatest(k, 0) + 1)) r(i) UNION ALL SELECT event_id, d - 10 FROM k WHERE d > 10 AND k * 5 + 10 < d - 1e-9),
m AS (SELECT event_id, count(*) AS n_windows, sum(10 / (1 + a)) / (sum(10) + 1e-12) AS p FROM w GROUP BY 1) SELECT event_id, n_windows, round(p, 11) AS probs_near, round(1 - p, 11) AS probs_far, CASE WHEN p >= 0.5 THEN 'near' ELSE 'far' END AS predicted_class FROM m WHERE abs(p - 0.5) > 1e-9""")
def score_windows(t: Tables) -> DataFrame:
    import pandas as pd

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        near = 1 / (1 + pdf["window_start"])
        return pd.DataFrame({"near": near, "far": 1 - near})

    s = t.events.where("value > 0").select("event_id", F.lit(0.0).alias("start_sec"), F.col("value").alias("end_sec"))
    found = segment_plan.score_windows(s, predict, ["near", "far"], ["event_id"], 10.0, 5.0)
    return rounded(found.where(F.abs(F.col("probs_near") - 0.5) > 1e-9).select("event_id", "n_windows", "probs_near", "probs_far", "predicted_class"), 11)


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS sec, round(count(*) / sum(count(*)) OVER (), 6) AS share_n, round(sum(value) / sum(sum(value)) OVER (), 6) AS share_sec FROM events GROUP BY event_type")
def class_balance(t: Tables) -> DataFrame:
    return rounded(segment_plan.class_balance(t.events, "event_type", "value"))


# --- sessions, sources ---------------------------------------------------------

_SESSION = "CASE WHEN o_orderkey % 11 = 0 THEN 'session_a' ELSE strftime(o_orderdate, '%Y%m%d') END"


def _sessions(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 11 == 0, "session_a").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", "o_custkey", name.alias("session"), F.col("o_totalprice").alias("duration"))


_ORD = f"(SELECT o_orderkey, o_custkey, {_SESSION} AS session, o_totalprice AS duration FROM orders)"
_FIRST = f"WITH o AS {_ORD}, f AS (SELECT o_custkey, min(session) FILTER (session <> 'session_a') AS first FROM o GROUP BY 1)"


@query(f"{_FIRST} SELECT o.* FROM o JOIN f USING (o_custkey) WHERE first IS NULL OR session = first")
def earliest_session(t: Tables) -> DataFrame:
    return sessions.earliest_session(_sessions(t), "o_custkey", "session").select("o_orderkey", "o_custkey", "session", "duration")


@query(f"{_FIRST} SELECT o_custkey, first AS selected_session, count(*) FILTER (first IS NULL OR session = first) AS n_files, round(sum(duration) FILTER (first IS NULL OR session = first), 9) AS total_sec, coalesce(string_agg(DISTINCT session, '; ' ORDER BY session) FILTER (NOT (first IS NULL OR session = first)), '') AS ignored_sessions, round(sum(duration) FILTER (first IS NULL OR session = first) / 3600, 9) AS total_hours, CASE WHEN first IS NULL THEN 'no valid session date: all files' ELSE 'earliest session' END AS reason FROM o JOIN f USING (o_custkey) GROUP BY o_custkey, first")
def session_audit(t: Tables) -> DataFrame:
    return rounded(sessions.session_audit(_sessions(t), "o_custkey", "session", "duration"), 9)


@query(f"WITH o AS {_ORD} SELECT count(*) AS recordings, count(DISTINCT o_custkey) AS participants, count(DISTINCT (o_custkey, session)) AS sessions FROM o")
def manifest_counts(t: Tables) -> DataFrame:
    return sessions.manifest_counts(_sessions(t), "o_custkey", "session")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 20)")
def limit_participants(t: Tables) -> DataFrame:
    return sessions.limit_participants(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 20)


@query("SELECT source, max_by(CAST(doc_id AS VARCHAR), (n_chars, CAST(doc_id AS VARCHAR))) AS path, count(*) AS n_candidates, CASE WHEN count(*) > 1 THEN printf('%d files, one chosen', count(*)) END AS warning FROM documents GROUP BY source")
def pick_one_file(t: Tables) -> DataFrame:
    files = t.documents.select("source", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"))
    return sessions.pick_one_file(files, "source", "path", "size")


# --- evaluation ----------------------------------------------------------------

_LAB = "(SELECT d.source AS truth, CASE WHEN l.quality = 1 THEN d.source ELSE 'src0' END AS predicted, l.doc_id FROM labels l JOIN documents d USING (doc_id))"


def _labelled(t: Tables) -> DataFrame:
    joined = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return joined.select(F.col("source").alias("truth"), F.when(F.col("quality") == 1, F.col("source")).otherwise("src0").alias("predicted"), "doc_id")


_SRC = "(SELECT 'src' || i AS label FROM range(20) r(i))"
_MATRIX = f"WITH l AS {_LAB}, m AS (SELECT a.label AS truth, b.label AS predicted, (SELECT count(*) FROM l WHERE l.truth = a.label AND l.predicted = b.label) AS n FROM {_SRC} a, {_SRC} b)"


@query(f"{_MATRIX} SELECT * FROM m")
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluate.confusion_matrix(_labelled(t), "truth", "predicted", SOURCES)


_CLASSWISE = f"""{_MATRIX}, c AS (SELECT label, (SELECT sum(n) FROM m WHERE truth = label AND predicted = label) AS tp, (SELECT sum(n) FROM m WHERE predicted = label) AS p, (SELECT sum(n) FROM m WHERE truth = label) AS t, (SELECT sum(n) FROM m) AS total FROM {_SRC}),
x AS (SELECT label, tp::BIGINT AS tp, (p - tp)::BIGINT AS fp, (t - tp)::BIGINT AS fn, (total - t - p + tp)::BIGINT AS tn, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS precision, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS recall FROM c),
y AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM x)"""


@query(f"{_CLASSWISE} SELECT label, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM y")
def classwise_metrics(t: Tables) -> DataFrame:
    return rounded(evaluate.classwise_metrics(evaluate.confusion_matrix(_labelled(t), "truth", "predicted", SOURCES)))


@query(f"{_CLASSWISE} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM y")
def macro_metrics(t: Tables) -> DataFrame:
    return rounded(evaluate.macro_metrics(evaluate.classwise_metrics(evaluate.confusion_matrix(_labelled(t), "truth", "predicted", SOURCES))))


@query(f"WITH l AS {_LAB} SELECT count(*) AS n_rows, round(avg((truth = predicted)::INT), 6) AS accuracy FROM l")
def accuracy(t: Tables) -> DataFrame:
    return rounded(evaluate.accuracy(_labelled(t), "truth", "predicted"))


@query("""WITH l AS (SELECT d.lang, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS predicted FROM labels JOIN documents d USING (doc_id)), g AS (SELECT lang, * EXCLUDE lang FROM l UNION ALL SELECT NULL, * EXCLUDE lang FROM l),
m AS (SELECT lang, count(*) AS n_rows, avg((truth = predicted)::INT) AS accuracy, count(*) FILTER (truth = 'good' AND predicted = 'good') AS tg, count(*) FILTER (predicted = 'good') AS pg, count(*) FILTER (truth = 'good') AS rg, count(*) FILTER (truth = 'bad' AND predicted = 'bad') AS tb, count(*) FILTER (predicted = 'bad') AS pb, count(*) FILTER (truth = 'bad') AS rb FROM g GROUP BY lang)
SELECT lang, n_rows, round(accuracy, 6) AS accuracy, round((coalesce(tg / nullif(pg, 0), 0) + coalesce(tb / nullif(pb, 0), 0)) / 2, 6) AS macro_precision, round((coalesce(tg / nullif(rg, 0), 0) + coalesce(tb / nullif(rb, 0), 0)) / 2, 6) AS macro_recall, round((coalesce(2 * tg / nullif(pg + rg, 0), 0) + coalesce(2 * tb / nullif(pb + rb, 0), 0)) / 2, 6) AS macro_f1 FROM m""")
def evaluate_by_language(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("predicted"))
    return rounded(evaluate.evaluate(rows, "truth", "predicted", ["good", "bad"], "lang"))


@query()
def sample_n(t: Tables) -> DataFrame:
    return evaluate.sample_n(t.documents.select("doc_id", "source"), ["source"], 5, 42, ["doc_id"])


@query("SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 'good' ELSE '' END AS manual_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def merge_existing_labels(t: Tables) -> DataFrame:
    done = t.labels.where("quality = 1").select("doc_id", F.lit("good").alias("manual_label"))
    return joins.merge_existing_labels(t.documents.select("doc_id", "source"), done, ["doc_id"])


# --- forms -----------------------------------------------------------------------

_CHAIN = """(SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, o.o_totalprice, o.o_orderstatus, c.c_nationkey, c.c_acctbal, c.c_mktsegment, c.c_custkey IS NOT NULL AS has_customer_link, n.n_name, n.n_regionkey, n.n_nationkey IS NOT NULL AS has_nation_link, r.r_name, r.r_regionkey IS NOT NULL AS has_region_link
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > -200) c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_name <> 'NATION_7') n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def _chain(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    customer = t.customer.where("c_acctbal > -200").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = t.nation.where("n_name <> 'NATION_7'").select("n_nationkey", "n_name", "n_regionkey")
    return joins.link_chain(base, [(customer, "o_custkey", "c_custkey", "customer"), (F.broadcast(nation), "c_nationkey", "n_nationkey", "nation"), (F.broadcast(t.region.select("r_regionkey", "r_name")), "n_regionkey", "r_regionkey", "region")])


@query(f"SELECT o_orderkey, has_customer_link, has_nation_link, has_region_link, n_name, r_name FROM {_CHAIN}")
def reference_chain(t: Tables) -> DataFrame:
    return _chain(t).select("o_orderkey", "has_customer_link", "has_nation_link", "has_region_link", "n_name", "r_name")


@query(f"WITH c AS {_CHAIN} SELECT 'rows' AS metric, count(*) AS value FROM c UNION ALL SELECT 'has_customer_link', count(*) FILTER (has_customer_link) FROM c UNION ALL SELECT 'has_nation_link', count(*) FILTER (has_nation_link) FROM c UNION ALL SELECT 'has_region_link', count(*) FILTER (has_region_link) FROM c UNION ALL SELECT 'participants', count(DISTINCT o_custkey) FROM c UNION ALL SELECT 'several_contacts', count(*) FILTER (c_nationkey > 1) FROM c")
def link_counts(t: Tables) -> DataFrame:
    return forms.link_counts(_chain(t), ["has_customer_link", "has_nation_link", "has_region_link"], "o_custkey", "c_nationkey")


_STAGES = {"all": "true", "linked": "has_region_link", "rich": "c_acctbal > 5000", "dear": "o_totalprice > 100000"}


@query(f"WITH c AS {_CHAIN} " + " UNION ALL ".join(f"SELECT {i} AS stage_order, '{s}' AS stage, " + ", ".join(f"count(*) FILTER (({m}) AND o_orderstatus = '{f}') AS \"{f}\"" for f in "FOP") + f", count(*) FILTER ({m}) AS total FROM c" for i, (s, m) in enumerate(_STAGES.items())))
def flow_table(t: Tables) -> DataFrame:
    return forms.flow_table(_chain(t), "o_orderstatus", list("FOP"), {s: F.expr(m) for s, m in _STAGES.items()})


_FAIL = {"no_consent": "NOT has_customer_link", "broken_reference_chain": "NOT has_region_link", "hindi_exposure_leq_75": "c_acctbal <= 0", "age_outside_form_range": "o_totalprice < 20000", "age_form_mismatch": "o_totalprice > 400000"}
_PRIMARY = "CASE " + " ".join(f"WHEN {m} THEN '{r}'" for r, m in _FAIL.items()) + " ELSE '' END"


@query(f"SELECT o_orderkey, array_to_string(list_filter([{', '.join(f'CASE WHEN {m} THEN {chr(39)}{r}{chr(39)} END' for r, m in _FAIL.items())}], lambda x: x IS NOT NULL), '; ') AS all_reasons, {_PRIMARY} AS primary_reason FROM {_CHAIN}")
def exclusion_reasons(t: Tables) -> DataFrame:
    return forms.reasons(_chain(t), {r: F.expr(m) for r, m in _FAIL.items()}).select("o_orderkey", "all_reasons", "primary_reason")


_GROUPED = "CASE r WHEN 'no_consent' THEN 'No consent' WHEN 'broken_reference_chain' THEN 'Broken reference chain' WHEN 'hindi_exposure_leq_75' THEN 'Hindi exposure ≤75%' WHEN 'age_outside_form_range' THEN 'Age outside form range' WHEN 'age_form_mismatch' THEN 'Age outside form range' END"
_GROUPS = "(SELECT unnest(['No consent', 'Broken reference chain', 'Failed eligibility', 'Hindi exposure ≤75%', 'Hindi exposure unknown', 'Age outside form range', 'Incomplete CDI']) AS exclusion)"


@query(f"WITH c AS (SELECT o_orderstatus, {_PRIMARY} AS r FROM {_CHAIN}), g AS (SELECT o_orderstatus, {_GROUPED} AS exclusion FROM c) SELECT n.exclusion, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{f}') AS \"{f}\"" for f in "FOP") + f", count(o_orderstatus) AS total FROM {_GROUPS} n LEFT JOIN g USING (exclusion) GROUP BY n.exclusion")
def exclusion_table(t: Tables) -> DataFrame:
    return forms.exclusion_table(forms.reasons(_chain(t), {r: F.expr(m) for r, m in _FAIL.items()}), "o_orderstatus", list("FOP"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS consent, has_region_link AS linked,
  o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS eligible, o_orderkey % 23 = 0 AS unknown, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE o_orderkey % 110 END AS other,
  (o_orderkey % 1300) / 30.4375 AS months, CASE WHEN o_orderkey % 2 = 0 THEN 'CDI-I' ELSE 'CDI-II' END AS form FROM """ + _CHAIN + """),
f AS (SELECT *, other > 100 AS invalid, 100 - other > 75 AND NOT unknown AND other <= 100 AS passed, months >= 8 AND months <= 36.999999 AS age_ok,
  form = CASE WHEN months >= 8 AND months < 19 THEN 'CDI-I' WHEN months >= 19 AND months <= 36.999999 THEN 'CDI-II' ELSE '' END AS fits FROM a),
r AS (SELECT *, list_filter([CASE WHEN NOT consent THEN 'no_consent' END, CASE WHEN NOT linked THEN 'broken_reference_chain' END, CASE WHEN NOT eligible THEN 'failed_eligibility' END, CASE WHEN unknown THEN 'hindi_exposure_unknown' END,
  CASE WHEN invalid THEN 'hindi_exposure_invalid' END, CASE WHEN NOT passed AND NOT unknown AND NOT invalid THEN 'hindi_exposure_leq_75' END, CASE WHEN NOT age_ok THEN 'age_outside_form_range' END, CASE WHEN NOT fits THEN 'age_form_mismatch' END], lambda x: x IS NOT NULL) AS why FROM f)
SELECT k AS o_orderkey, eligible AS eligibility_passed, consent AND linked AND eligible AND passed AND age_ok AND fits AS included_final, array_to_string(why, '; ') AS all_reasons, coalesce(why[1], '') AS primary_reason FROM r""")
def eligibility(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda cases, other: F.coalesce(*[F.when(k % n == 0, v) for n, v in cases.items()], F.lit(other))
    unknown = k % 23 == 0
    months = fage.age_months(F.lit("2024-01-01").cast("date"), F.date_sub(F.lit("2024-01-01").cast("date"), (k % 1300).cast("int")), fage.FORM_MONTH)
    form = F.when(k % 2 == 0, "CDI-I").otherwise("CDI-II")
    answers = _chain(t).select(
        "o_orderkey", F.col("has_region_link").alias("has_link"), pick({7: "नहीं", 11: ""}, " हाँ ").alias("consent"), pick({5: "No"}, "हां").alias("tongue"), pick({13: "YES"}, "no").alias("preterm"),
        F.when(k % 17 == 0, "True").alias("impaired"), F.when(k % 19 != 0, "yes").alias("age"), fage.exposure([(F.lit("x"), F.when(~unknown, (k % 110).cast("double")))]).alias("e"), months.alias("months"), form.alias("form"),
    )
    rows = answers.withColumns({"valid": fage.age_is_valid(F.col("months")), "fits": F.col("form") == fage.expected_form(F.col("months"))}).select("*", "e.passed", "e.unknown", "e.invalid")
    columns = {"consent": "consent", "mother_tongue": "tongue", "preterm": "preterm", "impairment": "impaired", "age_answer": "age", "linked": "has_link", "exposure_ok": "passed", "exposure_unknown": "unknown", "exposure_invalid": "invalid", "age_valid": "valid", "age_form_match": "fits"}
    return forms.reasons(forms.criteria(rows, columns)).select("o_orderkey", "eligibility_passed", "included_final", "all_reasons", "primary_reason")


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN role = 'user' THEN 'm' || length(text) % 5 ELSE '' END AS mobile, CASE WHEN role = 'assistant' THEN 'e' || length(text) % 3 ELSE '' END AS email, 'c' || turn AS cid FROM conversations)
SELECT conv_id, count(*) AS n_contact_rows, min_by(cid, (turn, cid)) AS first_contact_id, min(turn) AS first_created, min_by(mobile, (turn, cid)) FILTER (mobile <> '') AS mobile, min_by(email, (turn, cid)) FILTER (email <> '') AS email, string_agg(DISTINCT cid, ' | ' ORDER BY cid) AS contact_ids FROM c GROUP BY conv_id""")
def contact_rollup(t: Tables) -> DataFrame:
    return forms.contact_rollup(_contacts(t), "conv_id", "cid", "turn", "mobile", "email")


def _contacts(t: Tables) -> DataFrame:
    n = F.length("text")
    pick = lambda role, prefix, m: F.when(F.col("role") == role, F.concat(F.lit(prefix), (n % m).cast("string"))).otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("cid"), pick("user", "m", 5).alias("mobile"), pick("assistant", "e", 3).alias("email"))


@query("""WITH c AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'm' || length(text) % 5 END AS m, CASE WHEN role = 'assistant' THEN 'e' || length(text) % 3 END AS e FROM conversations)
SELECT conv_id, count(*) AS n_rows, count(DISTINCT m) AS n_mobiles, count(DISTINCT e) AS n_emails, count(*) > 1 AS many_rows, count(DISTINCT m) > 1 AS many_mobiles, count(DISTINCT e) > 1 AS many_emails FROM c GROUP BY conv_id""")
def conflict_flags(t: Tables) -> DataFrame:
    return forms.conflict_flags(_contacts(t), "conv_id", "mobile", "email")


@query("SELECT coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderstatus)")
def duplicate_counts(t: Tables) -> DataFrame:
    return forms.duplicate_counts(t.orders, ["o_custkey", "o_orderstatus"])


@query("SELECT side, value FROM (SELECT DISTINCT 'observed_not_mapped' AS side, source AS value FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 4000) UNION ALL SELECT DISTINCT 'mapped_not_observed', lang FROM documents WHERE lang = 'xx')")
def unmapped(t: Tables) -> DataFrame:
    return joins.unmapped(t.documents.select("source"), t.documents.where("lang = 'es' AND n_chars > 4000").select("source"), "source")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_set(t: Tables) -> DataFrame:
    chosen = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.restrict_to(t.orders.select("o_orderkey", "o_custkey"), chosen, "o_custkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_validated(t: Tables) -> DataFrame:
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.join_validated(t.orders.select("o_orderkey", "o_custkey"), right, ["o_custkey"]).drop("o_custkey")


@query("""WITH c AS (SELECT unnest(['documents/1-8.txt', 'documents/2.txt']) AS file, unnest([['doc_id', 'text', 'lang'], ['doc_id', 'quality']]) AS cols), f AS (SELECT s.source || '-' || (ascii(s.source[4]) - 48) % 3 || '.txt' AS file, unnest(CASE WHEN min_n < 1000 THEN ['a', 'b', 'c'] ELSE ['a', 'd'] END) AS col FROM (SELECT source, min(n_chars) AS min_n FROM documents GROUP BY source) s),
r AS (SELECT * FROM (VALUES ('one', 1, 1, 'a'), ('one', 1, 1, 'b'), ('two', 2, 2, 'a'), ('two', 2, 2, 'd')) v(role, o, form, col)), h AS (SELECT file, role, count(*) AS hits FROM f JOIN r USING (col) GROUP BY ALL),
s AS (SELECT file, role, o, coalesce(hits, 0) + CASE WHEN list_contains(string_split(regexp_replace(file, '\\.[^.]*$', ''), '-'), CAST(form AS VARCHAR)) THEN 100 ELSE 0 END AS score FROM (SELECT DISTINCT file FROM f) CROSS JOIN (SELECT DISTINCT role, o, form FROM r) LEFT JOIN h USING (file, role))
SELECT file, role, score, count(*) OVER (PARTITION BY file, score) > 1 AS is_ambiguous FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, o DESC) = 1""")
def detect_form_role(t: Tables) -> DataFrame:
    sources = t.documents.groupBy("source").agg(F.min("n_chars").alias("n"))
    name = F.concat("source", F.lit("-"), ((F.ascii(F.substring("source", 4, 1)) - 48) % 3).cast("string"), F.lit(".txt"))
    listed = F.when(F.col("n") < 1000, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("d")))
    columns = sources.select(name.alias("file"), F.explode(listed).alias("column"))
    rules = t.spark.createDataFrame([("one", 1, 1, "a"), ("one", 1, 1, "b"), ("two", 2, 2, "a"), ("two", 2, 2, "d")], "role string, role_order int, form_id int, column string")
    return forms.detect_form_role(columns, rules).select("file", "role", "score", "is_ambiguous")


# --- items and norms -----------------------------------------------------------

_TURNS = "(SELECT conv_id, turn, CASE WHEN length(text) % 4 = 0 THEN '' WHEN length(text) % 4 = 1 THEN 'केवल समझता/समझती है' ELSE 'समझता/समझती है और कहता/कहती है' END AS response FROM conversations)"


def _responses(t: Tables) -> DataFrame:
    kind = F.length("text") % 4
    return t.conversations.select("conv_id", "turn", F.when(kind == 0, "").when(kind == 1, ftext.UNDERSTANDS).otherwise(ftext.SAYS).alias("response"))


@query(f"SELECT conv_id, turn, CASE response WHEN '' THEN 0 ELSE 1 END AS understand, CASE WHEN response = 'समझता/समझती है और कहता/कहती है' THEN 1 ELSE 0 END AS produce, false AS unknown FROM {_TURNS}")
def score_responses(t: Tables) -> DataFrame:
    return _responses(t).select("conv_id", "turn", ftext.score_response(F.col("response"), 1).alias("s")).select("conv_id", "turn", "s.*")


@query(f"SELECT conv_id, sum(CASE response WHEN '' THEN 0 ELSE 1 END)::BIGINT AS total_understand, sum(CASE WHEN response = 'समझता/समझती है और कहता/कहती है' THEN 1 ELSE 0 END)::BIGINT AS total_produce FROM {_TURNS} GROUP BY conv_id")
def score_totals(t: Tables) -> DataFrame:
    scored = _responses(t).select("conv_id", ftext.score_response(F.col("response"), 1).alias("s")).select("conv_id", "s.*")
    return items.score_totals(scored, ["conv_id"])


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n_present, count(*) FILTER (response <> '') AS n_non_blank, coalesce(max(turn + 1) FILTER (response <> ''), 0) AS last FROM {_TURNS} GROUP BY conv_id), r AS (SELECT *, CASE WHEN n_present >= 4 THEN 4 - last END AS run FROM c)
SELECT conv_id, n_present, n_non_blank, 4 AS n_expected, run::BIGINT AS trailing_blank_run, CASE WHEN run IS NULL THEN 'missing_item_columns' WHEN run = 4 THEN 'all_blank' WHEN run <= 1 THEN 'complete' ELSE 'trailing_blank_block' END AS status FROM r""")
def completeness(t: Tables) -> DataFrame:
    return items.completeness(_responses(t).withColumn("position", F.col("turn") + 1), ["conv_id"], "position", "response", 4, 1)


@query("SELECT p_brand, l_linenumber, count(v) AS n_observed, coalesce(sum(v), 0)::BIGINT AS n_endorsed, round(avg(v), 6) AS proportion FROM (SELECT p_brand, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL")
def item_proportions(t: Tables) -> DataFrame:
    return rounded(items.item_proportions(_answers(t), ["p_brand", "l_linenumber"], "v"))


def _answers(t: Tables) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "p_partkey", "p_brand", "p_type", "p_size", "p_name", v.alias("v"))


@query("WITH a AS (SELECT l_suppkey, p_size, p_type, avg(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_size, p_type, round(avg(m), 6) AS mean_proportion, count(DISTINCT l_suppkey) AS n_participants FROM a GROUP BY ALL")
def category_trajectories(t: Tables) -> DataFrame:
    return rounded(items.category_trajectories(_answers(t), "l_suppkey", "p_type", "p_size", "v"))


@query("WITH a AS (SELECT p_partkey, p_name, avg(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_partkey, p_name, round(m, 6) AS proportion FROM a WHERE m IS NOT NULL ORDER BY abs(m - 0.5), p_name, p_partkey LIMIT 6")
def representative_items(t: Tables) -> DataFrame:
    return rounded(items.representative_items(_answers(t), "p_partkey", "p_name", "v"))


@query("SELECT p_name, sum(n)::BIGINT AS n FROM (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, p_partkey) GROUP BY p_name ORDER BY n DESC, p_name LIMIT 4")
def most_observed(t: Tables) -> DataFrame:
    counts = _answers(t).groupBy("p_name", "p_partkey").agg(F.count("*").alias("n"))
    return items.most_observed(counts, "p_name", "n")


_Q = ", ".join(f"round(quantile_cont(p_retailprice, {q}), 6) AS p{round(100 * q)}" for q in norms.QUANTILES)


@query(f"SELECT g.i::INT AS p_size, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS min, max(p_retailprice) AS max, {_Q} FROM range(0, 61) g(i) LEFT JOIN part ON p_size = g.i GROUP BY 1")
def norm_table(t: Tables) -> DataFrame:
    return rounded(norms.norm_table(t.part, "p_size", "p_retailprice", 0, 60))


@query(f"SELECT p_size, p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, min(p_retailprice) AS min, max(p_retailprice) AS max, {_Q} FROM part GROUP BY p_size, p_brand")
def grouped_norms(t: Tables) -> DataFrame:
    return rounded(norms.grouped_norm_table(t.part, "p_size", "p_brand", "p_retailprice"))


@query("SELECT p_size, p_brand, round(median(p_retailprice), 6) AS median FROM part WHERE p_brand IS NOT NULL GROUP BY ALL")
def group_median(t: Tables) -> DataFrame:
    return rounded(norms.group_median(t.part, "p_size", "p_brand", "p_retailprice"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def age_counts(t: Tables) -> DataFrame:
    return norms.age_counts(t.orders, "o_orderstatus", "o_orderpriority")


_CELLS = {
    "N": "CAST(count(*) AS VARCHAR)", "balance mean (sd)": "printf('%.2f (%.2f)', avg(balance), stddev_samp(balance))",
    "balance median [q1, q3]": "printf('%.2f [%.2f, %.2f]', quantile_cont(balance, 0.5), quantile_cont(balance, 0.25), quantile_cont(balance, 0.75))",
    "balance range": "printf('%.2f-%.2f', min(balance), max(balance))", "c_nationkey mean (sd)": "printf('%.2f (%.2f)', avg(c_nationkey), stddev_samp(c_nationkey))",
    "sign: debt": "printf('%d (%.1f%%)', count(*) FILTER (balance < 0), 100.0 * count(*) FILTER (balance < 0) / count(*))",
}


@query(" UNION ALL ".join(f"SELECT c_mktsegment, '{n}' AS characteristic, {s} AS value FROM (SELECT *, c_acctbal / 7 AS balance FROM customer) GROUP BY c_mktsegment" for n, s in _CELLS.items()))
def sample_characteristics(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("balance", F.col("c_acctbal") / 7).withColumn("sign", F.when(F.col("balance") < 0, "Debt").otherwise("Credit"))
    return norms.sample_characteristics(rows, "c_mktsegment", "balance", "c_nationkey", {"sign": ["debt"]})


@query()
def mean_curves(t: Tables) -> DataFrame:
    return curves.mean_curves(t.part, "p_size", "p_retailprice", [float(i) for i in range(1, 51)], 1e6, ["p_brand"])


@query()
def quantile_curves(t: Tables) -> DataFrame:
    return curves.quantile_curves(t.part, "p_size", "p_retailprice", [float(i) for i in range(1, 51)], 1e6, group=["p_type"])


@query()
def item_curves(t: Tables) -> DataFrame:
    return norms.item_curves(_answers(t), "p_type", "p_size", "v", [float(i) for i in range(1, 51)])


@query()
def preview_poly(t: Tables) -> DataFrame:
    return curves.preview_poly(t.part, "p_size", "p_retailprice", 1e6, group=["p_type"])


# --- profiles ------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS non_missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS min, round(median({c}), 6) AS median, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def numeric_summary(t: Tables) -> DataFrame:
    return rounded(profile.numeric_summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent FROM (SELECT nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_custkey FROM orders)" for c in ("o_orderpriority", "o_custkey")))
def missing_summary(t: Tables) -> DataFrame:
    return rounded(profile.missing_summary(t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_custkey")))


@query("SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'missing') AS value, count(*) AS n FROM orders GROUP BY 1")
def value_distribution(t: Tables) -> DataFrame:
    return profile.value_distribution(t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")), "p")


@query("SELECT 'o_orderstatus' AS type, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def multi_distribution(t: Tables) -> DataFrame:
    return profile.multi_distribution(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderpriority, count(*) AS actual, count(*) FILTER (o_totalprice > 150000) AS included FROM orders GROUP BY 1")
def actual_vs_included(t: Tables) -> DataFrame:
    return profile.actual_vs_included(t.orders.withColumn("inc", F.col("o_totalprice") > 150000), "o_orderpriority", "inc")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, count(c_acctbal) AS n, round(stddev_samp(c_acctbal), 6) AS sd, round(coalesce(stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 0), 6) AS sem, round(1.96 * coalesce(stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 0), 6) AS ci95 FROM customer GROUP BY 1")
def mean_ci(t: Tables) -> DataFrame:
    return rounded(profile.mean_ci(t.customer, ["c_mktsegment"], "c_acctbal"))


_NUM = ("l_quantity", "l_extendedprice", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _NUM for b in _NUM))
def correlation_matrix(t: Tables) -> DataFrame:
    return rounded(profile.correlation_matrix(t.lineitem, list(_NUM)))


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, least(20, greatest(5, count(DISTINCT l_quantity))) AS k FROM lineitem), c AS (SELECT CASE WHEN hi > lo THEN least(k, floor((l_quantity - lo) / ((hi - lo) / k)) + 1) ELSE 1 END::BIGINT AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT i::BIGINT AS bin, round(lo + (i - 1) * (hi - lo) / k, 6) AS low, round(lo + i * (hi - lo) / k, 6) AS high, coalesce(n, 0) AS n FROM b, unnest(range(1, k + 1)) r(i) LEFT JOIN c ON c.bin = i""")
def histogram(t: Tables) -> DataFrame:
    return rounded(profile.histogram(t.lineitem, "l_quantity"))


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) SELECT l_returnflag, count(l_extendedprice) AS n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, q1, m, q3")
def box_stats(t: Tables) -> DataFrame:
    return rounded(profile.box_stats(t.lineitem, "l_returnflag", "l_extendedprice"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def simple_fit(t: Tables) -> DataFrame:
    return rounded(profile.simple_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]), 4)


@query("SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{c}'), 0), 6) AS {c}" for c in CLASSES) + " FROM events GROUP BY 1")
def composition(t: Tables) -> DataFrame:
    return rounded(profile.composition(t.events, "user_id", "event_type", CLASSES, "value"))


_DP = {"count": "count(value)::DOUBLE", "mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)", "below_10": "count(*) FILTER (value < 10)::DOUBLE", "pct_below_10": "100.0 * count(*) FILTER (value < 10) / count(value)"} | {f"p{100 * q:02.0f}": f"quantile_cont(value, {q})" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round({s}, 6) AS value FROM events" for m, s in _DP.items()))
def duration_profile(t: Tables) -> DataFrame:
    return rounded(profile.duration_profile(t.events, "value", [10.0]))


@query("""WITH e AS (SELECT value, CASE WHEN value >= 100 THEN '[100,inf)' WHEN value >= 50 THEN '[50,100)' WHEN value >= 10 THEN '[10,50)' WHEN value >= 0 THEN '[0,10)' END AS bin FROM events), g AS (SELECT unnest(['[0,10)', '[10,50)', '[50,100)', '[100,inf)']) AS bin)
SELECT g.bin, count(value) AS n, round(coalesce(sum(value), 0), 6) AS total_sec, round(avg(value), 6) AS mean_sec, round(median(value), 6) AS median_sec, round(100.0 * count(value) / (SELECT count(bin) FROM e), 6) AS pct_n, round(100.0 * coalesce(sum(value), 0) / (SELECT sum(value) FROM e WHERE bin IS NOT NULL), 6) AS pct_time FROM g LEFT JOIN e USING (bin) GROUP BY g.bin""")
def binned_profile(t: Tables) -> DataFrame:
    return rounded(profile.binned_profile(t.events, "value", [0.0, 10.0, 50.0, 100.0]))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total_sec, round(avg(value), 6) AS mean_sec, round(median(value), 6) AS median_sec, max(value) AS max_sec FROM events GROUP BY ALL")
def speaker_profile(t: Tables) -> DataFrame:
    return rounded(profile.speaker_profile(t.events, ["user_id", "event_type"], "value"))


_METRICS = "SELECT p_brand, count(x) AS n, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_samp(x) AS sd, CASE WHEN count(x) >= 3 THEN coalesce(avg(power(x, 3)) - 3 * avg(x) * avg(x * x) + 2 * power(avg(x), 3), 0) / nullif(power(stddev_pop(x), 3), 0) END AS skew, count(*) FILTER (x = 0) AS zeros, bool_and(x > 0) AS pos FROM (SELECT p_brand, p_retailprice / 1000 AS x FROM part) GROUP BY 1"


@query(f"SELECT p_brand, n, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(sd, 6) AS sd, round(skew, 4) AS skewness, zeros, pos AS positive_only, CASE WHEN NOT pos THEN 'lmm' WHEN skew IS NULL OR (abs(skew) < 1 AND sd / mean < 0.75) THEN 'lmm' WHEN skew >= 2.5 THEN 'gamma' ELSE 'log_lmm' END AS family, 'x' AS response, 'p_size, p_type' AS terms, 'normal equations' AS engine, 'fitted' AS status FROM ({_METRICS})")
def choose_family(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", (F.col("p_retailprice") / 1000).alias("x"))
    return rounded(models.selection_table(profile.choose_family(profile.response_metrics(rows, "x", ["p_brand"])), "x", ["p_size", "p_type"], "normal equations").withColumn("skewness", F.round("skewness", 4)))


@query("SELECT 'orders' AS dataset, count(*) AS n_rows, 6 AS n_columns FROM orders UNION ALL SELECT 'part', count(*), 6 FROM part")
def dataset_summary(t: Tables) -> DataFrame:
    return profile.dataset_summary({"orders": t.orders, "part": t.part})


@query("WITH e AS (SELECT p_brand, min_by(m, p_size) AS first, max_by(m, p_size) AS last FROM (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY ALL) GROUP BY 1) SELECT p_brand, round(first, 6) AS first, round(last, 6) AS last, round(last - first, 6) AS delta, CASE WHEN abs(last - first) < 1e-8 THEN 'flat' WHEN last > first THEN 'increasing' ELSE 'decreasing' END AS trend FROM e")
def trend(t: Tables) -> DataFrame:
    means = t.part.groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    return rounded(profile.trend(means, ["p_brand"], "p_size", "m"))


@query("SELECT string_agg(v, ' | ' ORDER BY v) AS sample FROM (SELECT DISTINCT v FROM (SELECT o_orderstatus AS v FROM orders UNION SELECT o_orderpriority FROM orders) ORDER BY v LIMIT 5)")
def value_sample(t: Tables) -> DataFrame:
    return profile.value_sample(t.orders, ["o_orderstatus", "o_orderpriority"], 5)


@query("SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM customer GROUP BY 1")
def percent_of_total(t: Tables) -> DataFrame:
    return rounded(profile.percent_of_total(t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "n"))


# --- text, quality ---------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '०१२३४५६७८९' || chr(160), '0123456789 '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS clean FROM documents")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ftext.normalize_text(F.col("text")).alias("clean"))


@query()
def normalize_full(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ftext.normalize_full(F.col("text")).alias("clean"))


#: Answers as forms export them, with what they mean: entities, full-width forms, digits of both scripts.
_YES_NO = {"हाँ": True, " No ": False, "?": None, "yes&nbsp;": True, "ＮＯ": False, "&#x939;&#x93e;&#x901;": True, "&#72;&#x941;": None, "Ｔｒｕｅ\u3000": True}
_MONTHS = {"2 years 3 mo": 27, "２ years 3 mo": 27, "१ yr": 12, "1&nbsp;year&#32;6 months": 18, "１１ months": 11, "3.5 yrs": 42, "&lt;": None, "": None, "९": 9}
_PERCENTS = {"10 से 20": 15.0, "１０&nbsp;से २०": 15.0, "N/A": None, "ＮＡ": None, "४०％": 40.0, "33.5 %": 33.5, "&amp;": None}
_PHONES = {" ९8 7\u00a06": "9876", "９８&nbsp;7": "987", "+91&#32;5": "+915"}


def _sql(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _means(known: dict) -> str:
    """SQL for the meaning that the row's number picks."""
    return f"CASE o_orderkey % {len(known)} " + " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(known.values())) + " END"


@query(f"""SELECT o_orderkey, {_means(_MONTHS)} AS months, {_means(_PERCENTS)} AS percent, {_means(_YES_NO)} AS yes, {_means(_PHONES)} AS phone, 'a' || o_orderkey || '&1 @x.org' AS email,
(o_orderkey % 5) * 12 + (o_orderkey % 11) AS made_months FROM orders""")
def text_parsers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    said = lambda known: F.element_at(F.array(*[F.lit(x) for x in known]), (k % len(known) + 1).cast("int"))
    return t.orders.select(
        "o_orderkey", ftext.parse_completed_months(said(_MONTHS)).alias("months"), ftext.parse_percent(said(_PERCENTS)).alias("percent"), ftext.parse_yes_no(said(_YES_NO)).alias("yes"),
        ftext.normalize_phone(said(_PHONES)).alias("phone"), ftext.normalize_email(text(" Ａ", k, "&amp;1 @X.org")).alias("email"),
        ftext.parse_completed_months(text(k % 5, "&nbsp;years ", k % 11, " months")).cast("long").alias("made_months"),
    )


@query("""SELECT c_custkey, round(c_custkey * 0.03, 6) AS months, floor(c_custkey * 0.03)::INT AS month, CASE WHEN c_custkey * 0.03 >= 8 AND c_custkey * 0.03 < 19 THEN 'CDI-I' WHEN c_custkey * 0.03 >= 19 AND c_custkey * 0.03 <= 36.999999 THEN 'CDI-II' ELSE 'out_of_range' END AS form, c_custkey * 0.03 BETWEEN 8 AND 36.999999 AS valid FROM customer""")
def age_fields(t: Tables) -> DataFrame:
    m = F.col("c_custkey") * F.lit(0.03)
    return rounded(t.customer.select("c_custkey", m.alias("months"), fage.age_month(m).alias("month"), fage.expected_form(m).alias("form"), fage.age_is_valid(m).alias("valid")))


@query("WITH e AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'x' END AS n1, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey * 2.0 END AS p1 FROM customer) SELECT c_custkey, 100 - coalesce(p1, 0) AS main_percent, n1 IS NOT NULL AND p1 IS NULL AS unknown, false AS invalid, 100 - coalesce(p1, 0) > 75 AND NOT (n1 IS NOT NULL AND p1 IS NULL) AS passed FROM e")
def exposure(t: Tables) -> DataFrame:
    n = F.when(F.col("c_nationkey") % 3 != 0, "x")
    p = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey") * 2.0)
    return t.customer.select("c_custkey", fage.exposure([(n, p)]).alias("e")).select("c_custkey", "e.*")


_HOST = "regexp_extract(url, '//([^./]+)', 1)"


@query(f"""WITH private AS (SELECT DISTINCT substring(s_name, 10) AS id FROM supplier UNION SELECT DISTINCT {_HOST} FROM pages WHERE {_HOST} <> '')
SELECT 'c_name' AS "column", count(*) AS n FROM customer, private WHERE contains(c_name, id) HAVING count(*) > 0 UNION ALL SELECT 'text', count(*) FROM documents, private WHERE contains(text, id) HAVING count(*) > 0 UNION ALL SELECT 'source', count(*) FROM documents, private WHERE contains(source, id) HAVING count(*) > 0""")
def leak_scan(t: Tables) -> DataFrame:
    private = t.supplier.select(F.substr("s_name", F.lit(10)).alias("id")).union(t.pages.select(F.expr(_HOST)))
    scanned = [quality.leak_scan(df, private, "id") for df in (t.customer.select("c_name"), t.documents.select("text", "source"))]
    return scanned[0].union(scanned[1])


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def format_consistency(t: Tables) -> DataFrame:
    return quality.format_consistency(t.lineitem, "l_orderkey", ["l_returnflag"])


@query("SELECT c_custkey, s AS status FROM customer, unnest(['F', 'O', 'P']) u(s) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = s)")
def output_completeness(t: Tables) -> DataFrame:
    wanted = t.customer.select("c_custkey", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("status"))
    return quality.output_completeness(wanted, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status")), ["c_custkey", "status"])


# --- samples ---------------------------------------------------------------------


@query("WITH p AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings) SELECT vec_id, round(peak, 6) AS peak, round(CASE WHEN peak <= 1e-12 THEN 1 ELSE power(10.0, -0.05) / peak END, 5) AS gain FROM p")
def peak_normalize(t: Tables) -> DataFrame:
    top = t.embeddings.select("vec_id", fsamples.peak(F.col("embedding")).alias("peak"))
    return top.select("vec_id", F.round("peak", 6).alias("peak"), F.round(fsamples.peak_gain(F.col("peak"), -1.0), 5).alias("gain"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[3:10], lambda x: greatest(-1, least(1, x::DOUBLE * 2)))), 5) AS total, 8 AS n FROM embeddings")
def slice_and_gain(t: Tables) -> DataFrame:
    cut = fsamples.apply_gain(fsamples.slice_samples(F.col("embedding"), 100, F.lit(0.02), F.lit(0.10)), F.lit(2.0))
    return t.embeddings.select("vec_id", F.round(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size(cut).alias("n"))


# --- models ----------------------------------------------------------------------


_LINE = "SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_count(l_extendedprice, l_quantity)::DOUBLE AS n, regr_r2(l_extendedprice, l_quantity) AS r2, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS left_over, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_avgx(l_extendedprice, l_quantity) AS mean FROM lineitem"


@query(f"""WITH l AS ({_LINE}), s AS (SELECT *, left_over / (n - 2) AS v, -n / 2 * (ln(2 * pi() * left_over / n) + 1) AS loglik FROM l),
t AS (SELECT 'l_quantity' AS term, b AS estimate, sqrt(v / sxx) AS se, * FROM s UNION ALL SELECT '(intercept)', a, sqrt(v * (1 / n + mean * mean / sxx)), * FROM s)
SELECT term, round(estimate, 3) AS estimate, round(se, 3) AS se, round(estimate / se, 2) AS statistic, round(estimate - 1.96 * se, 2) AS low, round(estimate + 1.96 * se, 2) AS high, n, round(r2, 6) AS r2, round(loglik, 2) AS loglik, round(6 - 2 * loglik, 2) AS aic, round(3 * ln(n) - 2 * loglik, 2) AS bic FROM t""")
def fixed_effects(t: Tables) -> DataFrame:
    digits = {"estimate": 3, "se": 3, "statistic": 2, "low": 2, "high": 2, "r2": 6, "loglik": 2, "aic": 2, "bic": 2}
    return models.fit_linear(t.lineitem, ["l_quantity"], "l_extendedprice").withColumns({c: F.round(c, n) for c, n in digits.items()})


_FLAGS = ("A", "N", "R")
_BY_FLAG = """g AS (SELECT l_returnflag AS f, count(*) AS n, regr_slope(y, q) AS b, regr_intercept(y, q) AS a, regr_sxx(y, q) AS sxx, regr_sxy(y, q) AS sxy, regr_syy(y, q) AS syy, avg(q) AS mq FROM r GROUP BY 1),
s AS (SELECT sum(syy - sxy * sxy / sxx) / (sum(n) - 6) AS s2, sum(n) - 6 AS free FROM g), v AS (SELECT *, s2 * (1 / n + mq * mq / sxx) AS va, s2 / sxx AS vb FROM g, s)"""
_PRICE_ROWS = "r AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS y FROM lineitem)"


def _contrast_rows() -> str:
    """(contrast, term, part, f, w): each coefficient as a weighted sum of the flags' own intercepts (part a) and slopes (b)."""
    rows = []
    for part, alone, name in (("a", "(intercept)", "l_returnflag[{}]"), ("b", "l_quantity", "l_quantity:l_returnflag[{}]")):
        rows += [("treatment", alone, part, "A", 1.0), *[("sum", alone, part, f, 1 / 3) for f in _FLAGS]]
        for own in _FLAGS[1:]:
            rows += [("treatment", name.format(own), part, own, 1.0), ("treatment", name.format(own), part, "A", -1.0)]
        for own in _FLAGS[:-1]:
            rows += [("sum", name.format(own), part, f, (f == own) - 1 / 3) for f in _FLAGS]
    return ", ".join(str(r) for r in rows)


def _priced(t: Tables, contrasts: str) -> design.Fit:
    terms = [("l_quantity",), ("l_returnflag",), ("l_quantity", "l_returnflag")]
    return design.fit_design(t.lineitem, design.Design(terms, design.factor_levels(t.lineitem, ["l_returnflag"]), contrasts), "l_extendedprice")


@query(f"""WITH {_PRICE_ROWS}, {_BY_FLAG}, c(contrast, term, part, f, w) AS (VALUES {_contrast_rows()})
SELECT contrast, term, round(sum(w * CASE part WHEN 'a' THEN a ELSE b END), 2) AS estimate, round(sqrt(sum(w * w * CASE part WHEN 'a' THEN va ELSE vb END)), 3) AS se FROM c JOIN v USING (f) GROUP BY ALL""")
def contrast_effects(t: Tables) -> DataFrame:
    found = [design.effects_table(t.spark, _priced(t, c)).select(F.lit(c).alias("contrast"), "term", F.round("estimate", 2).alias("estimate"), F.round("se", 3).alias("se")) for c in design.CONTRASTS]
    return found[0].union(found[1])


@query(f"""WITH {_PRICE_ROWS}, {_BY_FLAG}, m AS (SELECT sum(a / va) / sum(1 / va) AS ma, sum(b / vb) / sum(1 / vb) AS mb FROM v),
one AS (SELECT regr_syy(y, q) - regr_sxy(y, q) * regr_sxy(y, q) / regr_sxx(y, q) AS rss FROM r), two AS (SELECT sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) AS rss, sum(sxy) * sum(sxy) / sum(sxx) AS ss FROM g),
t AS (SELECT 3 AS anova_type, '(intercept)' AS term, power(sum(a), 2) / sum(va) AS chi2, 1 AS df FROM v UNION ALL SELECT 3, 'l_quantity', power(sum(b), 2) / sum(vb), 1 FROM v UNION ALL SELECT 3, 'l_returnflag', sum(power(a - ma, 2) / va), 2 FROM v, m
  UNION ALL SELECT k, 'l_quantity:l_returnflag', sum(power(b - mb, 2) / vb), 2 FROM v, m, (VALUES (2), (3)) x(k) GROUP BY k UNION ALL SELECT 2, 'l_quantity', ss / s2, 1 FROM two, s UNION ALL SELECT 2, 'l_returnflag', (one.rss - two.rss) / s2, 2 FROM one, two, s)
SELECT anova_type, term, round(chi2, 2) AS chi2, df, round(chi2 / df, 2) AS f, free::BIGINT AS residual_df, chi2 > CASE df WHEN 1 THEN 3.841458820694124 ELSE 5.991464547107979 END AS rejected FROM t, s""")
def anova_types(t: Tables) -> DataFrame:
    fit = _priced(t, "sum")
    found = design.term_tests(t.spark, fit, 2).union(design.term_tests(t.spark, fit, 3))
    return found.select("anova_type", "term", F.round("chi2", 2).alias("chi2"), "df", F.round("f", 2).alias("f"), "residual_df", (F.col("p_value") < 0.05).alias("rejected"))


@query(f"""WITH r AS (SELECT l_returnflag, l_quantity AS q, CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END AS y FROM lineitem), {_BY_FLAG},
p AS (SELECT f, x, a + b * x AS eta, sqrt(s2 * (1 / n + power(x - mq, 2) / sxx)) AS se FROM v, (VALUES (1.0), (25.5), (50.0)) q(x))
SELECT f AS l_returnflag, x::DOUBLE AS l_quantity, round(exp(eta), 2) AS fit, round(se, 6) AS se, round(exp(eta - 1.96 * se), 2) AS low, round(exp(eta + 1.96 * se), 2) AS high FROM p""")
def model_intervals(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_returnflag", fage.transform_response(F.col("l_extendedprice"), "log").alias("logged"))
    made = design.Design([("l_quantity",), ("l_returnflag",), ("l_quantity", "l_returnflag")], design.factor_levels(rows, ["l_returnflag"]), "sum")
    grid = t.spark.createDataFrame([(f, x) for f in made.levels["l_returnflag"] for x in (1.0, 25.5, 50.0)], "l_returnflag string, l_quantity double")
    found = design.predict(grid, design.fit_design(rows, made, "logged"), lambda c: fage.inverse_response(c, "log"))
    return found.select("l_returnflag", "l_quantity", *[F.round(c, d).alias(c) for c, d in (("fit", 2), ("se", 6), ("low", 2), ("high", 2))])


@query("""WITH g AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1), p AS (SELECT sum(power(l_extendedprice / mu - 1, 2)) / (count(*) - 3) AS phi FROM lineitem JOIN g ON l_returnflag = f)
SELECT CASE WHEN g.f = 'A' THEN '(intercept)' ELSE 'l_returnflag[' || g.f || ']' END AS term, round(CASE WHEN g.f = 'A' THEN ln(g.mu) ELSE ln(g.mu / b.mu) END, 6) AS estimate, round(sqrt(phi * (1 / g.n + CASE WHEN g.f = 'A' THEN 0 ELSE 1 / b.n END)), 6) AS se, round(phi, 6) AS dispersion FROM g, p, (SELECT * FROM g WHERE f = 'A') b""")
def gamma_factors(t: Tables) -> DataFrame:
    made = design.Design([("l_returnflag",)], design.factor_levels(t.lineitem, ["l_returnflag"]))
    found = design.effects_table(t.spark, design.fit_design(t.lineitem, made, "l_extendedprice", "gamma"))
    return rounded(found.select("term", "estimate", "se", "dispersion"))


@query()
def gamma_effects(t: Tables) -> DataFrame:
    return design.effects_table(t.spark, design.fit_design(t.lineitem, design.Design([("l_quantity",), ("l_discount",)]), "l_extendedprice", "gamma"))


@query()
def random_intercept(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return models.fit_random_intercept(joined.withColumn("y", F.col("o_totalprice") / 1e5).withColumn("bal", F.col("c_acctbal") / 1e4), ["bal"], "y", "c_nationkey")


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.withColumn("y", F.col("o_totalprice") / 1e5).withColumn("bal", F.col("c_acctbal") / 1e4)
    return models.bootstrap_ci(rows, ["bal"], "y", "c_nationkey", [{"bal": b} for b in (0.0, 0.5, 1.0)], nsim=100)


@query("WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(i + s * l_quantity, 2) AS fitted, round(l_extendedprice - (i + s * l_quantity), 2) AS residual FROM lineitem, b")
def residual_table(t: Tables) -> DataFrame:
    effects = models.fit_linear(t.lineitem, ["l_quantity"], "l_extendedprice")
    return models.residual_table(t.lineitem, effects, ["l_quantity"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.round("fitted", 2).alias("fitted"), F.round("residual", 2).alias("residual"))


@query(f"WITH l AS ({_LINE}), r AS (SELECT l_quantity, l_extendedprice - (a + b * l_quantity) AS e FROM lineitem, l) SELECT count(e) AS n, round(sqrt(avg(e * e)), 3) AS rmse, round(count(e) * regr_r2(e * e, l_quantity), 3) AS chi2, count(e) * regr_r2(e * e, l_quantity) > 3.841458820694124 AS rejected FROM r")
def diagnostics(t: Tables) -> DataFrame:
    effects = models.fit_linear(t.lineitem, ["l_quantity"], "l_extendedprice")
    found = models.diagnostic_summary(models.residual_table(t.lineitem, effects, ["l_quantity"], "l_extendedprice"), ["l_quantity"])
    return found.select("n", F.round("rmse", 3).alias("rmse"), F.round("chi2", 3).alias("chi2"), (F.col("p_value") < 0.05).alias("rejected"))


@query(f"""WITH l AS ({_LINE}), r AS (SELECT a + b * l_quantity AS f, power(l_extendedprice - (a + b * l_quantity), 2) AS e2, left_over / (n - 2) AS s2 FROM lineitem, l), t AS (SELECT count(*) AS n, any_value(s2) AS s2, count(*) * power(covar_pop(e2, f), 2) / var_pop(f) / power(avg(e2), 2) / 2 AS chi2 FROM r)
SELECT 'lm' AS model_class, n, NULL::BOOLEAN AS singular_fit, NULL::BOOLEAN AS converged, round(s2, 2) AS sigma2, round(chi2, 3) AS chi2, chi2 > 3.841458820694124 AS rejected FROM t""")
def linear_flags(t: Tables) -> DataFrame:
    found = models.linear_flags(t.lineitem, ["l_quantity"], "l_extendedprice")
    return found.select("model_class", "n", "singular_fit", "converged", F.round("sigma2", 2).alias("sigma2"), F.round("heteroscedasticity_chi2", 3).alias("chi2"), (F.col("heteroscedasticity_p") < 0.05).alias("rejected"))


@query()
def mixed_flags(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return models.mixed_flags(joined.withColumn("y", F.col("o_totalprice") / 1e5).withColumn("bal", F.col("c_acctbal") / 1e4), ["bal"], "y", "c_nationkey")


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS run_id, count(*) AS n, round(sum(value), 6) AS sec FROM events GROUP BY user_id")
def resumed_backend(t: Tables) -> DataFrame:
    """Recordings of even users are classified first; the run over all of them does the rest."""
    root = f"{shared_dir(t.spark).rstrip('/')}/backends-{uuid.uuid4().hex}"
    made = backends.Backend("summary", ("summary",), lambda e: {"summary": e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("sec"))}, "user_id")
    backends.run_backend(t.events.where("user_id % 2 = 0"), root, made, "first")
    backends.run_backend(t.events, root, made, "second")
    found = backends.read_output(t.spark, root, made, "summary")
    return rounded(found.select(F.col("user_id").cast("long").alias("user_id"), "run_id", "n", "sec"))


_SHARES = [(i + 0.5) / 100 for i in range(100)]


@query(f"WITH l AS ({_LINE}), r AS (SELECT quantile_cont(l_extendedprice - (a + b * l_quantity), {_SHARES}) AS q FROM lineitem, l) SELECT round(unnest({[NormalDist().inv_cdf(s) for s in _SHARES]}), 5) AS normal, round(unnest(q), 2) AS sample FROM r")
def qq_points(t: Tables) -> DataFrame:
    effects = models.fit_linear(t.lineitem, ["l_quantity"], "l_extendedprice")
    found = models.qq_points(models.residual_table(t.lineitem, effects, ["l_quantity"], "l_extendedprice"), "residual", 100)
    return found.select(F.round("normal", 5).alias("normal"), F.round("sample", 2).alias("sample"))


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem), d AS (SELECT (1 - c * c) / (1 + 2 * a * b * c - a * a - b * b - c * c) AS g FROM r)
SELECT 'quantity' AS term, round(g, 6) AS gvif, round(sqrt(g), 6) AS adjusted, false AS rank_deficient FROM d UNION ALL SELECT 'price', round(g, 6), round(power(g, 0.25), 6), false FROM d""")
def gvif(t: Tables) -> DataFrame:
    return rounded(models.gvif_table(t.lineitem, {"quantity": ["l_quantity"], "price": ["l_extendedprice", "l_tax"]}))


_S = ", ".join(f"covar_pop({x}, {y}) * count(*) AS {n}" for n, (x, y) in {"a": ("q", "q"), "b": ("q", "d"), "c": ("q", "t"), "d": ("d", "d"), "e": ("d", "t"), "f": ("t", "t"), "g": ("q", "p"), "h": ("d", "p"), "i": ("t", "p"), "y": ("p", "p")}.items())


@query(f"""WITH s AS (SELECT {_S}, count(*) AS n FROM (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS p FROM lineitem)),
x AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
v AS (SELECT n, y - (g * g * (d * f - e * e) + h * h * (a * f - c * c) + i * i * (a * d - b * b) + 2 * (g * h * (c * e - b * f) + g * i * (b * e - c * d) + h * i * (b * c - a * e))) / det AS rss,
  y - (h * h * f - 2 * h * i * e + i * i * d) / (d * f - e * e) AS without_q, y - g * g / a AS without_r FROM x),
w AS (SELECT 'quantity' AS term, (without_q - rss) / (rss / (n - 4)) AS chi2, 1 AS df, n FROM v UNION ALL SELECT 'rates', (without_r - rss) / (rss / (n - 4)), 2, n FROM v)
SELECT term, round(chi2, 2) AS chi2, df, round(chi2 / df, 2) AS f, n - 4 AS residual_df, chi2 > CASE df WHEN 1 THEN 3.841458820694124 ELSE 5.991464547107979 END AS rejected FROM w""")
def anova(t: Tables) -> DataFrame:
    found = models.wald_anova(t.lineitem, {"quantity": ["l_quantity"], "rates": ["l_discount", "l_tax"]}, "l_extendedprice")
    return found.select("term", F.round("chi2", 2).alias("chi2"), "df", F.round("f", 2).alias("f"), "residual_df", (F.col("p_value") < 0.05).alias("rejected"))


@query("SELECT i AS point, round(lo + (hi - lo) * i / 59, 6) AS l_quantity, s AS speaker, m AS l_returnflag FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC LIMIT 1) AS m FROM lineitem), unnest(range(60)) r(i), unnest(['a', 'b']) q(s)")
def prediction_grid(t: Tables) -> DataFrame:
    grid = models.prediction_grid(t.lineitem, "l_quantity", 60, "speaker", ["a", "b"], {"l_returnflag": "mode"})
    lo = t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    point = F.round((F.col("l_quantity") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 59).cast("long")
    return rounded(grid.crossJoin(F.broadcast(lo)).select(point.alias("point"), "l_quantity", "speaker", "l_returnflag"))


_ALL = "coalesce(bool_and({}), true)"
_OFF, _SAME, _STRONG = _ALL.format("low > 0 OR high < 0"), _ALL.format("estimate > 0"), _ALL.format("abs(estimate / se) >= 2.5")


@query(f"""WITH e AS (SELECT p_type, avg(p_retailprice) - 1450 AS estimate, stddev_samp(p_retailprice) / sqrt(count(*)) AS se FROM part GROUP BY p_type, p_brand), f AS (SELECT *, estimate - 1.96 * se AS low, estimate + 1.96 * se AS high FROM e)
SELECT p_type, CASE WHEN {_SAME} AND {_OFF} AND {_STRONG} THEN 'Strong evidence supporting the hypothesis' WHEN {_SAME} AND {_OFF} THEN 'Moderate evidence supporting the hypothesis' WHEN {_SAME} THEN 'Weak evidence supporting the hypothesis' WHEN {_OFF} THEN 'Evidence inconsistent with the hypothesis' ELSE 'Inconclusive evidence' END AS category FROM f GROUP BY p_type""")
def evidence(t: Tables) -> DataFrame:
    effects = t.part.groupBy("p_type", "p_brand").agg((F.avg("p_retailprice") - 1450).alias("estimate"), (F.stddev_samp("p_retailprice") / F.sqrt(F.count("*"))).alias("se"))
    return models.evidence(models.interval(effects, F.col("estimate"), F.col("se")), "p_type")


# --- lookups, dictionaries, reports ------------------------------------------------


@query("SELECT o_orderkey, trim(o_orderstatus) AS o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS meaning FROM orders")
def attach_lookup(t: Tables) -> DataFrame:
    lookup = t.spark.createDataFrame([("F", "filled"), ("O", "open")], "o_orderstatus string, meaning string")
    padded = t.orders.select("o_orderkey", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("o_orderstatus"))
    return joins.attach_lookup(padded, lookup, "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment, n_group FROM customer JOIN (SELECT c_mktsegment, count(*) AS n_group FROM customer GROUP BY 1) USING (c_mktsegment)")
def augment_group_counts(t: Tables) -> DataFrame:
    return joins.augment_group_counts(t.customer.select("c_custkey", "c_mktsegment"), t.customer, "c_mktsegment")


@query("""WITH e AS (SELECT p_type AS k, CASE WHEN avg(p_retailprice) > 1450 THEN 'Strong evidence' ELSE 'Weak evidence' END AS category FROM part GROUP BY 1), q AS (SELECT p_brand AS question, unnest(list(DISTINCT p_type) || ['none']) AS k FROM part WHERE p_size < 3 GROUP BY 1)
SELECT question, string_agg(DISTINCT q.k, '; ' ORDER BY q.k) AS responses, coalesce(string_agg(DISTINCT category, '; ' ORDER BY category), 'Inconclusive evidence') AS category FROM q LEFT JOIN e USING (k) GROUP BY question""")
def link_questions(t: Tables) -> DataFrame:
    found = t.part.groupBy(F.col("p_type").alias("response_key")).agg(F.when(F.avg("p_retailprice") > 1450, "Strong evidence").otherwise("Weak evidence").alias("category"))
    asked = t.part.where("p_size < 3").groupBy(F.col("p_brand").alias("question")).agg(F.concat(F.collect_set("p_type"), F.array(F.lit("none"))).alias("response_keys"))
    return joins.link_questions(asked, found)


@query("SELECT p_type AS term, round(avg(p_retailprice), 6) AS estimate, CASE WHEN count(*) > 300 THEN count(*) ELSE min(p_size) END AS df, CASE WHEN count(*) > 300 THEN 0.5 ELSE 0.25 END AS p_value FROM part GROUP BY 1")
def term_stats_join(t: Tables) -> DataFrame:
    big = F.count("*") > 300
    effects = t.part.groupBy(F.col("p_type").alias("term")).agg(F.avg("p_retailprice").alias("estimate"), F.when(big, F.count("*")).alias("df"), F.when(big, 0.5).alias("p_value"))
    stats = t.part.groupBy(F.col("p_type").alias("term")).agg(F.min("p_size").cast("long").alias("df"), F.lit(0.25).alias("p_value"))
    return rounded(joins.term_stats_join(effects, stats).select("term", "estimate", "df", "p_value"))


@query(f"WITH s AS (SELECT conv_id, sum(CASE response WHEN '' THEN 0 ELSE 1 END)::BIGINT AS total_understand, sum(CASE WHEN response = 'समझता/समझती है और कहता/कहती है' THEN 1 ELSE 0 END)::BIGINT AS total_produce, count(*) >= 4 AS whole FROM {_TURNS} GROUP BY conv_id) SELECT conv_id, total_understand, total_produce, whole, total_understand > 1 AS included FROM s")
def participant_analysis(t: Tables) -> DataFrame:
    scored = _responses(t).select("conv_id", ftext.score_response(F.col("response"), 1).alias("s")).select("conv_id", "s.*")
    totals = items.score_totals(scored, ["conv_id"])
    whole = t.conversations.groupBy("conv_id").agg((F.count("*") >= 4).alias("whole"))
    chosen = totals.select("conv_id", (F.col("total_understand") > 1).alias("included"))
    return items.participant_analysis(chosen, totals, whole, "conv_id").select("conv_id", "total_understand", "total_produce", "whole", "included")


@query("SELECT DISTINCT p_brand, p_type, p_name, p_name || ' / ' || p_type AS label FROM part")
def distinct_options(t: Tables) -> DataFrame:
    return reshape.distinct_options(t.part, "p_brand", "p_type", "p_name").select("p_brand", "p_type", "p_name", "label")


@query("SELECT p_size, count(*) AS n FROM part WHERE p_type = 'ECONOMY' AND p_retailprice >= 900 GROUP BY 1")
def items_n_by_age(t: Tables) -> DataFrame:
    return items.items_n_by_age(t.part.withColumn("inc", F.col("p_retailprice") >= 900), "p_type", "ECONOMY", "p_size", "inc")


@query("""WITH d AS (SELECT DISTINCT length(n_name) AS item_id, ' ' || lower(n_name) AS raw FROM nation), o AS (SELECT lower(n_name) AS col FROM nation WHERE n_regionkey > 0 UNION SELECT lower(r_name) FROM region)
SELECT 'duplicate_item_id' AS issue, CAST(item_id AS VARCHAR) AS value FROM d GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT 'observed_not_mapped', col FROM o WHERE col NOT IN (SELECT trim(raw) FROM d) UNION ALL SELECT 'mapped_not_observed', CAST(item_id AS VARCHAR) FROM d WHERE trim(raw) NOT IN (SELECT col FROM o) UNION ALL SELECT 'normalization_only_match', col FROM d JOIN o ON trim(raw) = col""")
def dictionary_validation(t: Tables) -> DataFrame:
    dictionary = t.nation.select(F.length("n_name").alias("item_id"), F.concat(F.lit(" "), F.lower("n_name")).alias("raw_column")).distinct()
    observed = t.nation.where("n_regionkey > 0").select(F.lower("n_name").alias("column")).union(t.region.select(F.lower("r_name"))).distinct()
    return items.dictionary_validation(dictionary, observed)


@query("SELECT n_name, CAST(regexp_replace(n_name, '[^0-9]', '', 'g') AS INT) AS item_id, (contains(c, '8_18'))::INT AS in_8_18, (contains(c, '19_36'))::INT AS in_19_36, CASE WHEN n_regionkey > 0 THEN n_nationkey END AS position_one FROM (SELECT *, CASE WHEN n_regionkey = 1 THEN '8_18' ELSE '8_18, 19_36' END AS c FROM nation)")
def build_dictionary(t: Tables) -> DataFrame:
    listed = t.nation.select("n_name", "n_regionkey", F.when(F.col("n_regionkey") == 1, "8_18").otherwise("8_18, 19_36").alias("forms"))
    columns = t.nation.where("n_regionkey > 0").select(F.col("n_name").alias("column"), F.col("n_nationkey").alias("position"))
    return items.build_dictionary(listed, {"one": columns}, "n_name", "n_name", "forms", "n_name").select("n_name", "item_id", "in_8_18", "in_19_36", "position_one")


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
def subset_violations(t: Tables) -> DataFrame:
    return quality.subset_violations(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), "l_discount", "l_tax")


@query("SELECT count(*) AS n_rows, count(*) FILTER (p_brand = 'Brand#13') AS z_off, count(*) FILTER (p_size <> 10) AS square_off FROM part")
def grid_contract(t: Tables) -> DataFrame:
    moved = F.when(F.col("p_brand") == "Brand#13", 0.001).otherwise(0.0)  # a grid of which a brand's rows are off
    grid = t.part.select("p_size", ((F.col("p_size") - 10) / 2.0 + moved).alias("z"), F.lit(0.0).alias("z2"))
    return quality.grid_contract(grid, "p_size", "z", "z2", 10.0, 2.0)


@query("SELECT event_id, label, value FROM (SELECT event_id, 'main' AS label, value FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'child', value FROM events WHERE event_type = 'signup')")
def union_tiers(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", "value")
    return reshape.union_tiers({"main": e.where("event_type IN ('click', 'view')"), "child": e.where("event_type = 'signup'")}).select("event_id", "label", "value")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS segment_index FROM events")
def segment_index(t: Tables) -> DataFrame:
    return ids.segment_index(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT p_brand, count(x) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, count(*) FILTER (x = 0) AS zeros, bool_and(x > 0) AS positive_only FROM (SELECT p_brand, p_retailprice - 1000 AS x FROM part) GROUP BY 1")
def response_metrics(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", (F.col("p_retailprice") - 1000).alias("x"))
    return rounded(profile.response_metrics(rows, "x", ["p_brand"]).drop("skewness"))


@query("SELECT 'family_' || (CASE WHEN p_type LIKE '%O%' THEN 1 ELSE 2 END) AS family, p_type AS term, round(avg(p_retailprice), 6) AS estimate FROM part GROUP BY p_type")
def focal_effects(t: Tables) -> DataFrame:
    effects = t.part.groupBy(F.col("p_type").alias("term")).agg(F.avg("p_retailprice").alias("estimate"))
    rules = t.spark.createDataFrame([("family_1", "O"), ("family_2", "^[^O]*$")], "family string, pattern string")
    return rounded(models.focal_effects(effects, rules).select("family", "term", "estimate"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 9) AS logged, round(ln(1 + o_totalprice), 9) AS logged1, round(o_totalprice, 4) AS back FROM orders WHERE o_totalprice > 0")
def transform_response(t: Tables) -> DataFrame:
    x = F.col("o_totalprice")
    logged = fage.transform_response(x, "log")
    return t.orders.where("o_totalprice > 0").select("o_orderkey", F.round(logged, 9).alias("logged"), F.round(fage.transform_response(x, "log1p"), 9).alias("logged1"), F.round(fage.inverse_response(logged, "log"), 4).alias("back"))


@query("""SELECT "check", same, detail FROM (VALUES ('columns', true, '6 | 6'), ('order', false, ''), ('only_a', false, 'o_orderstatus'), ('only_b', false, 'state')) v("check", same, detail) UNION ALL SELECT 'rows', count(*) = count(*) FILTER (o_orderstatus <> 'P'), concat_ws(' | ', count(*), count(*) FILTER (o_orderstatus <> 'P')) FROM orders""")
def compare_variants(t: Tables) -> DataFrame:
    from segflow.sources.files import compare_variants

    return compare_variants(t.orders, t.orders.where("o_orderstatus <> 'P'").withColumnRenamed("o_orderstatus", "state"))


@query("""WITH f AS (SELECT DISTINCT source || (CASE WHEN lang = 'en' THEN '.txt' ELSE '.csv' END) AS file, lang AS role FROM documents) SELECT role, min_by(file, (CASE WHEN file LIKE '%.txt' THEN 2 ELSE 3 END, file)) AS file FROM f GROUP BY role""")
def load_roles(t: Tables) -> DataFrame:
    detected = t.documents.select(F.concat("source", F.when(F.col("lang") == "en", ".txt").otherwise(".csv")).alias("file"), F.col("lang").alias("role")).distinct()
    return forms.load_roles(detected)


@query("SELECT role, coalesce(files, 0) AS files, coalesce(ambiguous, 0) AS ambiguous FROM (SELECT unnest(['en', 'de', 'xx']) AS role) LEFT JOIN (SELECT lang AS role, count(*) AS files, count(*) FILTER (n_chars > 2000) AS ambiguous FROM documents GROUP BY 1) USING (role)")
def role_coverage(t: Tables) -> DataFrame:
    required = t.spark.createDataFrame([("en",), ("de",), ("xx",)], "role string")
    return quality.role_coverage(required, t.documents.select(F.col("lang").alias("role"), (F.col("n_chars") > 2000).alias("is_ambiguous")))


@query("WITH c AS (SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) SELECT * FROM c")
def dedup_first(t: Tables) -> DataFrame:
    return items.dedup_first(t.events.select("user_id", "event_type", "value", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, event_type, count(*) AS count, round(sum(value), 6) AS duration_sec FROM events GROUP BY ALL")
def windowed_class_summary(t: Tables) -> DataFrame:
    from segflow.streaming.segments import windowed_class_summary

    return rounded(windowed_class_summary(t.events, "ts", ["user_id"], "event_type", "value"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity >= 40 THEN '[40,inf)' WHEN l_quantity >= 20 THEN '[20,40)' ELSE '[0,20)' END AS bin, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS level FROM lineitem")
def bins_and_levels(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", fage.bin_label(F.col("l_quantity"), [0.0, 20.0, 40.0]).alias("bin"), fage.ordered_level(F.col("l_returnflag"), ["A", "N", "R"]).alias("level"))


@query("SELECT c_custkey AS participant, c_name AS contact FROM customer WHERE c_acctbal > 0")
def included_contacts(t: Tables) -> DataFrame:
    return forms.included_contacts(t.customer.withColumn("inc", F.col("c_acctbal") > 0), "inc", {"c_custkey": "participant", "c_name": "contact"})


@query("SELECT c_custkey AS participant_id, c_mktsegment AS \"Location\" FROM customer")
def participant_summary(t: Tables) -> DataFrame:
    return cohort.participant_summary(t.customer.select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("Location"), "c_acctbal"))


_RULES = [("click", 1, 7, "click"), ("click", 1, 7, "view"), ("error", 2, 13, "error"), ("error", 2, 13, "purchase"), ("error", 2, 13, "signup")]


@query(f"""WITH c AS (SELECT DISTINCT 'u-' || user_id || '.csv' AS file, event_type AS "column" FROM events WHERE value > 50), rules(role, role_order, form_id, "column") AS (VALUES {", ".join(map(str, _RULES))}),
s AS (SELECT c.file, role, role_order, count(r."column") + CASE WHEN regexp_extract(c.file, 'u-([0-9]+)', 1) = CAST(form_id AS VARCHAR) THEN 100 ELSE 0 END AS score FROM c CROSS JOIN (SELECT DISTINCT role, role_order, form_id FROM rules) k LEFT JOIN rules r USING (role, role_order, form_id, "column") GROUP BY c.file, role, role_order, form_id),
best AS (SELECT *, count(*) OVER (PARTITION BY file, score) > 1 AS tied FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, role_order DESC) = 1), n AS (SELECT file, count(*) AS n_columns FROM c GROUP BY 1), e AS (SELECT 'u-' || user_id || '.csv' AS file, count(*) AS n_rows FROM events GROUP BY 1)
SELECT file, n_columns, coalesce(role, 'unknown') AS role, coalesce(score, 0)::INT AS score, coalesce(tied, false) AS is_ambiguous, n_rows FROM n LEFT JOIN best USING (file) LEFT JOIN e USING (file)""")
def detection_report(t: Tables) -> DataFrame:
    """Users' recordings as files, the classes of their longer segments as columns; roles are detected, then reported."""
    file = F.concat(F.lit("u-"), "user_id", F.lit(".csv")).alias("file")
    columns = t.events.where("value > 50").select(file, F.col("event_type").alias("column")).distinct()
    detected = forms.detect_form_role(columns, t.spark.createDataFrame(_RULES, "role string, role_order int, form_id int, column string"))
    rows = t.events.groupBy(file).agg(F.count("*").alias("n_rows"))
    return forms.detection_report(columns, detected, rows).select("file", "n_columns", "role", F.col("score").cast("int").alias("score"), "is_ambiguous", "n_rows")


# --- columns, filters, small tables ------------------------------------------------


@query("SELECT n_nationkey AS key, n_name AS role FROM nation")
def select_and_rename(t: Tables) -> DataFrame:
    kept = reshape.select_available(quality.require_columns(t.nation, "nation", ["n_nationkey", "n_name"]), ["n_nationkey", "absent", "n_name"])
    return reshape.rename_roles(kept, {"n_nationkey": "key", "n_name": "role", "gone": "x"})


@query("SELECT event_id, value FROM events WHERE value >= 50")
def confidence_filter(t: Tables) -> DataFrame:
    return reshape.confidence_filter(reshape.confidence_filter(t.events.select("event_id", "value"), 50.0, "value"), 1.0, "absent")


@query("SELECT conv_id, turn, role AS label FROM conversations WHERE role <> 'user'")
def blank_label_filter(t: Tables) -> DataFrame:
    label = F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, "  ")).otherwise(F.col("role"))
    return reshape.blank_label_filter(t.conversations.select("conv_id", "turn", label.alias("label")), "label")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'")
def complete_cases(t: Tables) -> DataFrame:
    holes = {c: F.nullif(F.col(c), F.lit(v)).alias(c) for c, v in (("o_orderpriority", "5-LOW"), ("o_orderstatus", "P"))}
    return reshape.complete_cases(t.orders.select("o_orderkey", *holes.values()), list(holes))


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS raw_column, {c} AS raw_response FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def to_long_items(t: Tables) -> DataFrame:
    return reshape.to_long_items(t.orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders")
def final_projection(t: Tables) -> DataFrame:
    return reshape.final_projection(t.orders, ["o_orderkey", "o_orderdate", "o_totalprice"], ("o_orderdate",))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 3000")
def included_rows(t: Tables) -> DataFrame:
    flag = F.when(F.col("c_acctbal") > 3000, True).when(F.col("c_acctbal") > 0, False)
    return norms.included_rows(t.customer.withColumn("included_final", flag)).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def select_form(t: Tables) -> DataFrame:
    return reshape.select_form(t.orders, "F", "o_orderstatus").select("o_orderkey", "o_totalprice")


@query("WITH i AS (SELECT o_custkey, 'P' || lpad(CAST(row_number() OVER (ORDER BY min(o_orderdate), min_by(o_orderkey, (o_orderdate, o_orderkey)), o_custkey) AS VARCHAR), 6, '0') AS participant_id FROM orders GROUP BY o_custkey) SELECT participant_id, o_orderkey, o_custkey FROM orders JOIN i USING (o_custkey)")
def crosswalk(t: Tables) -> DataFrame:
    found = ids.first_seen_ids(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return ids.crosswalk(t.orders.join(found, "o_custkey"), "participant_id", ["o_orderkey", "o_custkey"])


_MASTER = ", ".join(f"CASE WHEN s.user_id IS NOT NULL THEN coalesce(n_{c}, 0) END::DOUBLE AS {c}_count, round(CASE WHEN s.user_id IS NOT NULL THEN coalesce(d_{c}, 0) END, 6) AS {c}_duration_sec, round(CASE WHEN s.user_id IS NOT NULL AND hours > 0 THEN coalesce(n_{c}, 0) / hours END, 6) AS {c}_count_hour, round(CASE WHEN s.user_id IS NOT NULL AND hours > 0 THEN coalesce(d_{c}, 0) / hours END, 6) AS {c}_duration_hour" for c in CLASSES)


@query(f"""WITH s AS (SELECT user_id, {_SUMS} FROM events WHERE user_id % 3 <> 0 GROUP BY user_id), h AS (SELECT user_id, sum(value) / 3600 AS hours FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS d FROM customer WHERE c_acctbal >= 0)
SELECT c.c_custkey AS user_id, c_mktsegment, c_acctbal, round(hours, 6) AS hours, CASE WHEN h.user_id IS NOT NULL THEN s.user_id IS NOT NULL END AS matched, {_MASTER}, round((c_acctbal - a) / d, 6) AS c_acctbal_z, round(((c_acctbal - a) / d) * ((c_acctbal - a) / d), 6) AS c_acctbal_z2
FROM customer c LEFT JOIN h ON h.user_id = c.c_custkey LEFT JOIN s ON s.user_id = h.user_id, m""")
def master_table(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_acctbal")
    hours = t.events.where("user_id % 5 <> 0").groupBy("user_id").agg(reshape.seconds_to_hours(F.sum("value")).alias("hours"))
    return rounded(cohort_plan.master_table(people, hours, t.events.where("user_id % 3 <> 0"), "user_id", "event_type", "value", CLASSES, "c_acctbal"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS raw_column, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS item_id FROM lineitem")
def item_dimension_join(t: Tables) -> DataFrame:
    dictionary = t.lineitem.where("l_returnflag <> 'N'").select(F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("raw_column"), F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("item_id")).distinct()
    return items.item_dimension_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("raw_column")), dictionary)


@query("SELECT max(c_acctbal) AS max_score FROM customer")
def max_score(t: Tables) -> DataFrame:
    return norms.max_score(t.customer, "c_acctbal")


@query("WITH m AS (SELECT avg(p_retailprice) AS a, stddev_samp(p_retailprice) AS s FROM part) SELECT p_partkey, round((p_retailprice - a) / s, 6) AS price_z, round(power((p_retailprice - a) / s, 2), 6) AS price_z2, round(p_retailprice, 6) AS price FROM part, m")
def age_rescale(t: Tables) -> DataFrame:
    """Scores by the sample deviation, and back by the moments that made them."""
    one = t.part.agg(F.avg("p_retailprice").alias("a"), F.stddev_samp("p_retailprice").alias("s")).first()
    scaled = cohort.zscore(t.part, "p_retailprice", ddof=1, name="price_z")
    return rounded(scaled.select("p_partkey", "price_z", "price_z2", cohort.unscale(F.col("price_z"), one["a"], one["s"]).alias("price")))


@query("SELECT n_nationkey AS key, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_regionkey FROM region")
def union_by_name(t: Tables) -> DataFrame:
    return reshape.union_by_name(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("region"), F.col("r_regionkey").alias("key")))


_RAW = "CASE event_id % 6 WHEN 0 THEN ' FEM' WHEN 1 THEN 'mal ' WHEN 2 THEN 'KCHI' WHEN 3 THEN 'child ' WHEN 4 THEN ' noise' ELSE 'OCH' END"


@query(f"""WITH e AS (SELECT event_id, trim({_RAW}) AS raw FROM events), c AS (SELECT unnest(['FEM', 'MAL', 'KCHI', 'OCH']) AS code, unnest(['adult_female', 'adult_male', 'key_child', 'other_child']) AS class)
SELECT event_id, coalesce(x.class, lower(raw)) AS vtc, CASE raw WHEN 'child' THEN 'key_child' WHEN 'noise' THEN 'background' ELSE raw END AS xgb, y.class AS any_case FROM e LEFT JOIN c x ON raw = x.code LEFT JOIN c y ON upper(raw) = y.code""")
def normalize_labels(t: Tables) -> DataFrame:
    raw = F.expr(_RAW)
    return t.events.select("event_id", ftext.normalize_label(raw, "vtc").alias("vtc"), ftext.normalize_label(raw, "xgb").alias("xgb"), ftext.normalize_vtc_label(raw).alias("any_case"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS participant_id, 'unknown_label' AS issue_type, 'unknown label ' || {_RAW} AS message FROM events WHERE upper(trim({_RAW})) NOT IN ('FEM', 'MAL', 'KCHI', 'OCH')")
def unknown_labels(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", F.expr(_RAW).alias("raw"))
    return quality.unknown_labels(raw, "event_id", "raw", ftext.normalize_vtc_label(F.col("raw")))


@query("SELECT conv_id, turn FROM conversations WHERE role NOT IN ('user', 'assistant') OR length(text) % 3 = 0")
def unknown_responses(t: Tables) -> DataFrame:
    answer = F.when(F.length("text") % 3 == 0, "?").when(F.col("role") == "user", ftext.SAYS).when(F.col("role") == "assistant", "").otherwise("!")
    scored = t.conversations.select("conv_id", "turn", ftext.score_response(answer, 1).alias("s")).select("conv_id", "turn", "s.unknown")
    return items.unknown_responses(scored).drop("unknown")


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_label_nfc(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ftext.unicode_fixed(F.col("text"), "NFC", unescape=False).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 < 2 THEN date_trunc('minute', o_orderdate) END AS minute FROM orders")
def parse_dates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    forms_of_day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("session_a")
    minute = F.date_trunc("minute", "o_orderdate")
    stamps = F.when(k == 0, F.date_format(minute, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(minute, "dd/MM/yyyy HH:mm")).otherwise("12")
    return t.orders.select("o_orderkey", ftext.parse_dates(forms_of_day).alias("day"), ftext.parse_timestamps(stamps).alias("minute"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, days, round(days / 30.44, 6) AS months, floor(days / 30.4375)::INT AS month, round(l_quantity - days / 30.4375, 6) AS difference, abs(l_quantity - days / 30.4375) >= 2 AS flag FROM a""")
def age_from_dates(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    exact = fage.age_months(F.col("l_shipdate"), F.col("o_orderdate"), fage.FORM_MONTH)
    found = both.select("l_orderkey", "l_linenumber", "l_partkey", fage.age_days(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"), fage.age_months(F.col("l_shipdate"), F.col("o_orderdate")).alias("months"), fage.age_month(exact).alias("month"), fage.age_discrepancy(F.col("l_quantity"), exact).alias("d"))
    return rounded(found.select("*", "d.difference", "d.flag").drop("d"))


@query("SELECT vec_id, round(list_sum(embedding[1:5]::DOUBLE[]), 5) AS cropped, 5 AS n_cropped, round(list_sum(embedding::DOUBLE[]), 5) AS padded, 2000 AS n_padded, round(2 * list_sum(embedding::DOUBLE[]), 5) AS mixed FROM embeddings")
def crop_pad_and_mix(t: Tables) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 5)
    cropped, padded = fsamples.crop_or_pad(F.col("embedding"), 5), fsamples.crop_or_pad(F.col("embedding"), 2000)
    mixed = fsamples.downmix(F.col("embedding"), F.transform("embedding", lambda x: x.cast("double") * 3))
    return t.embeddings.select("vec_id", total(cropped).alias("cropped"), F.size(cropped).alias("n_cropped"), total(padded).alias("padded"), F.size(padded).alias("n_padded"), total(mixed).alias("mixed"))


@query("""WITH e AS (SELECT p_brand, p_type, avg(p_retailprice) - 1450 AS estimate, stddev_samp(p_retailprice) / sqrt(count(*)) AS se FROM part GROUP BY ALL HAVING count(*) > 1)
SELECT p_brand, p_type, CASE WHEN estimate - 1.96 * se > 0 THEN 'above zero' WHEN estimate + 1.96 * se < 0 THEN 'below zero' WHEN abs(estimate) < 1e-8 THEN 'near zero' WHEN estimate > 0 THEN 'positive, interval holds zero' ELSE 'negative, interval holds zero' END AS direction FROM e""")
def effect_direction(t: Tables) -> DataFrame:
    e, s = F.avg("p_retailprice") - 1450, F.stddev_samp("p_retailprice") / F.sqrt(F.count("*"))
    effects = t.part.groupBy("p_brand", "p_type").agg(e.alias("e"), s.alias("s"), F.count("*").alias("n")).where("n > 1")
    return effects.select("p_brand", "p_type", fage.effect_direction(F.col("e"), F.col("e") - 1.96 * F.col("s"), F.col("e") + 1.96 * F.col("s")).alias("direction"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS participant_id, CASE WHEN o_orderkey % 9 = 0 THEN 'missing_age' ELSE 'negative_age' END AS issue_type, CASE WHEN o_orderkey % 9 = 0 THEN 'no age' ELSE 'age below zero' END AS message
FROM orders WHERE o_orderkey % 9 = 0 OR o_totalprice < 50000""")
def age_issues(t: Tables) -> DataFrame:
    days = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") - 50000)
    return quality.age_issues(t.orders.select("o_orderkey", days.alias("days")), "o_orderkey", "days")
