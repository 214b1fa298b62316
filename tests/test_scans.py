"""Carried scans against one sequential pass, and intervals of mixed lengths against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from segflow.operators import intervals, scans

MADE = "id int, rec string, label string, start_sec double, end_sec double"


def segments(n, seed, hot=0.7):
    """Most rows in one recording, some in others and in none; starts that tie, ends far and near."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rec = "hot" if r.random() < hot else r.choice(["a", "b", None])
        start = r.randrange(0, 4 * n) / 4
        rows.append((i, rec, r.choice("xy"), start, start + r.choice([0.25, 0.5, 1.0, 40.0])))
    return rows


def sequential(rows):
    """(id: last end, sum of lengths before, largest end before, number before) by recording."""
    found = {}
    for rec in {r[1] for r in rows}:
        last, total, most = None, 0.0, None
        for k, r in enumerate(sorted((r for r in rows if r[1] == rec), key=lambda r: (r[3], r[4], r[0]))):
            found[r[0]] = (last, total, most, k)
            last, total, most = r[4], total + r[4] - r[3], r[4] if most is None else max(most, r[4])
    return found


@pytest.mark.parametrize("rows_per_range", [5, 40, 10**6])
def test_carried_scan_equals_a_sequential_one(spark, rows_per_range):
    rows = segments(300, 3)
    df = spark.createDataFrame(rows, MADE).repartition(5)
    found = scans.scan(df, ["rec"], ["start_sec", "end_sec", "id"], rows_per_range, last={"last": "end_sec"}, total={"total": F.col("end_sec") - F.col("start_sec")}, most={"most": "end_sec"}, count="n")
    assert found.columns == [*df.columns, "last", "total", "most", "n"]
    assert {r.id: (r.last, r.total, r.most, r.n) for r in found.collect()} == sequential(rows)


def test_hot_recording_is_many_ranges_and_no_window_by_recording(spark):
    df = spark.createDataFrame(segments(400, 4), MADE)
    ranged, split = scans.in_ranges(df, ["rec"], ["start_sec", "end_sec"], 20)
    sizes = {(r["rec"], r[scans.PART]): r["count"] for r in ranged.groupBy("rec", scans.PART).count().collect()}
    hot = [n for (rec, part), n in sizes.items() if rec == "hot"]
    assert split and len(hot) > 10 and max(hot) < 45
    assert all(part == -1 for (rec, part) in sizes if sum(n for (r, _), n in sizes.items() if r == rec) <= 20)
    plan = intervals.non_overlap(df, ["rec"], rows_per_range=20)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and "end_sec" in line]
    assert over_rows and all(scans.PART in line for line in over_rows)


@pytest.mark.parametrize("operator", ["merge", "tier", "offsets", "streams", "cap", "regions"])
def test_operators_do_not_depend_on_ranges(spark, operator):
    rows = segments(250, 5)
    df = spark.createDataFrame(rows, MADE)
    frames = spark.createDataFrame([("hot" if i % 4 else "b", i, (i * 7) % 5 > 1) for i in range(300)], "rec string, i int, on boolean")
    run = {
        "merge": lambda n: intervals.merge_close(df, ["rec"], 0.5, row_id="id", rows_per_range=n),
        "tier": lambda n: intervals.non_overlap(df, ["rec"], rows_per_range=n),
        "offsets": lambda n: intervals.combined_offsets(df.withColumn("d", F.lit(0.25)), ["rec"], ["start_sec", "end_sec", "id"], "d", 0.5, n),
        "streams": lambda n: intervals.class_stream_offsets(df.withColumn("end_sec", F.col("end_sec") + F.col("id") / 1024), ["rec"], "label", 0.25, 1024, rows_per_range=n),
        "cap": lambda n: intervals.cap_total(df.withColumn("end_sec", F.col("start_sec") + 0.5), ["rec"], 30.0, rows_per_range=n).select("rec", "start_sec", "cumulative_sec"),
        "regions": lambda n: intervals.flags_to_regions(frames, ["rec"], "i", "on", 160, 16000, rows_per_range=n),
    }[operator]
    written = [sorted(map(str, run(n).collect())) for n in (10**6, 9)]
    assert written[0] == written[1] and written[0]


def test_scan_by_text_and_of_nothing(spark):
    rows = [("k", f"part{i:03d}", float(i)) for i in range(60)] + [("k", None, 0.5)]
    df = spark.createDataFrame(rows, "key string, name string, x double")
    found = {r.name: r.s for r in scans.scan(df, ["key"], ["name"], 7, total={"s": F.col("x")}).collect()}
    assert found[None] == 0 and found["part000"] == 0.5 and found["part059"] == 0.5 + sum(range(59))
    assert scans.scan(df.limit(0), ["key"], ["name"], 7, count="n").count() == 0


def mixed(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start, length = r.uniform(-1000, 90000), 0.1 * 10 ** r.uniform(0, 5.94)
        rows.append((i, "r" + str(r.randrange(2)), "ab"[i % 2], start, start + length))
    return rows + [(n, "r0", "a", 5.0, 5.0), (n + 1, "r0", "b", 6.0, 4.0), (n + 2, "r0", "a", None, 4.0), (n + 3, None, "b", 0.0, 9.0), (n + 4, "r0", "b", 64.0, 128.0), (n + 5, "r0", "a", 128.0, 192.0)]


def test_intervals_from_a_tenth_to_a_day(spark):
    rows = mixed(400, 6)
    df = spark.createDataFrame(rows, MADE)
    found = intervals.overlap_pairs(df.where("label = 'a'"), df.where("label = 'b'"), ["rec"], 0.0, "start_sec", "end_sec").select("l.id", "r.id", "start", "end").collect()
    good = [r for r in rows if r[1] and r[3] is not None and r[4] > r[3]]
    wanted = sorted((a[0], b[0], max(a[3], b[3]), min(a[4], b[4])) for a in good if a[2] == "a" for b in good if b[2] == "b" and a[1] == b[1] and max(a[3], b[3]) < min(a[4], b[4]))
    assert sorted(map(tuple, found)) == wanted and len(wanted) > 1000


def test_an_interval_makes_few_rows(spark):
    df = spark.createDataFrame([r for r in mixed(300, 7) if r[3] is not None and r[4] > r[3]], MADE)
    level = intervals._level(F.col("start_sec"), F.col("end_sec"))
    sides = df.select("rec", F.struct(*df.columns).alias("l"), level.alias("__level"), df.agg(F.array_sort(F.collect_set(level))).scalar().alias("__others"))
    cells = intervals._cells(sides, "l", "start_sec", "end_sec", F.filter("__others", lambda x: x >= F.col("__level")), "up", "down")
    most = cells.groupBy("l.id").count().agg(F.max("count"), F.avg("count")).first()
    assert most[0] <= 2 + 2 * 11 and most[1] < 14
