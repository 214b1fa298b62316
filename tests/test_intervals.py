import random

from pyspark.sql import functions as F

from segflow.operators import intervals, profile


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def random_intervals(spark, n, seed, kinds="ab"):
    r = random.Random(seed)
    made = [(i, "r" + str(r.randrange(2)), r.choice(kinds), s := r.randrange(0, 400) / 4, s + r.randrange(1, 60) / 4) for i in range(n)]
    return made, spark.createDataFrame(made, "id int, rec string, label string, start_sec double, end_sec double")


def test_overlap_join_equals_all_pairs(spark):
    made, df = random_intervals(spark, 60, 1)
    left, right = df.where("label = 'a'"), df.where("label = 'b'")
    found = rows(intervals.overlap_join(left, right, ["rec"], 0.5), "id", "start_sec", "end_sec")
    wanted = sorted((a[0], max(a[3], b[3]), min(a[4], b[4])) for a in made if a[2] == "a" for b in made if b[2] == "b" and a[1] == b[1] and min(a[4], b[4]) - max(a[3], b[3]) >= 0.5)
    assert found == wanted and found


def test_join_has_no_nested_loop(spark):
    _, df = random_intervals(spark, 10, 2)
    plan = intervals.overlap_join(df, df, ["rec"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_turns_that_overlap_each_other_keep_all_pairs(spark):
    turns = spark.createDataFrame([("r", "A", 0.0, 10.0), ("r", "B", 1.0, 3.0)], "rec string, who string, start_sec double, end_sec double")
    regions = spark.createDataFrame([("r", 0.0, 2.0), ("r", 4.0, 5.0)], "rec string, start_sec double, end_sec double")
    assert rows(intervals.overlap_join(turns, regions, ["rec"]), "who", "start_sec", "end_sec") == [("A", 0.0, 2.0), ("A", 4.0, 5.0), ("B", 1.0, 2.0)]


def test_pairwise_overlaps(spark):
    made, df = random_intervals(spark, 40, 3, "xyz")
    found = rows(intervals.pairwise_overlaps(df, ["rec"], "label", "id"), "first_id", "second_id")
    key = lambda a: (a[3], a[4], a[0])
    assert found == sorted((a[0], b[0]) for a in made for b in made if a[1] == b[1] and a[2] != b[2] and key(a) < key(b) and min(a[4], b[4]) > max(a[3], b[3]))


def test_merge_close_takes_the_gap_and_not_overlaps(spark):
    df = spark.createDataFrame([("r", 0.0, 1.0), ("r", 1.5, 2.0), ("r", 2.6, 3.0), ("r", 2.8, 4.0)], "rec string, start_sec double, end_sec double")
    assert rows(intervals.merge_close(df, ["rec"], 0.5), "start_sec", "end_sec", "n_merged") == [(0.0, 2.0, 2), (2.6, 3.0, 1), (2.8, 4.0, 1)]


def test_tier_covers_the_same_time_without_overlaps(spark):
    made, df = random_intervals(spark, 50, 4)
    tier = rows(intervals.non_overlap(df, ["rec"]), "rec", "start_sec", "end_sec")
    for rec in ("r0", "r1"):
        own = [(s, e) for r, s, e in tier if r == rec]
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
        covered = {i / 4 for m in made if m[1] == rec for i in range(int(m[3] * 4), int(m[4] * 4))}
        assert covered == {i / 4 for s, e in own for i in range(int(s * 4), int(e * 4))}


def test_windows_and_chunks(spark):
    df = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.0, 2.0), ("c", 0.0, 2.3)], "id string, start_sec double, end_sec double")
    found = rows(intervals.sliding_windows(df, 1.0, 0.5), "id", "window_start")
    assert found == [("a", 0.0), ("b", 0.0), ("b", 0.5), ("b", 1.0), ("c", 0.0), ("c", 0.5), ("c", 1.0), ("c", 1.2999999999999998)]
    long = spark.createDataFrame([(1900.0,), (100.0,), (0.0,)], "dur double")
    assert rows(intervals.chunks(long, "dur", 900.0, 10.0), "dur", "chunk_start", "chunk_end") == [(100.0, 0.0, 100.0), (1900.0, 0.0, 900.0), (1900.0, 890.0, 1790.0), (1900.0, 1780.0, 1900.0)]


def test_regions_offsets_and_caps(spark):
    frames = spark.createDataFrame([("r", i, i in (1, 2, 3, 6)) for i in range(8)], "rec string, i int, on boolean")
    assert rows(intervals.flags_to_regions(frames, ["rec"], "i", "on", 160, 16000, 20.0), "start_sec", "end_sec") == [(0.01, 0.04)]
    parts = spark.createDataFrame([("p", 1, 0.1), ("p", 2, 0.1)], "rec string, k int, dur double")
    assert rows(intervals.combined_offsets(parts, ["rec"], ["k"], "dur"), "source_index", "combined_start", "combined_end") == [(0, 0.0, 0.1), (1, 0.1, 0.2)]
    segs = spark.createDataFrame([("r", float(i), i + 0.5) for i in range(5)], "rec string, start_sec double, end_sec double")
    assert intervals.cap_total(segs, ["rec"], 1.0).count() == 2


def test_coverage_falls_back_to_all(spark):
    segs = spark.createDataFrame([("a", 1, 0.0, 2.0), ("a", 2, 5.0, 6.0), ("b", 3, 0.0, 1.0)], "rec string, id int, start_sec double, end_sec double")
    main = spark.createDataFrame([("a", 0.0, 1.0)], "rec string, start_sec double, end_sec double")
    assert rows(intervals.overlap_coverage(segs, main, ["rec"], "id"), "id") == [(1,), (3,)]


def test_bins_keep_empty_ones(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (None,)], "d double")
    found = {r["bin"]: r["n"] for r in profile.binned_profile(df, "d", [0.0, 1.0, 2.0]).collect()}
    assert found == {"[0,1)": 1, "[1,2)": 1, "[2,inf)": 0}
    assert df.where(F.col("d").isNull()).count() == 1
