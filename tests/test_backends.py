"""Runs of a backend that are taken up again, and tables that several sinks share."""

import shutil

import pytest
from pyspark.sql import functions as F

from segflow.operators.quality import ContractError
from segflow.plans import backends
from segflow.sources import files


@pytest.fixture
def setup(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(recordings):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        counted = recordings.mapInPandas(count, recordings.schema)
        sums = counted.groupBy("participant_id").agg(F.sum("sec").alias("sec")).where("sec > 0")
        return {"segments": counted.where("sec > 1"), "summary": sums}

    rows = [(f"P{i % 5}", i, 0.0 if i % 5 == 4 else float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "participant_id string, n int, sec double")
    return df, str(tmp_path / "out"), backends.Backend("xgb", ("segments", "summary"), run), seen


def who(df):
    return sorted({r.participant_id for r in df.collect()})


def test_a_second_run_does_nothing(spark, setup):
    df, root, backend, seen = setup
    assert backends.complete_participants(spark, root, backend) is None
    first = backends.run_backend(df.where("participant_id < 'P3'"), root, backend, "one")
    assert who(first) == ["P0", "P1", "P2"] and first.count() == 6
    second = backends.run_backend(df, root, backend, "two")
    assert who(second) == ["P3", "P4"] and {r.n_rows for r in second.where("participant_id = 'P4'").collect()} == {0}
    before = seen.value
    assert backends.run_backend(df, root, backend, "three").count() == 0 and seen.value == before
    assert who(backends.complete_participants(spark, root, backend)) == [f"P{i}" for i in range(5)]
    assert backends.read_output(spark, root, backend, "segments").count() == df.where("sec > 1").count()
    assert [(r.run_id, r.participants) for r in backends.run_history(spark, root, backend).orderBy("number").collect()] == [("one", 3), ("two", 2)]


def test_a_removed_output_is_redone_alone(spark, setup):
    df, root, backend, _ = setup
    backends.run_backend(df, root, backend, "one")
    shutil.rmtree(f"{root}/xgb/segments/participant_id=P2")
    assert who(backends.complete_participants(spark, root, backend)) == ["P0", "P1", "P3", "P4"]
    assert who(backends.run_backend(df, root, backend, "two")) == ["P2"]
    summary = {r.participant_id: (r.sec, r.run_id) for r in backends.read_output(spark, root, backend, "summary").collect()}
    assert summary == {f"P{i}": (sum(float(n) for n in range(25) if n % 5 == i), "two" if i == 2 else "one") for i in range(4)}


def test_broken_runs_and_wrong_outputs(spark, setup):
    df, root, backend, _ = setup

    def dies(recordings):
        made = backend.run(recordings)
        return made | {"summary": made["summary"].withColumn("sec", F.raise_error(F.lit("died")).cast("double"))}

    with pytest.raises(Exception, match="died"):
        backends.run_backend(df, root, backends.Backend("xgb", backend.outputs, dies), "one")
    assert backends.complete_participants(spark, root, backend) is None
    assert len(who(backends.run_backend(df, root, backend, "two"))) == 5
    with pytest.raises(ContractError):
        backends.run_backend(df, root, backends.Backend("vtc", ("other",), backend.run))
    with pytest.raises(ContractError):
        backends.run_backend(df.withColumn("participant_id", F.when(F.col("n") > 3, F.col("participant_id"))), root, backend)
    with pytest.raises(ContractError):
        backends.read_output(spark, root + "/none", backend, "summary")
    assert set(backends.expected_outputs(backend, root)) == {"segments", "summary"}


def test_runs_of_many_participants_have_no_folder_for_each(spark, tmp_path):
    """A run that dies, its repetition under the same name, a small run after it and one over a lost participant."""
    import os

    root, n = str(tmp_path / "out"), backends.FOLDERS + 50
    df = spark.range(3 * n).selectExpr(f"id % {n} AS user_id", "id AS v")
    fine = lambda e: {"one": e.groupBy("user_id").agg(F.count("*").alias("n")), "two": e.where("user_id % 2 = 0")}
    died = lambda e: fine(e) | {"two": e.withColumn("v", F.raise_error(F.lit("died")).cast("long"))}
    with pytest.raises(Exception, match="died"):
        backends.run_backend(df, root, backends.Backend("b", ("one", "two"), died, "user_id"), "x")
    backend = backends.Backend("b", ("one", "two"), fine, "user_id")
    assert backends.run_backend(df, root, backend, "x").count() == 2 * n and not os.path.exists(f"{root}/b/one")
    more = df.union(spark.createDataFrame([(n + 7, 1), (n + 8, 1)], "user_id long, v long"))
    assert sorted({r.user_id for r in backends.run_backend(more, root, backend, "x").where("attempt = ''").collect()}) == [n + 7, n + 8]
    assert backends.run_backend(more, root, backend).count() == 0
    one = backends.read_output(spark, root, backend, "one")
    assert one.columns == ["user_id", "run_id", "n"] and {r.user_id: r.n for r in one.collect()} == {i: 3 for i in range(n)} | {n + 7: 1, n + 8: 1} and one.count() == n + 2
    assert backends.read_output(spark, root, backend, "two").count() == more.where("user_id % 2 = 0").count()
    shutil.rmtree(f"{root}/b/one/user_id={n + 7}")
    assert {r.user_id for r in backends.run_backend(more, root, backend, "y").collect()} == {n + 7}


def test_shared_inputs_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def slow(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    base = spark.range(100).withColumn("v", F.col("id") * 2)
    nodes = {
        "base": files.Node(lambda: base.mapInPandas(slow, base.schema)),
        "odd": files.Node(lambda b: b.where("id % 2 = 1"), ("base",)),
        "validation_sum": files.Node(lambda b: b.agg(F.sum("v").alias("s")), ("base",)),
        "private_odd": files.Node(lambda o: o.select("id"), ("odd",)),
        "unused": files.Node(lambda: base.withColumn("x", F.raise_error(F.lit("never")))),
    }
    paths = files.publish_nodes(spark, nodes, ["odd", "validation_sum", "private_odd", "base"], str(tmp_path), {"validation_": "reports", "private_": "private"})
    assert seen.value == 100
    assert paths["validation_sum"].endswith("/reports/validation_sum") and paths["private_odd"].endswith("/private/private_odd") and "/processed/" in paths["odd"]
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == {"odd": 50, "validation_sum": 1, "private_odd": 50, "base": 100}
    with pytest.raises(ContractError):
        files.publish_nodes(spark, {"a": files.Node(lambda b: b, ("b",)), "b": files.Node(lambda a: a, ("a",))}, ["a"], str(tmp_path), {})
    with pytest.raises(ContractError):
        files.publish_nodes(spark, nodes, ["absent"], str(tmp_path), {})


def test_tables_are_read_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b;c", 2)], "name string, n int")
    files.write_table(df, str(tmp_path / "t.parquet"))
    files.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "t.parquet")).collect())) == [("a", 1), ("b;c", 2)]
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "t.csv")).collect())) == [("a", "1"), ("b;c", "2")]
    assert files.read_table(spark, str(tmp_path / "t.csv"), "name string, n int").agg(F.sum("n")).first()[0] == 3
    with pytest.raises(ContractError):
        files.read_table(spark, str(tmp_path / "t.xls"))


def test_required_columns(spark):
    from segflow.operators.quality import require_columns

    df = spark.range(1)
    assert require_columns(df, "table", ["id"]) is df
    with pytest.raises(ContractError, match="absent"):
        require_columns(df, "table", ["id", "absent"])
