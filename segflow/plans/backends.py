"""Resumable runs of a backend over participants: what is complete is found from what was written, the rest is done."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segflow.operators.quality import ContractError

#: Participants of a run up to which each has a folder of its own; the rows of larger runs are one folder of the run.
FOLDERS = 200


@dataclass(frozen=True)
class Backend:
    """A named way from prepared recordings to its expected outputs.

    ``run`` takes the recordings of the participants to do and returns a table
    for each name in ``outputs``, with the participant's column.
    """

    name: str
    outputs: tuple[str, ...]
    run: Callable[[DataFrame], dict[str, DataFrame]]
    participant: str = "participant_id"


def _output_path(root: str, backend: Backend, output: str) -> str:
    return f"{root.rstrip('/')}/{backend.name}/{output}"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _runs_path(root: str, backend: Backend, output: str) -> str:
    return _output_path(root, backend, f"_runs/{output}")


def _written(spark: SparkSession, root: str, backend: Backend, output: str, kind) -> DataFrame | None:
    """All rows of an output, in folders of participants (``attempt`` is empty) and of large runs; ``kind`` is the participant's type."""
    who, found = backend.participant, None
    for path in (_output_path(root, backend, output), _runs_path(root, backend, output)):
        part = _read(spark, path)
        if part is not None:
            attempt = F.col("attempt").cast("string") if "attempt" in part.columns else F.lit("")
            part = part.withColumns({who: F.col(who).cast(kind), "attempt": attempt})
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def ledger(spark: SparkSession, root: str, backend: Backend) -> DataFrame | None:
    """(participant, output, run_id, attempt, n_rows, written_at): each participant's last entry for each output, null before any run."""
    entries = _read(spark, _output_path(root, backend, "_ledger"))
    if entries is None:
        return None
    if "attempt" not in entries.columns:
        entries = entries.withColumn("attempt", F.lit(""))
    last = F.max_by(F.struct("run_id", "attempt", "n_rows", "written_at"), F.struct("written_at", "run_id")).alias("e")
    return entries.groupBy(backend.participant, "output").agg(last).select(backend.participant, "output", "e.*")


def expected_outputs(backend: Backend, root: str) -> dict[str, str]:
    """Where each output lies."""
    return {o: _output_path(root, backend, o) for o in backend.outputs}


def complete_participants(spark: SparkSession, root: str, backend: Backend) -> DataFrame | None:
    """Participants whose every expected output is there with as many rows, of the run that the ledger names, as it says.

    A participant of whom a run found nothing is complete as well. Rows are
    counted without reading their other columns.
    """
    known = ledger(spark, root, backend)
    if known is None:
        return None
    checked = None
    for output in backend.outputs:
        mine = known.where(F.col("output") == output)
        found = _written(spark, root, backend, output, mine.schema[backend.participant].dataType)
        if found is None:
            counted = mine.withColumn("found", F.lit(0))
        else:
            there = found.groupBy(backend.participant, "run_id", "attempt").agg(F.count("*").alias("found"))
            counted = mine.join(there, [backend.participant, "run_id", "attempt"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
        part = counted.where(F.col("n_rows") == F.col("found")).select(backend.participant)
        checked = part if checked is None else checked.join(part, backend.participant, "left_semi")
    return checked


def run_backend(recordings: DataFrame, root: str, backend: Backend, run_id: str | None = None) -> DataFrame:
    """Do the participants of ``recordings`` that are not complete, and return the ledger's entries of this run (none: nothing was to do).

    Participants are told apart by an anti-join. Up to FOLDERS participants have
    a folder each, and only those of the ones that are done are overwritten. A
    larger run writes all its rows to a folder of that attempt, which the ledger
    names, as a folder and a file for each of very many participants cost far
    more than their rows. The ledger is appended to last, so a run that dies
    leaves its participants incomplete. Null participants are an error.
    """
    spark, who = recordings.sparkSession, backend.participant
    if not recordings.where(F.col(who).isNull()).isEmpty():
        raise ContractError(f"recordings without a {who}")
    done = complete_participants(spark, root, backend)
    asked = recordings.select(who).distinct()
    todo = asked if done is None else asked.join(done, who, "left_anti")
    todo = todo.persist()
    run_id = run_id or uuid.uuid4().hex
    try:
        if todo.isEmpty():
            return spark.createDataFrame([], f"`{who}` {todo.dtypes[0][1]}, output string, run_id string, attempt string, n_rows long, written_at timestamp")
        attempt = uuid.uuid4().hex if todo.count() > FOLDERS else ""
        made = backend.run(recordings.join(todo, who, "left_semi"))
        if set(made) != set(backend.outputs):
            raise ContractError(f"{backend.name}: expected {sorted(backend.outputs)}, got {sorted(made)}")
        entries = None
        for output, df in made.items():
            rows = df.withColumn("run_id", F.lit(run_id))
            if attempt:
                path = f"{_runs_path(root, backend, output)}/attempt={attempt}"
                rows.write.parquet(path)
            else:
                path = _output_path(root, backend, output)
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(who).parquet(path)
            written = spark.read.parquet(path).where(F.col("run_id") == run_id).groupBy(F.col(who).cast(todo.dtypes[0][1]).alias(who)).agg(F.count("*").alias("n_rows"))
            own = todo.join(written, who, "left").select(who, F.lit(output).alias("output"), F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.current_timestamp().alias("written_at"))
            entries = own if entries is None else entries.union(own)
        entries.coalesce(1).write.mode("append").parquet(_output_path(root, backend, "_ledger"))
    finally:
        todo.unpersist()
    return ledger(spark, root, backend).where(F.col("run_id") == run_id)


def read_output(spark: SparkSession, root: str, backend: Backend, output: str) -> DataFrame:
    """The rows of an output that the ledger's runs wrote; what older runs left behind is not shown."""
    known = ledger(spark, root, backend)
    found = None if known is None else _written(spark, root, backend, output, known.schema[backend.participant].dataType)
    if found is None:
        raise ContractError(f"{backend.name} has not written {output} under {root}")
    current = known.where(F.col("output") == output).select(backend.participant, "run_id", "attempt")
    return found.join(current, [backend.participant, "run_id", "attempt"], "left_semi").drop("attempt")


def run_history(spark: SparkSession, root: str, backend: Backend) -> DataFrame:
    """(run_id, participants, n_rows, written_at) of every run, from the ledger's entries."""
    entries = spark.read.parquet(_output_path(root, backend, "_ledger"))
    runs = entries.groupBy("run_id").agg(F.count_distinct(backend.participant).alias("participants"), F.sum("n_rows").alias("n_rows"), F.max("written_at").alias("written_at"))
    return runs.withColumn("number", F.row_number().over(Window.orderBy("written_at", "run_id")))  # a row for each run
