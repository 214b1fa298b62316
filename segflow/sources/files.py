"""Recordings, segment files, form exports and reports."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflow.functions.text import normalize_label
from segflow.operators.intervals import valid_intervals
from segflow.operators.quality import ContractError
from segflow.storage import cut

RECORDINGS = "recording_id string, participant_id string, session_date string, path string, duration_sec double, sample_rate int, channels int, frames long, subtype string, format string, size_bytes long"


def wave_header(stream: BinaryIO, size: int) -> tuple[int, int, int, str] | None:
    """(rate, channels, frames, subtype) of a RIFF file; None if it is not one.

    Chunks before the samples are passed over by their lengths, however many and long they are.
    """
    head = stream.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= size:
        stream.seek(at)
        kind, n = struct.unpack("<4sI", stream.read(8))
        if kind == b"fmt " and at + 24 <= size:
            _, channels, rate, _, block, bits = struct.unpack("<HHIIHH", stream.read(16))
            form = rate, channels, block, f"PCM_{bits}"
        elif kind == b"data":
            if form is None or not form[2] or not form[0]:
                return None
            return form[0], form[1], min(n, size - at - 8) // form[2], form[3]
        at += 8 + n + n % 2
    return None


def scan_recordings(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("wav",), case_sensitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(recordings, unreadable): a row for each audio file under ``root``.

    The file's name is the recording, its folder the session, the folder above
    the participant. Paths and sizes come from Spark's file listing (contents
    are pruned); tasks then read the chunk headers of each file through
    Arrow's file systems, so no file is read whole.
    """
    pattern = r"\.(" + "|".join(extensions) + ")$"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    files = listed.where(F.col("path").rlike(pattern if case_sensitive else f"(?i){pattern}"))
    parts = F.split("path", "/")
    named = files.select(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("recording_id"), F.element_at(parts, -3).alias("participant_id"), F.element_at(parts, -2).alias("session_date"), "path", "size_bytes")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs

        for pdf in batches:
            rows = []
            for path, size in zip(pdf["path"], pdf["size_bytes"]):
                try:
                    system, place = fs.FileSystem.from_uri(path)
                    with system.open_input_file(place) as stream:
                        found = wave_header(stream, size)
                except (OSError, struct.error):
                    found = None
                rate, channels, frames, subtype = found or (None, None, None, None)
                rows.append((frames / rate if found else None, rate, channels, frames, subtype, "WAV" if found else None))
            extra = pd.DataFrame(rows, columns=["duration_sec", "sample_rate", "channels", "frames", "subtype", "format"])
            yield pd.concat([pdf.reset_index(drop=True), extra.astype({"sample_rate": "Int32", "channels": "Int32", "frames": "Int64"})], axis=1)[[f.name for f in schema]]

    schema = T.StructType.fromDDL(RECORDINGS)
    scanned = named.mapInPandas(read, schema)
    return scanned.where("format IS NOT NULL"), scanned.where("format IS NULL").select("path", "size_bytes")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or Parquet table, by suffix."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ContractError(f"no reader for {path}")


def unique_names(names: list[str]) -> list[str]:
    """Names as they are; an equal one further on gets the number of those before it."""
    before = [names[:i].count(name) for i, name in enumerate(names)]
    return [name + f".{n}" * (n > 0) for name, n in zip(names, before)]


def read_delimited_strings(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """A form export: every column a string, names cleaned of marks and made unique."""
    text = spark.read.option("sep", separator).option("encoding", "UTF-8").option("quote", '"').option("multiLine", True)
    header = text.option("header", False).csv(path).first()
    names = [" ".join((h or "").replace("﻿", "").replace(" ", " ").split()) for h in header]
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return text.option("header", True).option("enforceSchema", True).schema(schema).csv(path).toDF(*unique_names(names))


def resolve_columns(df: DataFrame, synonyms: dict[str, list[str]], needed: tuple[str, ...] = ("label",)) -> DataFrame:
    """Segments with ``uid, start, duration, label``, each from the first synonym that is there, in any case.

    A missing duration is the end less the start; a missing uid is the file's
    name; numbers that cannot be read are null.
    """
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((by_lower[s.lower()] for s in names if s.lower() in by_lower), None) for name, names in synonyms.items()}
    if missing := [n for n in needed if not found.get(n)]:
        raise ContractError(f"no column for {missing} among {df.columns}")
    if not found.get("duration") and not (found.get("start") and found.get("end")):
        raise ContractError("no column for duration_s, nor for a start and an end")
    number = lambda n: F.col(f"`{found[n]}`").try_cast("double") if found.get(n) else F.lit(None).cast("double")
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    uid = F.col(f"`{found['uid']}`").cast("string") if found.get("uid") else stem
    return df.select(uid.alias("uid"), number("start").alias("start"), (number("duration") if found.get("duration") else number("end") - number("start")).alias("duration"), F.trim(F.col(f"`{found['label']}`")).alias("label"))


def read_segments(spark: SparkSession, path: str, backend: str, child_label: str = "key_child") -> DataFrame:
    """Segments of all files that match ``path``, classes named; the folder's name is the participant."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    participant = F.element_at(F.split(F.input_file_name(), "/"), -2).alias("participant_id")
    number = lambda c: F.col(c).try_cast("double")
    if backend == "vtc":
        raw = df.select(participant, number("start_time_s").alias("start_sec"), (number("start_time_s") + number("duration_s")).alias("end_sec"), "label")
    else:
        raw = df.select(participant, number("start_sec").alias("start_sec"), number("end_sec").alias("end_sec"), F.col("predicted_class").alias("label"))
    return valid_intervals(raw.withColumn("label", normalize_label(F.col("label"), backend, child_label)))


def compare_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """(check, same, detail) of two versions of a table: rows, columns, their order, and those on one side alone."""
    names = [" ".join(c.split()) for c in a.columns], [" ".join(c.split()) for c in b.columns]
    rows = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))
    only = [sorted(set(x) - set(y)) for x, y in (names, names[::-1])]
    facts = [("columns", len(names[0]) == len(names[1]), f"{len(names[0])} | {len(names[1])}"), ("order", names[0] == names[1], ""), ("only_a", not only[0], " | ".join(only[0])), ("only_b", not only[1], " | ".join(only[1]))]
    told = [F.struct(F.lit("rows").alias("check"), F.expr("na = nb").alias("same"), F.concat_ws(" | ", "na", "nb").alias("detail"))]
    return rows.select(F.inline(F.array(*told, *[F.struct(F.lit(c).alias("check"), F.lit(s).alias("same"), F.lit(d).alias("detail")) for c, s, d in facts])))


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, CSV with a header, or JSON lines; one overwritten folder."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def publish_outputs(tables: dict[str, DataFrame], root: str, routes: dict[str, str], default: str = "processed") -> dict[str, str]:
    """Write every table to the folder that its name's prefix is routed to; returns the paths."""
    paths = {}
    for name, df in tables.items():
        folder = next((to for prefix, to in routes.items() if name.startswith(prefix)), default)
        paths[name] = f"{root}/{folder}/{name}"
        write_table(df, paths[name])
    return paths


@dataclass(frozen=True)
class Node:
    """A table by the tables that it is made of: ``make`` takes those named in ``needs``."""

    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def publish_nodes(spark: SparkSession, nodes: dict[str, Node], sinks: list[str], root: str, routes: dict[str, str], default: str = "processed") -> dict[str, str]:
    """Write the tables named in ``sinks`` to their routed folders, each table that several of them need being computed once.

    A sink that others need is read back from what was written; a table in
    between with several users is stored in the shared folder; one with a single
    user stays lazy. Tables that no sink needs are not made.
    """
    users: dict[str, int] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name not in nodes:
            raise ContractError(f"no table {name!r}; found {sorted(nodes)}")
        if name in above:
            raise ContractError(f"tables need each other: {' < '.join((*above, name))}")
        users[name] = users.get(name, 0) + 1
        if users[name] == 1:
            for need in nodes[name].needs:
                visit(need, (*above, name))

    for sink in sinks:
        visit(sink, ())
    made: dict[str, DataFrame] = {}
    paths: dict[str, str] = {}

    def table(name: str) -> DataFrame:
        if name not in made:
            df = nodes[name].make(*[table(n) for n in nodes[name].needs])
            if name in sinks:
                folder = next((to for prefix, to in routes.items() if name.startswith(prefix)), default)
                paths[name] = f"{root}/{folder}/{name}"
                write_table(df, paths[name])
                df = spark.read.schema(df.schema).parquet(paths[name])
            elif users[name] > 1:
                df = cut(df)
            made[name] = df
        return made[name]

    for sink in sinks:
        table(sink)
    return paths


def wave_bytes(samples: bytes, rate: int, channels: int = 1, width: int = 2) -> bytes:
    """A RIFF file of PCM samples; used to make small recordings."""
    out, block = io.BytesIO(), channels * width
    out.write(b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, 8 * width) + b"data" + struct.pack("<I", len(samples)) + samples)
    return out.getvalue()
