"""Run directories, documents and JSON records as DataFrames."""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.runtime import bounded_rows


def latest(runs: DataFrame, by: Sequence[str], date: str, carry: Sequence[str]) -> DataFrame:
    """The row with the greatest date of each group."""
    return runs.groupBy(*by).agg(F.max(F.struct(date, *carry)).alias("__r")).select(*by, f"__r.{date}", *(f"__r.{c}" for c in carry))


def resolved(runs: DataFrame, by: Sequence[str], date: str, path: str, pinned: str | None = None) -> DataFrame:
    """(by, date, path) of the pinned date, else of the latest that has the file; nothing for a group is an error of the caller to see.

    Raises FileNotFoundError where no group has a run.
    """
    usable = runs.where(F.col(path).isNotNull() & (F.col(date) == pinned if pinned else F.lit(True)))
    found = latest(usable, by, date, [path])
    if found.isEmpty():
        raise FileNotFoundError(f"no run{f' of {pinned}' if pinned else ''}")
    return found


def files(spark: SparkSession, directory: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(path, name, length) of the plain files of a folder but the ignored names; a missing folder is an error when it is read."""
    listed = spark.read.format("binaryFile").load(directory).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    return listed.where(~F.col("name").isin(list(ignore))) if ignore else listed


def documents(spark: SparkSession, directory: str, keep: Sequence[str] | DataFrame | None = None, exclude: Sequence[str] | DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """(document_id, text, columns of metadata): one row per .txt file, named by its stem.

    keep and exclude are names or tables of document_id; files are chosen by semi and anti joins on their path, so no list of paths reaches
    the driver and the texts of other files are dropped where they are read. metadata is joined by document_id, nulls where it has none.
    """
    rows = spark.read.option("pathGlobFilter", "*.txt").text(directory, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)[.]txt$", 1).alias("document_id"), F.col("value").alias("text"))

    def named(x: Sequence[str] | DataFrame) -> DataFrame:
        return x.select("document_id") if isinstance(x, DataFrame) else spark.createDataFrame([(n,) for n in x], "document_id string")

    if keep is not None:
        rows = rows.join(named(keep), "document_id", "left_semi")
    if exclude is not None:
        rows = rows.join(named(exclude), "document_id", "left_anti")
    if metadata is not None:
        rows = rows.join(metadata.dropDuplicates(["document_id"]), "document_id", "left")
    return rows


def activations(spark: SparkSession, path: str) -> DataFrame:
    """(measurement_id, shape array<int>, values array<float>) of npz files, one array per measurement_id."""

    def read(frames):
        for f in frames:
            for content in f["content"]:
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(k, list(z[k].shape), z[k].astype("f4").ravel().tolist()) for k in z.files], columns=["measurement_id", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "measurement_id string, shape array<int>, values array<float>")


def write_activations(df: DataFrame, key: str, values: str, path: str) -> None:
    """One npz file per partition in the folder path, an array per key; written by a name that a retried task writes again."""

    def write(frames):
        from pyspark import TaskContext

        arrays = {str(k): np.asarray(v, "f4") for f in frames for k, v in zip(f[key], f[values]) if v is not None}
        if arrays:
            os.makedirs(path, exist_ok=True)
            name = f"{path}/part-{TaskContext.get().partitionId():05d}.npz"
            with open(f"{name}.tmp-{TaskContext.get().taskAttemptId()}", "wb") as f:
                np.savez_compressed(f, **arrays)
            os.replace(f.name, name)
        yield pd.DataFrame({"n": [len(arrays)]})

    df.select(key, values).mapInPandas(write, "n bigint").agg(F.sum("n")).collect()


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, NaN as null, nulls kept."""
    nan_to_null(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    nan_to_null(df).write.mode("overwrite").option("header", True).csv(path)


def latex_table(df: DataFrame, label: str, columns: Sequence[str], intervals: dict[str, tuple[str, str]] | None = None, digits: int = 3, best: str = "max", bound: int = 1000) -> str:
    """A LaTeX table of a result of at most bound rows: the best value of each column bold, half the interval behind a value, -- for nulls and NaN."""
    rows = bounded_rows(df.orderBy(label), bound, "a table to be printed")
    known = lambda x: x is not None and x == x
    tops = {c: (max if best == "max" else min)((r[c] for r in rows if known(r[c])), default=None) for c in columns}

    def cell(r, c: str) -> str:
        if not known(r[c]):
            return "--"
        text = f"{r[c]:.{digits}f}"
        if intervals and c in intervals and all(known(r[x]) for x in intervals[c]):
            text += f" $\\pm$ {(r[intervals[c][1]] - r[intervals[c][0]]) / 2:.{digits}f}"
        return f"\\textbf{{{text}}}" if r[c] == tops[c] else text

    head = " & ".join([label, *columns])
    body = "\n".join(" & ".join([str(r[label]), *(cell(r, c) for c in columns)]) + " \\\\" for r in rows)
    return f"\\begin{{tabular}}{{l{'r' * len(columns)}}}\n{head} \\\\\n\\hline\n{body}\n\\end{{tabular}}"


def json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects; bare NaN is read as a number that is none."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)


def ground_truth(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    suffix = Path(path).suffix
    if suffix == ".csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    if suffix == ".json":
        return json_records(spark, path, schema)
    raise ValueError(f"neither .csv nor .json: {path}")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema))


def write_stage(df: DataFrame, root: str, stage: str, resume: bool = True) -> DataFrame:
    """Writes a stage as Parquet and reads it back; with resume, a finished stage is only read."""
    spark, path = df.sparkSession, f"{root}/{stage}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path}/_SUCCESS")
    if not (resume and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], arguments: dict) -> DataFrame:
    """The result of build, written once for each set of arguments and read afterwards; other arguments never give a stale result."""
    digest = hashlib.sha256(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{digest}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def provenance_key(text: str) -> tuple[int | str, ...]:
    """'doc|item' of stored provenance or 'doc|entity|attribute|page' of events, document and page as numbers where they are ones."""
    doc, *rest = text.split("|", 3) if text.count("|") >= 3 else text.split("|", 1)
    number = lambda x: int(x) if x.lstrip("-").isdigit() else x
    return (number(doc), *rest[:-1], number(rest[-1])) if len(rest) == 3 else (number(doc), *rest)


def keyed_records(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(document_id, item, or entity_id, attribute and page_number, and the value struct) of a JSON object of stored provenance or events."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,array<{value}>>")).alias("k", "v"))
    parts = F.split("k", "[|]", 4)
    four = F.size(parts) == 4
    return raw.select(
        F.get(parts, F.lit(0)).alias("document_id"), F.when(~four, F.split("k", "[|]", 2)[1]).alias("item"), F.when(four, F.get(parts, F.lit(1))).alias("entity_id"), F.when(four, F.get(parts, F.lit(2))).alias("attribute"),
        F.when(four, F.get(parts, F.lit(3)).try_cast("int")).alias("page_number"), F.explode_outer("v").alias("value"),
    )


def run_metadata(spark: SparkSession, started: float | None = None, warnings: Sequence[str] = (), **values) -> DataFrame:
    """One row of metadata: a UTC timestamp, the runtime since started in tenths of a second, warnings, and further values."""
    made = {"run_timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"), "runtime_seconds": round(time.time() - started, 1) if started is not None else None, "warnings": list(warnings), **values}
    return spark.createDataFrame([(json.dumps(made, sort_keys=True, default=str),)], "metadata string")


def load_metadata(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path, wholetext=True).first()
    stored = json.loads(row.value) if row else {}
    return json.loads(stored["metadata"]) if set(stored) == {"metadata"} else stored


def check_run(metadata: dict, strict: bool = False) -> list[str]:
    """The warnings a run has stored; with strict, any is an error."""
    found = [str(w) for w in metadata.get("warnings") or []]
    if found and strict:
        raise RuntimeError("; ".join(found))
    return found
