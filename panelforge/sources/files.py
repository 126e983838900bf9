"""Files: delimited text with inferred types, Parquet, Stata, conversions, manifests (IO1-IO17)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import NUMBER, quoted, strip
from panelforge.operators.clean import NULL_TEXTS

STATA_ROW_LIMIT = 5_000_000
RUN_MODES = {"single": "single", "file": "single", "single_file": "single", "one": "single", "folder": "folder", "batch": "folder", "directory": "folder", "dir": "folder"}


def _require(path: str, suffix: str) -> None:
    if "://" in path and not path.startswith("file://"):
        return
    p = Path(path.removeprefix("file://"))
    if not p.exists():
        raise InputValidationError(f"{path} does not exist")
    if p.suffix.lower() != suffix:
        raise InputValidationError(f"{path} is no {suffix} file")


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a value goes on after its line: some line then has an odd number of quotes."""
    value = F.col("value")
    return not spark.read.text(path).filter(F.pmod(F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit(""))), F.lit(2)) == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, *, schema: T.StructType | None = None, multi_line: bool | None = None) -> DataFrame:
    """A CSV file or folder with a header. Texts that mean missing become null; columns are typed by what all their values are.

    Everything is read as text first; one aggregate over all columns decides between long, double, boolean and text, so
    that ``1,NA,3`` is a number. Give ``schema`` to spare that job. Quoted line breaks are understood: unless ``multi_line``
    tells, a scan looks for lines with an odd number of quotes, since a file read with line breaks in values is one task.
    """
    _require(path, ".csv")
    if multi_line is None:
        multi_line = _breaks_in_quotes(spark, path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.option("inferSchema", False).csv(path)
    tidy = raw.select(*(F.when(~strip(F.col(quoted(c))).isin(*NULL_TEXTS), F.col(quoted(c))).alias(c) for c in raw.columns))
    if not raw.columns:
        return raw
    tests = []
    for i, c in enumerate(raw.columns):
        v = strip(F.col(quoted(c)))
        tests += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(r"^[+-]?\d{1,18}$")).alias(f"i{i}"), F.count_if(v.rlike(NUMBER)).alias(f"d{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}")]
    p = tidy.agg(*tests).first()
    out = []
    for i, c in enumerate(raw.columns):
        v, n = strip(F.col(quoted(c))), p[f"n{i}"]
        kind = "string" if not n else "bigint" if p[f"i{i}"] == n else "double" if p[f"d{i}"] == n else "boolean" if p[f"b{i}"] == n else "string"
        out.append((F.col(quoted(c)) if kind == "string" else v.try_cast(kind)).alias(c))
    return tidy.select(*out)


def write_csv(df: DataFrame, path: str, *, overwrite: bool = False, single_file: bool = False) -> str:
    """A folder of CSV parts with headers; ``single_file`` puts all rows into one task, for small results."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def read_stata(spark: SparkSession, path: str, *, labels: bool = False, chunk_rows: int = 100_000) -> DataFrame:
    """A Stata file, its value labels as texts if ``labels``.

    The format has no splits, so one task reads a file in chunks; a folder of files is read by as many tasks. Only the
    first rows' types are read on the driver. Empty and broken files are errors.
    """
    files = sorted(str(p) for p in Path(path).glob("*.dta")) if Path(path).is_dir() else [path]
    if not files:
        raise InputValidationError(f"{path} holds no Stata file")
    for f in files:
        _require(f, ".dta")
        if os.path.getsize(f) == 0:
            raise InputValidationError(f"{f} is empty")

    def chunks(name: str, rows: int) -> Iterator[pd.DataFrame]:
        with pd.read_stata(name, convert_categoricals=labels, chunksize=rows) as reader:
            for pdf in reader:
                for c in pdf.columns:
                    if isinstance(pdf[c].dtype, pd.CategoricalDtype):
                        pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
                    elif pdf[c].dtype == object:
                        pdf[c] = pdf[c].where(pdf[c] != "", None)
                yield pdf

    try:
        head = next(chunks(files[0], 1000))
    except StopIteration:
        raise InputValidationError(f"{files[0]} has no rows") from None
    except Exception as e:
        raise InputValidationError(f"{files[0]} cannot be read as Stata file: {e}") from e
    kinds = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "M": T.TimestampType()}
    schema = T.StructType([T.StructField(c, kinds.get(head[c].dtype.kind, T.StringType())) for c in head.columns])
    text = [f.name for f in schema if isinstance(f.dataType, T.StringType)]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                for pdf in chunks(name, chunk_rows):
                    for c in text:
                        pdf[c] = pdf[c].map(lambda x: None if x is None else str(x))
                    yield pdf[list(schema.names)]

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files)).mapInPandas(load, schema)


def write_stata(df: DataFrame, path: str, *, row_limit: int = STATA_ROW_LIMIT) -> str:
    """A Stata file, written on the driver: refused beyond ``row_limit`` rows, which the format's readers cannot hold either."""
    n = df.limit(row_limit + 1).count()
    if n > row_limit:
        raise InputValidationError(f"more than {row_limit} rows; write Parquet instead")
    out = df.select(*(F.col(quoted(f.name)).cast("double").alias(f.name) if isinstance(f.dataType, (T.LongType, T.DecimalType, T.BooleanType)) else F.col(quoted(f.name)) for f in df.schema)).toPandas()
    for c in out.columns:
        if out[c].dtype == object:
            out[c] = out[c].map(lambda x: "" if x is None else str(x))
    out.columns = [c[:32] for c in out.columns]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    out.to_stata(path, write_index=False, version=118)
    return path


_READ = {"csv": read_csv, "parquet": read_parquet, "stata": read_stata}
_WRITE = {"csv": write_csv, "parquet": write_parquet, "stata": write_stata}
SUFFIX = {"csv": ".csv", "parquet": ".parquet", "stata": ".dta"}
CONVERSIONS = ("csv_to_parquet", "csv_to_stata", "parquet_to_csv", "parquet_to_stata", "stata_to_csv", "stata_to_parquet")


@dataclass
class Conversion:
    converted: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def convert(spark: SparkSession, conversion: str, *, run_mode: str = "single", input_path: str | None = None, output_path: str | None = None, input_folder: str | None = None, output_folder: str | None = None, include_subfolders: bool = False, fail_fast: bool = False) -> Conversion:
    """One file, or every file of a folder, in another format.

    A single file's default output is its stem with the new suffix. A folder keeps relative paths; failures are
    collected unless ``fail_fast``; nothing converted at all is an error.
    """
    if conversion not in CONVERSIONS:
        raise InputValidationError(f"conversion must be one of {', '.join(CONVERSIONS)}")
    mode = RUN_MODES.get(run_mode.strip().lower())
    if mode is None:
        raise InputValidationError(f"unknown run mode {run_mode!r}")
    source, sink = conversion.split("_to_")

    def one(a: str, b: str) -> None:
        if Path(a).resolve() == Path(b).resolve():
            raise InputValidationError("output and input are one file")
        Path(b).parent.mkdir(parents=True, exist_ok=True)
        if sink == "stata":
            write_stata(_READ[source](spark, a), b)
        else:
            _WRITE[sink](_READ[source](spark, a), b, overwrite=True)

    done = Conversion()
    if mode == "single":
        if not input_path:
            raise InputValidationError("input_path is needed")
        out = output_path or str(Path(input_path).with_suffix(SUFFIX[sink]))
        one(input_path, out)
        done.converted.append(out)
        return done
    if not input_folder or not Path(input_folder).is_dir():
        raise InputValidationError("input_folder must be a folder")
    root, target = Path(input_folder), Path(output_folder or input_folder)
    for p in sorted(root.glob(("**/*" if include_subfolders else "*") + SUFFIX[source])):
        out = str((target / p.relative_to(root)).with_suffix(SUFFIX[sink]))
        try:
            one(str(p), out)
            done.converted.append(out)
        except Exception as e:
            if fail_fast:
                raise
            done.failed[str(p)] = str(e).splitlines()[0]
    if not done.converted:
        raise InputValidationError(f"nothing was converted: {done.failed or 'no files'}")
    return done


def check_manifest(folder: str, expected: Sequence[str]) -> dict[str, str]:
    """Path of each expected file (names compared without case); missing ones are an error that lists what is there."""
    there = {p.name.lower(): str(p) for p in Path(folder).glob("*")} if Path(folder).is_dir() else {}
    missing = [f for f in expected if f.lower() not in there]
    if missing:
        raise InputValidationError(f"missing in {folder}: {', '.join(missing)}; expected {len(expected)} files, found {', '.join(sorted(there)) or 'none'}")
    return {f: there[f.lower()] for f in expected}


def write_json(value, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str, sort_keys=True))
    return path


def write_text(text: str, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return path
