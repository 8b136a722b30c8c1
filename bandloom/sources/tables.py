"""Scans with fixed schemas, and the parsing that goes with them."""

from __future__ import annotations

import fnmatch
import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUND_META = "study string, date_image string, plot_id bigint, trt string, rate_n_pp_kgha double, rate_n_sd_plan_kgha double, rate_n_total_kgha double, growth_stage string"


def read_csv(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; columns are matched by each file's own header and never inferred.

    Empty cells and ``NA`` are null. Any other cell that its type cannot read is an
    error: it would otherwise pass for a missing value.
    """
    fields, out = T.StructType.fromDDL(schema).fields, None
    for path in [paths] if isinstance(paths, str) else paths:
        header = spark.read.option("header", True).csv(path)
        cell = lambda f: F.when(~F.trim(f"`{f.name}`").isin("", "NA"), F.trim(f"`{f.name}`"))
        part = header.select(*[_strict(cell(f), f.dataType).alias(f.name) for f in fields])
        out = part if out is None else out.unionByName(part)
    return out


def _strict(text: Column, kind: T.DataType) -> Column:
    value = text.try_cast(kind)
    unreadable = F.raise_error(F.concat(F.lit("unreadable cell: "), text)).cast(kind)
    return F.when(text.isNotNull() & value.isNull(), unreadable).otherwise(value)


def stack_ground(frames: list[DataFrame], response: str, meta: list[str]) -> DataFrame:
    """Ground-truth sheets stacked: rows with a response, dates as yyyymmdd."""
    out = None
    for f in frames:
        part = f.select(*meta, response).filter(F.col(response).isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.withColumn("date", F.regexp_replace("date_image", "-", "")).drop("date_image")


def scan_ground(spark: SparkSession, paths: list[str], response: str = "biomass_kgha") -> DataFrame:
    """Ground-truth CSV files of several studies as one table."""
    schema = f"{GROUND_META}, {response} double"
    meta = [f.name for f in T.StructType.fromDDL(GROUND_META).fields]
    return stack_ground([read_csv(spark, p, schema) for p in paths], response, meta)


def scan_spectra(spark: SparkSession, path: str, grid_idx: int | None = None, feat: str | None = None) -> DataFrame:
    """Stored spectra; scenario and feature set are partition filters."""
    df = spark.read.parquet(path)
    if grid_idx is not None:
        df = df.filter(F.col("grid_idx") == grid_idx)
    return df if feat is None else df.filter(F.col("feat") == feat)


def crop_sheet(df: DataFrame, date: str, parts: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Crop instructions: date text to a date, folder parts to one path."""
    return df.withColumns({"date": F.to_date(date, fmt), "directory": F.concat_ws("/", *[F.col(p) for p in parts])})


def image_key(df: DataFrame, fname: str = "fname") -> DataFrame:
    """Study, date and plot parsed from an image file name."""
    part = lambda pattern: F.regexp_extract(fname, pattern, 1)
    return df.withColumns(
        {
            "study": part(r"study_(.*?)_date_"),
            "date": part(r"_date_(.*?)_plot_"),
            "plot_id": part(r"_plot_(\d+)").try_cast("bigint"),
        }
    )


def key_stem(fname: str | Column) -> Column:
    """File name up to the first dash: the image it was made from."""
    return F.substring_index(F.col(fname) if isinstance(fname, str) else fname, "-", 1)


def band_columns(df: DataFrame) -> list[str]:
    """Columns whose heading is a number, in numeric order."""
    return sorted((c for c in df.columns if c.isnumeric()), key=int)


def wide_to_long(df: DataFrame, value: str = "value") -> DataFrame:
    """Wide spectra (one column per band) to one row per band."""
    bands = band_columns(df)
    ids = [F.col(f"`{c}`") for c in df.columns if c not in bands]
    return df.unpivot(ids, [F.col(f"`{b}`") for b in bands], "band", value).withColumn("band", F.col("band").cast("bigint"))


def wide_to_array(df: DataFrame, out: str = "refl") -> DataFrame:
    """Wide spectra to one array column in band order."""
    bands = band_columns(df)
    return df.select(*[f"`{c}`" for c in df.columns if c not in bands], F.array(*[F.col(f"`{b}`") for b in bands]).alias(out))


def file_inventory(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """Files under a folder with their size, empty ones too; contents are not read.

    The driver lists the first level only; each folder on it is listed by a task.
    """
    uri = base if ":" in base.split("/")[0] else f"file://{os.path.abspath(base)}"
    system, root = fs.FileSystem.from_uri(uri)
    top = system.get_file_info(fs.FileSelector(root))
    folders = [(x.path,) for x in top if x.type == fs.FileType.Directory]
    files = [(x.path, x.size) for x in top if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)]

    def walk(batches):
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            found = [x for folder in batch.column(0).to_pylist() for x in store.get_file_info(fs.FileSelector(folder, recursive=True))]
            found = [x for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.path for x in found], pa.string()), pa.array([x.size for x in found], pa.int64())], names=["path", "length"]
            )

    below = spark.createDataFrame(folders, "folder string").repartition(max(len(folders), 1)).mapInArrow(walk, "path string, length bigint")
    return spark.createDataFrame(files, "path string, length bigint").unionByName(below)


# Unit names of printed sizes.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]


def readable_size(length: Column) -> Column:
    """Bytes as text with a unit, two decimals."""
    step = F.when(length > 0, F.floor(F.log(1024.0, length))).otherwise(0).cast("int")
    number = F.round(length / F.pow(F.lit(1024.0), step), 2)
    return F.when(length == 0, "0B").otherwise(F.concat_ws(" ", number.cast("string"), F.element_at(F.array(*[F.lit(u) for u in UNITS]), step + 1)))


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns of a run-result table by their name prefix."""
    return {r: [c for c in df.columns if c.startswith(r)] for r in ("like", "par", "sim")}


def scan_run_results(df: DataFrame, ids: list[str], only: str | None = None) -> DataFrame:
    """Run results in long form (ids, role, name, value), optionally one role only."""
    chosen = {r: cs for r, cs in roles(df).items() if only in (None, r)}
    names = [c for cs in chosen.values() for c in cs]
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(ids, names, "name", "value")
    role = F.substring("name", 1, 3)
    return long.withColumn("role", F.when(role == "lik", "like").otherwise(role))
