"""A1–A5: reading, source loading, contract writing, model persistence, run stamps."""
from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.sources import publish
from riskweave.sources.typed_csv import read_csv

LOG = logging.getLogger(__name__)


def normalize_nan(df: DataFrame) -> DataFrame:
    """Map float NaN to SQL NULL so there is one notion of "missing" (pandas parity)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None,
               tolerance: float = 0.0, rejects_path: str | None = None) -> DataFrame:
    """A1: lazily read a Parquet or CSV table, the current version of a published one; a missing path raises FileNotFoundError.

    CSV columns that ``schema`` does not name get the types that their values fit (one pass over the file, see
    :mod:`riskweave.sources.typed_csv`). Rows that do not fit are written to ``rejects_path``; without one the read fails on the first.
    """
    publish.repaired(spark, path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"table not found: {path}")
    fmt = fmt or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    path = publish.current(spark, path)
    if fmt == "csv":
        rows, rejected = read_csv(spark, path, schema, tolerance, strict=rejects_path is None)
        if rejects_path is not None:
            write_contract(rejected, rejects_path)
        return rows
    reader = spark.read if schema is None else spark.read.schema(schema)
    return normalize_nan(reader.format(fmt).load(path))


@dataclass
class SourceSpec:
    path: str
    enabled: bool = True
    fmt: str | None = None
    schema: T.StructType | str | None = None


@dataclass
class SourcesConfig:
    base_path: str
    sources: dict[str, SourceSpec] = field(default_factory=dict)
    id_col: str = "SK_ID_CURR"
    base_fmt: str | None = None
    base_schema: T.StructType | str | None = None
    #: Share of a CSV column's values that may fail to parse before the column is text.
    tolerance: float = 0.0
    #: Folder of the rejected rows, one table a CSV source; without it a row that does not fit fails the read.
    rejects_dir: str | None = None


def load_sources(spark: SparkSession, cfg: SourcesConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A2: base table (required) plus every enabled source whose path exists.

    Disabled sources are skipped silently; enabled-but-missing ones are
    skipped with a warning. Parquet is not read eagerly; CSV takes one pass for the types its schema leaves open.
    """
    def read(name: str, path: str, schema, fmt) -> DataFrame:
        rejects = os.path.join(cfg.rejects_dir, name) if cfg.rejects_dir else None
        return read_table(spark, path, schema, fmt, cfg.tolerance, rejects)

    base = read("base", cfg.base_path, cfg.base_schema, cfg.base_fmt)
    loaded: dict[str, DataFrame] = {}
    for name, spec in cfg.sources.items():
        if not spec.enabled:
            continue
        if not path_exists(spark, spec.path):
            LOG.warning("source %r enabled but missing (%s); skipping", name, spec.path)
            continue
        loaded[name] = read(name, spec.path, spec.schema, spec.fmt)
    return base, loaded


def write_contract(df: DataFrame, path: str, fmt: str = "parquet", report_sized: bool = False,
                   sort_cols: list[str] | None = None) -> str:
    """A3: write one stable, header-ed table; the table before stays readable until the new one is whole.

    Report-sized outputs (a handful of rows) are coalesced to one file so
    BI tools see a single CSV; row-per-applicant outputs keep their
    partitioning so the write stays parallel.
    """
    out = df
    if sort_cols:
        out = out.orderBy(*sort_cols)
    if report_sized:
        out = out.coalesce(1)
    return publish.replace(out, path, fmt)


def save_model(model, path: str) -> str:
    """A4: persist a fitted Spark ML model/pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """A4: load a persisted PipelineModel."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def new_run_stamp(now: datetime | None = None) -> tuple[str, str]:
    """(run_id, created_at) in the contract format: YYYYmmdd_HHMMSS and ISO seconds UTC."""
    now = now or datetime.now(timezone.utc)
    return now.strftime("%Y%m%d_%H%M%S"), now.isoformat(timespec="seconds")


def run_stamp(df: DataFrame, run_id: str, created_at: str) -> DataFrame:
    """A5: prepend run_id and created_at literal columns (deterministic when passed in)."""
    return df.select(F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"), "*")


def model_run_row(spark: SparkSession, *, run_id: str, created_at: str, label: str, model_type: str,
                  numeric_features: list[str], categorical_features: list[str],
                  metrics: dict[str, float], train_seconds: float) -> DataFrame:
    """A5: one-row run-metadata DataFrame to append to a runs table."""
    schema = T.StructType([
        T.StructField("run_id", T.StringType()), T.StructField("label", T.StringType()),
        T.StructField("created_at", T.StringType()), T.StructField("model_type", T.StringType()),
        T.StructField("numeric_features", T.ArrayType(T.StringType())),
        T.StructField("categorical_features", T.ArrayType(T.StringType())),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("train_time_seconds", T.DoubleType()),
    ])
    row = (run_id, label, created_at, model_type, list(numeric_features), list(categorical_features),
           len(numeric_features) + len(categorical_features),
           {k: float(v) for k, v in metrics.items() if v is not None}, round(float(train_seconds), 3))
    return spark.createDataFrame([row], schema)


def report_round(c: Column, digits: int = 6) -> Column:
    """Half-up rounding after snapping to 9 decimals, so float summation noise
    (which differs with partitioning) cannot flip a value sitting on a half."""
    from riskweave.functions.expr import rround
    return rround(c, digits)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report projection: round every double column (summation order differs across partitions)."""
    return df.select(*[
        report_round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
