"""Histories stored by applicant, so that rolling them up and joining them moves no history row.

Each history is dealt once into ``buckets`` by the hash of its applicant and written sorted within buckets, as a table of the
session's catalog. A roll-up of such a table groups rows where they lie, and roll-ups of tables with one bucket number join
without an exchange. The bureau's monthly balances are keyed by credit, not by applicant: they are rolled up by credit as before.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Histories that carry the applicant's id themselves.
BY_APPLICANT = ("application", "previous_application", "installments_payments", "pos_cash_balance", "credit_card_balance")


def store(df: DataFrame, table: str, id_col: str = "SK_ID_CURR", buckets: int = 200, path: str | None = None) -> DataFrame:
    """Write df as a bucketed, sorted table (managed, or at ``path``) and return it."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    # dealt by the bucket's own hash, so a task writes one file of one bucket
    writer = df.repartition(buckets, id_col).write.mode("overwrite").format("parquet").bucketBy(buckets, id_col).sortBy(id_col)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def store_histories(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "riskweave_", id_col: str = "SK_ID_CURR", buckets: int = 200,
                    folder: str | None = None) -> dict[str, DataFrame]:
    """The tables under their names, those by applicant stored in buckets, the others as they are."""
    return {name: store(df, prefix + name, id_col, buckets, f"{folder}/{name}" if folder else None) if name in BY_APPLICANT else df
            for name, df in tables.items()}
