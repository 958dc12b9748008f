"""Driver tables reshaped to the lending schemas (customer = applicant, orders = credits, ...).

The driver's TPC-H-ish tables carry no NULLs, so these projections also
plant the traps the lending operators must survive: zero denominators,
NULL statuses, score ties and a constant column (customers without orders
or events are the join misses). Each is a pure projection of whole tables
(plus one equi-join) that Catalyst prunes down to the columns needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.expr import rround
from riskweave.sources.io import table_path

# Fixed reference date the day offsets are measured from.
EPOCH = "2001-12-31"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _days_since_epoch(col: str) -> Column:
    # b - a in days with a = EPOCH, b = the event date
    return F.datediff(F.col(col).cast("date"), F.lit(EPOCH).cast("date"))


def _target(acctbal: str = "c_acctbal") -> Column:
    return F.when(F.col(acctbal) < 0, F.lit(1)).otherwise(F.lit(0))


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("SK_ID_CURR"),
        _target().alias("TARGET"),
        (F.lit(1000) + (k * 7919) % 90001).cast("double").alias("AMT_INCOME_TOTAL"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(5000) + (k * 104729) % 500009).cast("double")).alias("AMT_CREDIT"),
        (-(F.lit(6570) + (k * 7919) % 20000)).alias("DAYS_BIRTH"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("CODE_GENDER"),
        F.col("c_nationkey").alias("REGION_CODE"),
        F.lit(1).alias("FLAG_MOBIL"),
    )


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    st, key, price = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        key.alias("SK_ID_BUREAU"),
        F.when(st == "O", "Active").when(st == "F", "Closed").alias("CREDIT_ACTIVE"),
        F.when(st == "O", price).when(st == "F", F.lit(0.0)).alias("AMT_CREDIT_SUM_DEBT"),
        price.alias("AMT_CREDIT_SUM"),
        (key % 7).alias("CREDIT_DAY_OVERDUE"),
        F.when(key % 7 > 4, price * 0.1).otherwise(F.lit(0.0)).alias("AMT_CREDIT_SUM_OVERDUE"),
        _days_since_epoch("o_orderdate").alias("DAYS_CREDIT"),
    )


def bureau_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        F.when(F.col("l_linestatus") == "F", F.lit("C"))
         .otherwise((F.col("l_linenumber") % 6).cast("string")).alias("STATUS"),
    )


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    st, key, price = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.when(st == "F", "Approved").when(st == "P", "Refused").alias("NAME_CONTRACT_STATUS"),
        F.when(key % 10 == 0, F.lit(0.0)).otherwise(price).alias("AMT_APPLICATION"),
        F.when(st == "P", F.lit(0.0)).otherwise(price * 0.9).alias("AMT_CREDIT"),
        _days_since_epoch("o_orderdate").alias("DAYS_DECISION"),
    )


def installments_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice", "l_discount")
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        _days_since_epoch("o_orderdate").alias("DAYS_INSTALMENT"),
        F.when(F.col("l_linenumber") == 5, F.lit(None).cast("int"))
         .otherwise(_days_since_epoch("l_shipdate")).alias("DAYS_ENTRY_PAYMENT"),
        F.when(F.col("l_partkey") % 13 == 0, F.lit(0.0))
         .otherwise(F.col("l_extendedprice")).alias("AMT_INSTALMENT"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("AMT_PAYMENT"),
    )


def pos_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("user_id").alias("SK_ID_CURR"),
        F.when(et == "error", F.floor("value").cast("int"))
         .when(et == "signup", F.lit(None).cast("int")).otherwise(F.lit(0)).alias("SK_DPD"),
    )


def credit_card_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("user_id").alias("SK_ID_CURR"),
        F.col("value").alias("AMT_BALANCE"),
        F.when(et == "signup", F.lit(0.0)).otherwise(F.lit(100.0)).alias("AMT_CREDIT_LIMIT_ACTUAL"),
        F.when(et == "error", F.lit(1)).otherwise(F.lit(0)).alias("SK_DPD"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table with a continuous base score per applicant (one in eight tied at a coarse value) and a class-dependent lift."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lift = F.when(F.col("c_acctbal") < 0, F.lit(0.24)).otherwise(F.lit(0.0))
    return c.select(
        k.alias("application_id"),
        _target().alias("y_true"),
        rround(F.lit(0.75) * F.when(k % 8 == 0, (k % 97) / F.lit(97.0)).otherwise(
            ((k * 7919) % 999983) / F.lit(999983.0)) + lift, 6).alias("y_proba"),
    )


def ml_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnable fixture: labels ⋈ documents, y = 1 - quality, text-shape features."""
    lab = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    j = lab.join(doc, "doc_id", "inner")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    other = n - F.length(F.regexp_replace(text, "[^a-zA-Z ]", ""))
    return j.select(
        F.col("doc_id").alias("SK_ID_CURR"),
        (F.lit(1) - F.col("quality")).cast("int").alias("TARGET"),
        F.col("n_chars").cast("double").alias("N_CHARS"),
        F.try_divide(other.cast("double"), n.cast("double")).alias("OTHER_CHAR_SHARE"),
        (n - F.length(F.regexp_replace(text, "\n", ""))).cast("double").alias("N_NEWLINES"),
        F.col("lang").alias("NAME_LANG"),
        F.col("source").alias("NAME_SOURCE"),
    )


ALL = {
    "application": application,
    "bureau": bureau,
    "bureau_balance": bureau_balance,
    "previous_application": previous_application,
    "installments_payments": installments_payments,
    "pos_cash_balance": pos_cash_balance,
    "credit_card_balance": credit_card_balance,
    "predictions": predictions,
}


def lending_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six one-to-many sources keyed like the feature-source config."""
    return {name: ALL[name](spark, sf_dir) for name in (
        "bureau", "bureau_balance", "previous_application", "installments_payments",
        "pos_cash_balance", "credit_card_balance")}


def predictions_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weaker second scorer over the same applicants (for model comparisons)."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lift = F.when(F.col("c_acctbal") < 0, F.lit(0.06)).otherwise(F.lit(0.0))
    return c.select(
        k.alias("application_id"),
        _target().alias("y_true"),
        rround(F.lit(0.9) * (((k * 104729) % 1013) / F.lit(1013.0)) + lift, 6).alias("y_proba"),
    )


def scored_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores side by side per applicant (raw = champion, alt = baseline)."""
    a = predictions(spark, sf_dir)
    b = predictions_baseline(spark, sf_dir).select("application_id", F.col("y_proba").alias("y_proba_alt"))
    return a.join(b, "application_id", "inner")
