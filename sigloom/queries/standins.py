"""Signal-like tables derived from the driver's tables, and the same as SQL (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ["value", "k", "ref"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epochs(spark: SparkSession, sf_dir: str, n_channels: int = 4) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        v.alias("vec_id"), (v % 20).alias("subject_id"), F.floor(v / 40).alias("event_id"), (F.col("label") % 2).cast("long").alias("label"), ((v % 101) / 100).alias("sample_weight"),
        (F.floor(v / 20) % 6 == 0).alias("is_background"), (v % 3 == 0).alias("is_right_hand"), (v % 5 == 0).alias("is_point"),
        F.lit(n_channels).alias("n_channels"), (F.size("embedding") / n_channels).cast("int").alias("n_times"), F.col("embedding").cast("array<double>").alias("sample"),
    )


EPOCHS_SQL = """epochs AS (
    SELECT vec_id, vec_id % 20 AS subject_id, vec_id // 40 AS event_id, CAST(label % 2 AS BIGINT) AS label, (vec_id % 101) / 100 AS sample_weight,
           (vec_id // 20) % 6 = 0 AS is_background, vec_id % 3 = 0 AS is_right_hand, vec_id % 5 = 0 AS is_point, CAST(embedding AS DOUBLE[]) AS sample
    FROM embeddings)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order line as rows of two classifiers: supplier as subject, order as event."""
    flag = lambda c: c.cast("int")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.col("l_orderkey").alias("event_id"), (F.row_number().over(order) - 1).cast("long").alias("sample_index"), flag(F.col("l_returnflag") == "R").alias("true_label"),
        flag(F.col("l_discount") > 0.05).alias("predicted_label"), flag(F.col("l_tax") > 0.04).alias("predicted_b"), F.col("l_discount").alias("proba"), (F.col("l_quantity") / 50).alias("sample_weight"),
    )


PREDICTIONS_SQL = """pred AS (
    SELECT l_suppkey AS subject_id, l_orderkey AS event_id,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS sample_index,
           CAST(l_returnflag = 'R' AS INTEGER) AS true_label, CAST(l_discount > 0.05::DOUBLE AS INTEGER) AS predicted_label, CAST(l_tax > 0.04::DOUBLE AS INTEGER) AS predicted_b,
           l_discount AS proba, l_quantity / 50 AS sample_weight
    FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as three-channel samples of a session per user; channel 0 has runs of missing values."""
    e = read(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 37 < 2, F.lit(float("nan"))).otherwise(F.col("value"))
    k = F.get_json_object("props", "$.k").cast("double")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id"), "event_type", seconds.alias("ts"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.array(value, k, (F.col("event_id") % 97).cast("double")).alias("x")
    )


SAMPLES_SQL = """samples AS (
    SELECT user_id AS session_id, event_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY events.ts, event_id) - 1 AS idx,
           CASE WHEN event_id % 37 < 2 THEN 'nan'::DOUBLE ELSE value END AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(event_id % 97 AS DOUBLE) AS ref
    FROM events)"""

# Codes and states of the machine whose state is its last code.
CODES = {"signup": 1, "view": 2, "click": 3, "purchase": 4, "error": -1}
STATES = {1: "Enrol", 2: "Rest", 3: "Imagery", 4: "Point"}


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])
    return samples(spark, sf_dir).select("session_id", "ts", "event_id", code[F.col("event_type")].alias("code"))


MARKERS_SQL = f"markers AS (SELECT session_id, ts, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items())} END AS code FROM samples)"

# What each kind of event is called in an annotation.
NAMES = {"view": "Rest@@left/hand", "click": "Image@@right/hand#VAS=", "purchase": "Point@@left/hand#VAS=", "signup": "Background@@", "error": "other"}


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx``: whole seconds since the user's first event."""
    s = samples(spark, sf_dir)
    start = F.min("ts").over(Window.partitionBy("session_id"))
    name = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    text = F.when(F.endswith(name, F.lit("=")), F.concat(name, F.col("x")[1].cast("int").cast("string"))).otherwise(name)
    return s.select(F.col("session_id").alias("subject_id"), "event_id", F.floor(F.col("ts") - start).alias("idx"), text.alias("description"))


ANNOTATIONS_SQL = f"""annotations AS (
    SELECT session_id AS subject_id, event_id, CAST(floor(ts - min(ts) OVER (PARTITION BY session_id)) AS BIGINT) AS idx,
           CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" + (" || CAST(CAST(k AS INTEGER) AS VARCHAR)" if v.endswith("=") else "") for k, v in NAMES.items())} END AS description
    FROM samples)"""
