"""Sparse tables made from the shared test tables, and the same in SQL.

events: a row per event, label 1 for purchases, five features (user, hour, weekday, tenth of the value, props.k) of groups 0 to 4 in 12 low bits, and values that depend on the id.
model: a weight and four more numbers per feature of events, all functions of the id, so that any engine has the same model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ids import encode_group
from millrace.operators.features import feature_counts, triples
from millrace.session import table

DIM, EMBEDDED = 4, 60


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    parts = [F.col("user_id"), F.hour("ts"), F.weekday("ts"), F.floor(F.col("value") / 10), F.get_json_object("props", "$.k")]
    val = 1 + F.pmod("event_id", F.lit(3)) * 0.5
    items = F.array(*(F.struct(encode_group(p.cast("bigint"), F.lit(g), 12).alias("idx"), val.alias("val")) for g, p in enumerate(parts)))
    return e.select(F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").cast("double").alias("label"), items.alias("features"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return triples(event_rows(spark, d))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return event_rows(spark, d).select("row_id", "label")


def weight(fid: str = "fid"):
    return (F.pmod(F.col(fid) * 7919, F.lit(1000)) - 500) / 1000.0


def embedding(fid: str = "fid"):
    return F.array(*((F.pmod(F.col(fid) * (j + 3), F.lit(100)) - 50) / 1000.0 for j in range(DIM)))


def model(spark: SparkSession, d: str) -> DataFrame:
    """fid, cnt, w, v; v is null for features counted at most EMBEDDED times."""
    return feature_counts(events(spark, d)).select("fid", "cnt", weight().alias("w"), F.when(F.col("cnt") > EMBEDDED, embedding()).alias("v"))


EVENTS = """
src AS (SELECT event_id AS row_id, (event_type = 'purchase')::INTEGER::DOUBLE AS label, 1 + (event_id % 3) * 0.5::DOUBLE AS val,
    unnest([user_id * 4096, hour(ts) * 4096 + 1, (isodow(ts) - 1) * 4096 + 2, floor(value / 10)::BIGINT * 4096 + 3, json_extract_string(props, '$.k')::BIGINT * 4096 + 4]) AS fid FROM events),
ev AS (SELECT row_id, label, fid::BIGINT AS fid, val::DOUBLE AS val FROM src WHERE fid IS NOT NULL),
rw AS (SELECT event_id AS row_id, (event_type = 'purchase')::INTEGER::DOUBLE AS label FROM events),
cn AS (SELECT fid, count(*) AS cnt FROM ev GROUP BY fid),
md AS (SELECT fid, cnt, ((fid * 7919) % 1000 - 500) / 1000.0::DOUBLE AS w, CASE WHEN cnt > 60 THEN ((fid * 3) % 100 - 50) / 1000.0::DOUBLE END AS v0, CASE WHEN cnt > 60 THEN ((fid * 4) % 100 - 50) / 1000.0::DOUBLE END AS v1,
    CASE WHEN cnt > 60 THEN ((fid * 5) % 100 - 50) / 1000.0::DOUBLE END AS v2, CASE WHEN cnt > 60 THEN ((fid * 6) % 100 - 50) / 1000.0::DOUBLE END AS v3 FROM cn)
"""
#: lm: margins of the linear model; ls: with y and the loss's first and second derivative. fm, fs: the same of the model with embeddings.
MARGINS = (
    EVENTS
    + """,
lm AS (SELECT rw.row_id, rw.label, coalesce(sum(val * w), 0.0) AS margin FROM rw LEFT JOIN (SELECT ev.row_id, ev.val, md.w FROM ev JOIN md USING (fid)) e ON rw.row_id = e.row_id GROUP BY rw.row_id, rw.label),
ly AS (SELECT *, CASE WHEN label > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM lm),
ls AS (SELECT *, -y / (1 + exp(y * margin)) AS p FROM ly),
fj AS (SELECT ev.row_id, sum(val * w) AS s, """
    + ", ".join(f"coalesce(sum(val * v{j}), 0) AS s{j}, coalesce(sum(val * val * v{j} * v{j}), 0) AS q{j}" for j in range(DIM))
    + """ FROM ev JOIN md USING (fid) GROUP BY ev.row_id),
fm AS (SELECT rw.row_id, rw.label, """
    + ", ".join(f"coalesce(s{j}, 0.0) AS s{j}" for j in range(DIM))
    + ", greatest(least(coalesce(s + 0.5 * ("
    + " + ".join(f"s{j} * s{j} - q{j}" for j in range(DIM))
    + """), 0.0), 20.0), -20.0)::DOUBLE AS margin FROM rw LEFT JOIN fj USING (row_id)),
fs AS (SELECT *, -(CASE WHEN label > 0 THEN 1.0 ELSE -1.0 END) / (1 + exp((CASE WHEN label > 0 THEN 1.0 ELSE -1.0 END) * margin)) AS p FROM fm)
"""
)
