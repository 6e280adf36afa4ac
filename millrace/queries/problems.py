"""Queries of the general data-processing problems 3 and 5, with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ids import decode_group, reverse_id
from millrace.operators.hotkeys import eager_join, key_state, overloaded, rolled_up
from millrace.session import table
from millrace.sources.lines import examples, parse_lines, rejects

SHARE = 0.025


def _keys(spark: SparkSession, d: str, groups: bool = True) -> DataFrame:
    left, right = (("batch_id", "epoch") if groups else (None, None))
    return eager_join(key_state(table(spark, d, "batch_feaids"), "fid", left, "val", 1.0), key_state(table(spark, d, "fea_blocks"), "fid", right, "delta"))


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per fid, null too: rows, batches and sum of val, rows, epochs and sum of delta, and what a join of both tables would count and sum."""
    k = _keys(spark, d)
    r = lambda c, n: F.round(c, 4).alias(n)
    return k.select(
        F.col("key").alias("fid"), F.col("left_rows").alias("batch_rows"), F.col("left_groups").alias("batches"), r("left_total", "sum_val"), F.col("right_rows").alias("block_rows"),
        F.col("right_groups").alias("epochs"), r("right_total", "sum_delta"), F.col("pairs").cast("double").alias("joined_rows"), F.round("left_pair_total", 2).alias("joined_val"), F.round("right_pair_total", 2).alias("joined_delta"),
    )


def p3_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What a join of both tables by feature group would give, rolled up by 64 groups, without making it: groups, joined rows, and the sums of val and of delta over them. The null group of null ids meets itself."""
    state = lambda t, value, default: key_state(table(spark, d, t).withColumn("grp", decode_group(reverse_id("fid"), 12)), "grp", None, value, default)
    k = rolled_up(eager_join(state("batch_feaids", "val", 1.0), state("fea_blocks", "delta", None)), F.floor(F.col("key") / 64))
    return k.select(F.col("part").alias("part"), F.col("keys").alias("grps"), F.col("pairs").cast("double").alias("joined_rows"), F.round("left_pair_total", 2).alias("sum_val"), F.round("right_pair_total", 2).alias("sum_delta"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    total = lambda t: table(spark, d, t).agg(F.count("fid").alias("of")).scalar()
    return overloaded(_keys(spark, d, groups=False), {"batch": ("left", total("batch_feaids")), "feablk": ("right", total("fea_blocks"))}, SHARE).select("field", F.col("key").alias("fid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects(parse_lines(table(spark, d, "raw_lines"))).select("line_id", "reason")


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The failing lines with their whole text."""
    return rejects(parse_lines(table(spark, d, "raw_lines")))


def p5_examples(spark: SparkSession, d: str) -> DataFrame:
    """One row per id of each valid line, and one without id for a line that has none."""
    e = examples(parse_lines(table(spark, d, "raw_lines")))
    return e.select("line_id", "label", F.posexplode_outer("features").alias("pos", "x")).select("line_id", "label", "pos", F.col("x.idx").alias("idx"), F.col("x.val").alias("val"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines per format and reason; valid is the reason of the others."""
    return parse_lines(table(spark, d, "raw_lines")).groupBy("fmt", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


QUERIES = {f.__name__: f for f in (p3_keys, p3_rollup, p3_found, p5_found, p5_rejects, p5_examples, p5_report)}

_NUMBER = r"(regexp_full_match({0}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast({0} AS DOUBLE)), false))"
_ID = r"(regexp_full_match({0}, '[0-9]+') AND try_cast(coalesce(nullif(ltrim({0}, '0'), ''), '0') AS UBIGINT) IS NOT NULL)"
LINES = r"""
WITH r AS (SELECT *, coalesce(trim(raw, E' \t\r\n') = '', true) AS blank,
    CASE WHEN fmt IN ('libsvm', 'adfea') THEN string_split_regex(trim(raw, E' \t\r\n'), '[ \t\r\n]+') END AS tok,
    CASE WHEN fmt IN ('criteo', 'criteo_test') THEN E'\t' || regexp_replace(raw, '[\r\n]+$', '') END AS line FROM raw_lines),
f AS (SELECT *, regexp_full_match(line, '(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS well,
    list_transform(regexp_extract_all(line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS fld FROM r),
v AS (SELECT *, CASE fmt WHEN 'libsvm' THEN tok[2:] WHEN 'adfea' THEN tok[4:] END AS items, CASE fmt WHEN 'criteo' THEN fld[2:] ELSE fld END AS vals FROM f),
judged AS (SELECT line_id, file_name, fmt, raw, tok, items, fld, vals, CASE
    WHEN blank THEN 'empty'
    WHEN fmt IS NULL OR fmt NOT IN ('libsvm', 'adfea', 'criteo', 'criteo_test') THEN 'format'
    WHEN fmt IN ('libsvm', 'adfea') AND contains(raw, '"') THEN 'quoting'
    WHEN fmt IN ('criteo', 'criteo_test') AND NOT well THEN 'quoting'
    WHEN fmt = 'adfea' AND (len(tok) < 3 OR NOT coalesce(regexp_full_match(tok[2], '[0-9]+') AND coalesce(nullif(ltrim(tok[2], '0'), ''), '0') = (len(tok) - 3)::VARCHAR, false)) THEN 'columns'
    WHEN fmt = 'criteo' AND len(fld) <> 40 OR fmt = 'criteo_test' AND len(fld) <> 39 THEN 'columns'
    WHEN fmt = 'libsvm' AND NOT """ + _NUMBER.format("tok[1]") + r""" THEN 'label'
    WHEN fmt = 'adfea' AND tok[3] NOT IN ('0', '1') THEN 'label'
    WHEN fmt = 'criteo' AND NOT """ + _NUMBER.format("fld[1]") + r""" THEN 'label'
    WHEN fmt IN ('libsvm', 'adfea') AND len(list_filter(items, lambda x: NOT """ + _ID.format("split_part(x, ':', 1)") + r""")) > 0 THEN 'index'
    WHEN fmt = 'libsvm' AND len(list_filter(items, lambda x: contains(x, ':') AND NOT """ + _NUMBER.format("x[instr(x, ':') + 1:]") + r""")) > 0 THEN 'value'
    WHEN fmt = 'adfea' AND len(list_filter(items, lambda x: NOT (contains(x, ':') AND regexp_full_match(x[instr(x, ':') + 1:], '[0-9]+')
        AND coalesce(try_cast(x[instr(x, ':') + 1:] AS DOUBLE), 5000) <= 4095))) > 0 THEN 'value'
    WHEN fmt LIKE 'criteo%' AND (len(list_filter(vals[1:13], lambda x: x <> '' AND NOT (regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS BIGINT) IS NOT NULL))) > 0
        OR len(list_filter(vals[14:], lambda x: x <> '' AND length(x) <> 8)) > 0) THEN 'value'
    END AS reason FROM v)
"""
_STATES = """
WITH b AS (SELECT fid, count(*) AS n, count(DISTINCT batch_id) AS g, sum(coalesce(val, 1.0)) AS s FROM batch_feaids GROUP BY fid),
f AS (SELECT fid, count(*) AS n, count(DISTINCT epoch) AS g, coalesce(sum(delta), 0.0) AS s FROM fea_blocks GROUP BY fid)
"""
SQL = {
    "p3_keys": _STATES
    + """SELECT coalesce(b.fid, f.fid) AS fid, coalesce(b.n, 0)::BIGINT AS batch_rows, coalesce(b.g, 0)::BIGINT AS batches, round(coalesce(b.s, 0.0), 4)::DOUBLE AS sum_val,
    coalesce(f.n, 0)::BIGINT AS block_rows, coalesce(f.g, 0)::BIGINT AS epochs, round(coalesce(f.s, 0.0), 4)::DOUBLE AS sum_delta,
    (coalesce(b.n, 0)::DOUBLE * coalesce(f.n, 0)::DOUBLE) AS joined_rows, round(coalesce(b.s, 0) * coalesce(f.n, 0), 2)::DOUBLE AS joined_val, round(coalesce(f.s, 0) * coalesce(b.n, 0), 2)::DOUBLE AS joined_delta FROM b FULL JOIN f ON b.fid IS NOT DISTINCT FROM f.fid""",
    "p3_rollup": """WITH b AS (SELECT (('0x' || reverse(lpad(hex(fid), 16, '0')))::UBIGINT % 4096)::BIGINT AS g, count(*)::DOUBLE AS n, sum(coalesce(val, 1.0)) AS s FROM batch_feaids GROUP BY 1),
    f AS (SELECT (('0x' || reverse(lpad(hex(fid), 16, '0')))::UBIGINT % 4096)::BIGINT AS g, count(*)::DOUBLE AS n, coalesce(sum(delta), 0.0) AS s FROM fea_blocks GROUP BY 1)
    SELECT (f.g // 64)::BIGINT AS part, count(*) AS grps, sum(b.n * f.n) AS joined_rows, round(sum(b.s * f.n), 2)::DOUBLE AS sum_val, round(sum(f.s * b.n), 2)::DOUBLE AS sum_delta FROM b JOIN f ON b.g IS NOT DISTINCT FROM f.g GROUP BY 1""",
    "p3_found": """SELECT 'batch' AS field, fid FROM batch_feaids WHERE fid IS NOT NULL GROUP BY fid HAVING count(*) >= 0.025 * (SELECT count(fid) FROM batch_feaids)
    UNION ALL SELECT 'feablk', fid FROM fea_blocks WHERE fid IS NOT NULL GROUP BY fid HAVING count(*) >= 0.025 * (SELECT count(fid) FROM fea_blocks)""",
    "p5_found": LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_rejects": LINES + "SELECT line_id, file_name, fmt, reason, raw FROM judged WHERE reason IS NOT NULL",
    "p5_report": LINES + "SELECT fmt, coalesce(reason, 'valid') AS reason, count(*) AS lines FROM judged GROUP BY ALL",
    "p5_examples": LINES
    + r""", good AS (SELECT line_id, fmt, CASE fmt WHEN 'libsvm' THEN tok[1]::DOUBLE WHEN 'adfea' THEN tok[3]::DOUBLE WHEN 'criteo' THEN fld[1]::DOUBLE ELSE 0.0 END AS label,
        CASE WHEN fmt IN ('libsvm', 'adfea') THEN list_transform(items, lambda x, i: {'k': i - 1, 't': x}) ELSE list_filter(list_transform(vals, lambda x, i: {'k': i - 1, 't': x}), lambda x: x.t <> '') END AS l FROM judged WHERE reason IS NULL),
    one AS (SELECT line_id, fmt, label, unnest(list_transform(l, lambda x, i: {'pos': i - 1, 'k': x.k, 't': x.t})) AS x FROM good WHERE len(l) > 0)
    SELECT line_id, label, x.pos::INTEGER AS pos, CASE
        WHEN fmt = 'libsvm' THEN (CASE WHEN split_part(x.t, ':', 1)::HUGEINT >= 9223372036854775808 THEN split_part(x.t, ':', 1)::HUGEINT - 18446744073709551616 ELSE split_part(x.t, ':', 1)::HUGEINT END)::BIGINT
        WHEN fmt = 'adfea' THEN (CASE WHEN g >= 9223372036854775808 THEN g - 18446744073709551616 ELSE g END)::BIGINT
        ELSE (('0x' || left(md5(x.t), 12))::BIGINT * 4096 + x.k)::BIGINT END AS idx,
        CASE WHEN fmt = 'libsvm' AND contains(x.t, ':') THEN x.t[instr(x.t, ':') + 1:]::DOUBLE END AS val
    FROM (SELECT *, CASE WHEN fmt = 'adfea' THEN (split_part(x.t, ':', 1)::HUGEINT % 4503599627370496) * 4096 + split_part(x.t, ':', 2)::HUGEINT END AS g FROM one)
    UNION ALL SELECT line_id, label, NULL, NULL, NULL FROM good WHERE len(l) = 0""",
}
