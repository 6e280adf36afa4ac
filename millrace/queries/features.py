"""Queries of ids, counts, filters, dictionaries, batches, blocks, tables of keys and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import ids as I
from millrace.operators import features as X
from millrace.operators import kv
from millrace.operators.linalg import transpose
from millrace.queries.inputs import EVENTS, event_rows, events, labels
from millrace.queries.problems import LINES
from millrace.session import table
from millrace.sources.lines import examples, parse_lines
from millrace.sources.sinks import libsvm_lines
from millrace.streaming.ftrl import windowed_counts

#: Values of this size and more are counted apart in parsed_entries, besides being in its sum.
LARGE = 1000

def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_feaids").select("fid").filter("fid is not null").distinct()


def reverse_feature_id(spark, d):
    return _ids(spark, d).select("fid", I.reverse_id("fid").alias("rev"), (I.reverse_id(I.reverse_id("fid")) == F.col("fid")).alias("back"))


def encode_group_id(spark, d):
    return table(spark, d, "events").select("event_id", I.encode_group("user_id", F.hour("ts"), 12).alias("fid"))


def decode_group_id(spark, d):
    return _ids(spark, d).groupBy(I.decode_group(I.reverse_id("fid"), 12).alias("grp")).agg(F.count(F.lit(1)).alias("ids"))


def hash_mod(spark, d):
    return _ids(spark, d).groupBy(I.hash_mod("fid", 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("ids"))


def range_segment(spark, d):
    return spark.createDataFrame([(i, *I.segment(7, 1_000_003, i, 9)) for i in range(9)], "part int, begins bigint, ends bigint")


def feature_counts(spark, d):
    return X.feature_counts(events(spark, d))


def feature_counts_hashed(spark, d):
    return X.feature_counts(events(spark, d), 1000)


def block_counts_merged(spark, d):
    """Counts of the blocks added up: what a union of all blocks' counts gives, rows delivered twice once."""
    tiles = table(spark, d, "tile_feacnts").select(F.col("blk_id").alias("blk"), "fid", F.col("feacnt").alias("cnt"))
    return X.merged_counts(tiles, ["blk", "fid", "cnt"])


def tail_filter(spark, d):
    return X.keep_features(events(spark, d), X.frequent_features(X.feature_counts(events(spark, d)), 100)).groupBy("fid").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("val"), 4).alias("vals"))


def dictionary(spark, d):
    return X.dictionary(events(spark, d), 20)


def localize(spark, d):
    e = events(spark, d)
    return X.localize(e, X.dictionary(e, 20)).groupBy("row_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("pos").alias("places"))


def colmap(spark, d):
    e = events(spark, d)
    blocks = e.withColumn("blk", F.floor(F.col("row_id") / 500).cast("bigint"))
    return X.column_map(blocks, X.dictionary(e, 20))


def feature_group_stats(spark, d):
    e = events(spark, d)
    rows = X.every_tenth(labels(spark, d).withColumn("blk", F.floor(F.col("row_id") / 997)))
    return X.group_stats(e, rows, 12)


def _plan(spark, d):
    stats = {r.grp: r.nnz for r in feature_group_stats(spark, d).collect()}  # a row a group
    n = X.every_tenth(labels(spark, d).withColumn("blk", F.floor(F.col("row_id") / 997))).count()
    return X.plan_blocks(stats, n, 12, 4.0)


def plan_feature_blocks(spark, d):
    return spark.createDataFrame([(i, f"{b:016X}", f"{e:016X}" if e < 1 << 64 else "G") for i, (b, e) in enumerate(_plan(spark, d))], "fblk int, begin_hex string, end_hex string")


def assign_blocks(spark, d):
    return X.assign_blocks(X.feature_counts(events(spark, d)), _plan(spark, d)).groupBy("fblk").agg(F.count(F.lit(1)).alias("ids"), F.sum("cnt").alias("entries"))


def range_assign(spark, d):
    """Each block's span of places in the ordered dictionary."""
    return kv.find_ranges(X.feature_counts(events(spark, d)), _plan(spark, d), I.reverse_id("fid"))


def transpose_csc(spark, d):
    columns = transpose(events(spark, d), span=300)
    ends = columns.select("fid", F.size("items").alias("n"), F.element_at("items", 1)["row_id"].alias("a"), F.element_at("items", -1)["row_id"].alias("z"), F.aggregate("items", F.lit(0.0), lambda s, x: s + x["val"]).alias("v"))
    return ends.groupBy("fid").agg(F.sum("n").cast("int").alias("entries"), F.min("a").alias("first_row"), F.max("z").alias("last_row"), F.round(F.sum("v"), 4).alias("vals"))


def minibatch_stats(spark, d):
    b = X.in_order(event_rows(spark, d), 370)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("labels"), F.sum(F.size("features")).alias("entries"), F.min("row_id").alias("first_row"))


def shuffle_buffer(spark, d):
    """Batches from a buffer of five batches: their sizes, and the buffer that their rows come from."""
    b = X.shuffled(event_rows(spark, d), 100, 500, 7)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"), F.floor(F.min("row_id") / 500).alias("from_buffer"), F.floor(F.max("row_id") / 500).alias("to_buffer"))


def minibatch_parts(spark, d):
    """Batches of seven parts, each shuffled within buffers of three batches."""
    b = X.batches(event_rows(spark, d), 50, 7, 150, 3)
    return b.groupBy("part", "batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


def neg_downsample(spark, d):
    kept = X.keep_negatives(labels(spark, d), 0.3)
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


def partition_rows(spark, d):
    """The parts of the rows: each row lies in one."""
    parts = [X.part_of(labels(spark, d), i, 4).select(F.lit(i).alias("part"), "row_id") for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("row_id").agg(F.count(F.lit(1)).alias("parts"))


def row_block_triples(spark, d):
    """Examples of the blocks as triples, redelivered rows once."""
    rows = table(spark, d, "row_blocks").select("row_id", "label", "features", "arrived_at")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("row_id").orderBy("arrived_at"))).filter("k = 1")
    return X.triples(first).groupBy("row_id").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("val"), 6).alias("vals"))


def _dst(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") / 100, 2).alias("value"))


def _src(spark, d):
    """Orders per customer, of all orders; the keys are shifted, which leaves some unmatched on both sides."""
    return table(spark, d, "orders").groupBy((F.col("o_custkey") + 10).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def _matcher(op):
    def q(spark, d):
        return kv.kv_match(_dst(spark, d), _src(spark, d), op=op).select("key", F.round("value", 8).alias("value"), "matched")

    return q


def _joiner(op):
    def q(spark, d):
        return kv.kv_union(_dst(spark, d), _src(spark, d), op=op).select("key", F.round("value", 8).alias("value"))

    return q


def kv_match_vectors(spark, d):
    vec = lambda t: t.withColumn("value", F.array("value", F.col("value") * 2))
    out = kv.kv_match_vectors(vec(_dst(spark, d)), vec(_src(spark, d)), op="plus")
    return out.select("key", F.round(F.col("value")[0], 4).alias("v0"), F.round(F.col("value")[1], 4).alias("v1"), "matched")


def kv_match_ragged(spark, d):
    src = _src(spark, d).withColumn("value", F.sequence(F.lit(1), F.col("value").cast("int"))).withColumn("value", F.transform("value", lambda x: x * 1.5))
    return kv.kv_match_ragged(_dst(spark, d), src).select("key", "length", F.aggregate("value", F.lit(0.0), lambda s, x: s + x).alias("total"))


def find_position(spark, d):
    src = X.dense_index(_src(spark, d), F.col("key"))
    return kv.find_position(src, _dst(spark, d))


def push_pull(spark, d):
    """Counts of all orders pushed to a model, and pulled for the customers of all of them."""
    m = kv.push(_dst(spark, d), _src(spark, d)).select(F.col("key").alias("fid"), F.round("value", 4).alias("value"))
    return kv.pull(m, table(spark, d, "orders").select(F.col("o_custkey").alias("fid")))


def kv_match_ragged_plus(spark, d):
    """Arrays of any lengths, added where both sides have one of the same length."""
    ragged = lambda t: t.withColumn("value", F.transform(F.sequence(F.lit(1), F.pmod("key", F.lit(4)).cast("int") + 1), lambda i: F.col("value") * i))
    out = kv.kv_match_ragged(ragged(_dst(spark, d)), ragged(_src(spark, d)), op="plus")
    return out.select("key", "length", F.round(F.aggregate("value", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def parsed_entries(spark, d):
    """Per format: valid lines, their entries, and the sums of labels and values; an entry without a value counts as 1.

    vals is the sum over all entries, in ten digits. As one of 1e300 swamps what the others add, small_vals is the same sum over the entries below LARGE in size, whose
    number is entries - large; unvalued: entries without a value; min_val, max_val: the least and the largest value.
    """
    e = examples(parse_lines(table(spark, d, "raw_lines"))).withColumn("vals", F.transform("features", lambda x: F.coalesce(x["val"], F.lit(1.0))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    small = F.filter("vals", lambda v: F.abs(v) < LARGE)
    return e.groupBy("fmt").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("features")).alias("entries"), F.round(F.sum("label"), 3).alias("labels"), F.format_string("%.9e", F.sum(total("vals"))).alias("vals"), F.round(F.sum(total(small)), 3).alias("small_vals"),
        F.sum(F.size("vals") - F.size(small)).alias("large"), F.sum(F.size(F.filter("features", lambda x: x["val"].isNull()))).alias("unvalued"), F.min(F.array_min("vals")).alias("min_val"), F.max(F.array_max("vals")).alias("max_val"),
    )


def libsvm_text(spark, d):
    """Rows as text lines."""
    return libsvm_lines(event_rows(spark, d))


def windowed_group_counts(spark, d):
    """Entries per feature group and five minutes: the streaming aggregation over a table."""
    t = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("at"))
    e = t.join(event_rows(spark, d), "row_id")
    return windowed_counts(e, "at").select(F.unix_micros("begins").alias("begins"), "grp", "nnz")


OPS = ("assign", "plus", "minus", "times", "divide")
QUERIES = {
    f.__name__: f
    for f in (
        reverse_feature_id, encode_group_id, decode_group_id, hash_mod, range_segment, feature_counts, feature_counts_hashed, block_counts_merged, tail_filter, dictionary, localize, colmap, feature_group_stats, plan_feature_blocks,
        assign_blocks, range_assign, transpose_csc, minibatch_stats, shuffle_buffer, neg_downsample, partition_rows, row_block_triples, kv_match_vectors, kv_match_ragged, find_position, push_pull, kv_match_ragged_plus, minibatch_parts, parsed_entries, libsvm_text, windowed_group_counts,
    )
}
QUERIES |= {f"kv_match_{op}": _matcher(op) for op in OPS} | {f"kv_union_{op}": _joiner(op) for op in OPS}

_REV = "('0x' || reverse(lpad(hex({0}), 16, '0')))::UBIGINT"
_SIGNED = "(CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0}::HUGEINT END)::BIGINT"
_IDS = "ids AS (SELECT DISTINCT fid, " + _REV.format("fid") + " AS r, CASE WHEN fid < 0 THEN fid::HUGEINT + 18446744073709551616 ELSE fid::HUGEINT END AS u FROM batch_feaids WHERE fid IS NOT NULL)"
_ORDER = "reverse(lpad(hex(fid), 16, '0'))"
_DICT = EVENTS + f", dc AS (SELECT fid, cnt, (row_number() OVER (ORDER BY {_ORDER}) - 1)::BIGINT AS pos FROM cn WHERE cnt > 20)"
_SAMPLE = EVENTS + ", sm AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY row_id // 997 ORDER BY row_id) - 1 AS k FROM rw) WHERE k % 10 = 0), gs AS (SELECT fid & 4095 AS grp, count(*) AS nnz FROM ev JOIN sm USING (row_id) GROUP BY 1)"
#: A group's block i of n: its three reversed digits, then the next 13 digits from 16^13 i / n.
_PLAN = (
    _SAMPLE
    + """, nb AS (SELECT grp, ceil(nnz / (SELECT count(*) FROM sm)::DOUBLE * 4.0)::BIGINT AS n, ('0x' || reverse(lpad(hex(grp), 3, '0')))::HUGEINT * 4503599627370496 AS b FROM gs),
pl AS (SELECT b + 4503599627370496::HUGEINT * i // n AS b, b + 4503599627370496::HUGEINT * (i + 1) // n AS e FROM (SELECT grp, n, b, unnest(range(n)) AS i FROM nb)),
pb AS (SELECT (row_number() OVER (ORDER BY b) - 1)::INTEGER AS fblk, lpad(hex(b::UBIGINT), 16, '0') AS begin_hex, CASE WHEN e >= 18446744073709551616 THEN 'G' ELSE lpad(hex(e::UBIGINT), 16, '0') END AS end_hex FROM pl)"""
)
_KV = "dst AS (SELECT c_custkey AS key, round(c_acctbal / 100, 2) AS value FROM customer), src AS (SELECT o_custkey + 10 AS key, count(*)::DOUBLE AS value FROM orders GROUP BY 1)"
_OPS = {"assign": "{1}", "plus": "{0} + {1}", "minus": "{0} - {1}", "times": "{0} * {1}", "divide": "{0} / nullif({1}, 0)"}
SQL = {
    "reverse_feature_id": f"WITH {_IDS} SELECT fid, {_SIGNED.format('r')} AS rev, true AS back FROM ids",
    "encode_group_id": "SELECT event_id, (user_id * 4096 + hour(ts))::BIGINT AS fid FROM events",
    "decode_group_id": f"WITH {_IDS} SELECT (r % 4096)::BIGINT AS grp, count(*) AS ids FROM ids GROUP BY 1",
    "hash_mod": f"WITH {_IDS} SELECT (u % 1000)::BIGINT AS bucket, count(*) AS ids FROM ids GROUP BY 1",
    "range_segment": "SELECT i::INTEGER AS part, (7 + floor(999996 / 9.0::DOUBLE * i))::BIGINT AS begins, (CASE WHEN i = 8 THEN 1000003 ELSE 7 + floor(999996 / 9.0::DOUBLE * (i + 1)) END)::BIGINT AS ends FROM range(9) t(i)",
    "feature_counts": f"WITH {EVENTS} SELECT fid, cnt FROM cn",
    "feature_counts_hashed": f"WITH {EVENTS} SELECT fid % 1000 AS fid, count(*) AS cnt FROM ev GROUP BY 1",
    "block_counts_merged": "SELECT fid, sum(feacnt)::DOUBLE AS cnt FROM (SELECT DISTINCT blk_id, fid, feacnt FROM tile_feacnts WHERE fid IS NOT NULL AND feacnt IS NOT NULL) GROUP BY fid",
    "tail_filter": f"WITH {EVENTS} SELECT fid, count(*) AS entries, round(sum(val), 4) AS vals FROM ev JOIN cn USING (fid) WHERE cnt > 100 GROUP BY fid",
    "dictionary": f"WITH {_DICT} SELECT * FROM dc",
    "localize": f"WITH {_DICT} SELECT row_id, count(*) AS entries, sum(pos)::BIGINT AS places FROM ev JOIN dc USING (fid) GROUP BY row_id",
    "colmap": f"WITH {_DICT}, b AS (SELECT DISTINCT row_id // 500 AS blk, fid FROM ev) SELECT blk, fid, (row_number() OVER (PARTITION BY blk ORDER BY {_ORDER}) - 1)::BIGINT AS local, coalesce(pos, -1)::BIGINT AS pos FROM b LEFT JOIN dc USING (fid)",
    "feature_group_stats": f"WITH {_SAMPLE} SELECT * FROM gs",
    "plan_feature_blocks": f"WITH {_PLAN} SELECT * FROM pb",
    "assign_blocks": f"WITH {_PLAN} SELECT fblk, count(*) AS ids, sum(cnt)::BIGINT AS entries FROM cn JOIN pb ON {_ORDER} >= begin_hex AND {_ORDER} < end_hex GROUP BY fblk",
    "range_assign": f"WITH {_PLAN}, o AS (SELECT {_ORDER} AS h FROM cn) SELECT fblk AS rng, (SELECT count(*) FROM o WHERE h < begin_hex) AS first, (SELECT count(*) FROM o WHERE h < end_hex) AS past FROM pb",
    "transpose_csc": f"WITH {EVENTS} SELECT fid, count(*)::INTEGER AS entries, min(row_id) AS first_row, max(row_id) AS last_row, round(sum(val), 4) AS vals FROM ev GROUP BY fid",
    "minibatch_stats": f"""WITH {EVENTS}, b AS (SELECT row_id, label, (row_number() OVER (ORDER BY row_id) - 1) // 370 AS batch_id FROM rw), n AS (SELECT row_id, count(*) AS n FROM ev GROUP BY 1)
    SELECT batch_id, count(*) AS rows, sum(label) AS labels, sum(n)::BIGINT AS entries, min(row_id) AS first_row FROM b JOIN n USING (row_id) GROUP BY batch_id""",
    "partition_rows": f"WITH {EVENTS} SELECT row_id, 1::BIGINT AS parts FROM rw",
    "row_block_triples": """WITH f AS (SELECT row_id, features FROM row_blocks QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY arrived_at) = 1), t AS (SELECT row_id, unnest(features) AS x FROM f)
    SELECT row_id, count(*) AS entries, round(sum(coalesce(x.val, 1.0)), 6) AS vals FROM t WHERE x.idx IS NOT NULL GROUP BY row_id""",
    "kv_match_vectors": f"WITH {_KV} SELECT key, round(dst.value + coalesce(src.value, 0), 4) AS v0, round(2 * dst.value + coalesce(2 * src.value, 0), 4) AS v1, src.key IS NOT NULL AS matched FROM dst LEFT JOIN src USING (key)",
    "kv_match_ragged": f"WITH {_KV} SELECT key, coalesce(src.value, 0)::INTEGER AS length, coalesce(src.value * (src.value + 1) / 2 * 1.5, 0)::DOUBLE AS total FROM dst LEFT JOIN src USING (key)",
    "find_position": f"WITH {_KV}, s AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM src) SELECT key, coalesce(pos, -1)::BIGINT AS pos FROM dst LEFT JOIN s USING (key)",
    "push_pull": f"""WITH {_KV}, m AS (SELECT coalesce(dst.key, src.key) AS fid, round(coalesce(dst.value, 0) + coalesce(src.value, 0), 4) AS value FROM dst FULL JOIN src ON dst.key = src.key)
    SELECT fid, value FROM (SELECT DISTINCT o_custkey AS fid FROM orders) LEFT JOIN m USING (fid)""",
    "libsvm_text": f"WITH {EVENTS}, t AS (SELECT row_id, label, string_agg(fid::VARCHAR || ':' || CASE WHEN val = floor(val) THEN val::BIGINT::VARCHAR ELSE val::VARCHAR END, ' ' ORDER BY fid % 4096) AS l FROM ev GROUP BY row_id, label) SELECT label::BIGINT::VARCHAR || ' ' || l AS value FROM t",
    "windowed_group_counts": f"""WITH {EVENTS} SELECT (epoch_us(ts) // 300000000 * 300000000)::BIGINT AS begins, fid & 4095 AS grp, count(*) AS nnz FROM ev JOIN events ON row_id = event_id GROUP BY 1, 2""",
}
SQL |= {f"kv_match_{op}": f"WITH {_KV} SELECT key, round(CASE WHEN src.key IS NULL THEN dst.value ELSE {_OPS[op].format('dst.value', 'src.value')} END, 8) AS value, src.key IS NOT NULL AS matched FROM dst LEFT JOIN src USING (key)" for op in OPS}
SQL |= {
    f"kv_union_{op}": f"""WITH {_KV}
    SELECT coalesce(dst.key, src.key) AS key, round(CASE WHEN src.key IS NULL THEN dst.value ELSE {_OPS[op].format("coalesce(dst.value, 0.0)", "src.value")} END, 8) AS value FROM dst FULL JOIN src ON dst.key = src.key"""
    for op in OPS
}
_DRAWN = "('0x' || left(md5({0}::VARCHAR || ':{1}'), 13))::BIGINT"
SQL |= {
    "kv_match_ragged_plus": f"""WITH {_KV} SELECT dst.key, (dst.key % 4 + 1)::INTEGER AS length, round((dst.key % 4 + 1) * (dst.key % 4 + 2) / 2 * (dst.value + coalesce(src.value, 0)), 4)::DOUBLE AS total FROM dst LEFT JOIN src ON dst.key = src.key""",
    "shuffle_buffer": f"""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events),
    b AS (SELECT event_id, (row_number() OVER (PARTITION BY place // 500 ORDER BY {_DRAWN.format('place', 7)}, place) - 1 + place // 500 * 500) // 100 AS batch_id FROM p)
    SELECT batch_id::BIGINT AS batch_id, count(*) AS rows, sum(event_id)::BIGINT AS ids, (min(event_id) // 500)::BIGINT AS from_buffer, (max(event_id) // 500)::BIGINT AS to_buffer FROM b GROUP BY batch_id""",
    "minibatch_parts": f"""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n FROM events),
    q AS (SELECT *, place * 7 // n AS part FROM p), r AS (SELECT *, place - (part * n + 6) // 7 AS own FROM q),
    b AS (SELECT event_id, part, (row_number() OVER (PARTITION BY part, own // 150 ORDER BY {_DRAWN.format('place', 3)}, place) - 1 + own // 150 * 150) // 50 AS batch_id FROM r)
    SELECT part::INTEGER AS part, batch_id::BIGINT AS batch_id, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM b GROUP BY part, batch_id""",
    "neg_downsample": f"WITH {EVENTS} SELECT label, count(*) AS rows, sum(row_id)::BIGINT AS ids FROM rw WHERE label > 0 OR {_DRAWN.format('row_id', 0)} < 0.3::DOUBLE * 4503599627370496 GROUP BY label",
    "parsed_entries": LINES
    + """, good AS (SELECT fmt, CASE fmt WHEN 'libsvm' THEN tok[1]::DOUBLE WHEN 'adfea' THEN tok[3]::DOUBLE WHEN 'criteo' THEN fld[1]::DOUBLE ELSE 0.0 END AS label,
        CASE WHEN fmt = 'libsvm' THEN list_transform(items, lambda x: CASE WHEN contains(x, ':') THEN x[instr(x, ':') + 1:]::DOUBLE END) WHEN fmt = 'adfea' THEN list_transform(items, lambda x: NULL::DOUBLE)
        ELSE list_transform(list_filter(vals, lambda x: x <> ''), lambda x: NULL::DOUBLE) END AS given FROM judged WHERE reason IS NULL),
    one AS (SELECT fmt, unnest(given) AS v FROM good), w AS (SELECT fmt, v, coalesce(v, 1.0)::DOUBLE AS val FROM one),
    s AS (SELECT fmt, printf('%.9e', sum(val)) AS vals, round(sum(CASE WHEN abs(val) < 1000 THEN val ELSE 0 END), 3)::DOUBLE AS small_vals, count(*) FILTER (abs(val) >= 1000) AS large, count(*) FILTER (v IS NULL) AS unvalued, min(val) AS min_val, max(val) AS max_val FROM w GROUP BY fmt)
    SELECT g.*, s.* EXCLUDE (fmt) FROM (SELECT fmt, count(*) AS rows, sum(len(given))::BIGINT AS entries, round(sum(label), 3)::DOUBLE AS labels FROM good GROUP BY fmt) g JOIN s USING (fmt)""",
}
