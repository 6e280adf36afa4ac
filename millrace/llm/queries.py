"""Queries of the training-data problems, with SQL for another engine where SQL can express them."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.abuse import abuse_rates, abuse_scores, fit_abuse
from millrace.llm.encoding import texts, token_counts, token_ids
from millrace.llm.frequency import distinct_count, marked, term_counts
from millrace.llm.frequent import at_least, top_values
from millrace.llm.overlap import overlap, report, row_pairs
from millrace.llm.packing import SHARE, pack
from millrace.session import cut, table

RARE = 4


def modules() -> list:
    return [sys.modules[__name__]]


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every k and every fid: occurrences, records that hold it, and its mark, if any."""
    pairs, tiles = table(spark, d, "localizer_pairs"), table(spark, d, "tile_feacnts")
    k = marked(term_counts(pairs, "k", "row_id", ["blk_id", "i"]), RARE, 0.4, distinct_count(pairs, "row_id"))
    # One count of a feature in a block, however often it was delivered: the block is the record, and the one unit in it.
    counted = term_counts(tiles.filter(F.col("feacnt").isNotNull()).withColumn("one", F.lit(1)), "fid", "blk_id", ["one"], F.col("feacnt").cast("double"))
    f = marked(counted, RARE, 0.5, distinct_count(tiles, "blk_id"))
    row = lambda x, name: x.select(F.lit(name).alias("field"), F.col("term").alias("fid"), F.col("total").cast("double").alias("total"), "records", "mark")
    return row(k, "k").unionByName(row(f, "feacnts"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).filter(F.col("mark").isNotNull()).select("field", "fid", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return row_pairs(overlap(table(spark, d, "row_blocks")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: rows, and those with a training row that is alike or the same."""
    return report(overlap(table(spark, d, "row_blocks")))


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most frequent fids and ks, with their counts; the counts have no error."""
    def one(t: str, column: str, field: str) -> DataFrame:
        top = top_values(table(spark, d, t), column, 100)
        return top.select(F.lit(field).alias("field"), F.col("value").alias("fid"), "n", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("place"))  # a hundred rows

    return one("batch_feaids", "fid", "feaids").unionByName(one("localizer_pairs", "k", "k"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, column, field: at_least(table(spark, d, t), column, 0.01).select(F.lit(field).alias("field"), F.col("value").alias("fid"))
    return one("batch_feaids", "fid", "feaids").unionByName(one("localizer_pairs", "k", "k"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, tokens, and texts that the ids don't give back exactly (none, if all is well)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    ids = token_ids(docs, "doc_id", "text")
    back = texts(ids, "doc_id", "ids").select("doc_id", F.xxhash64("text").alias("back"))
    sizes = ids.select("doc_id", F.size("ids").alias("n"))
    whole = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("there"))
    return whole.join(back, "doc_id").join(sizes, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.sum((F.col("there") != F.col("back")).cast("int")).alias("differing"))


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """limit_id, capacity, doc_id, tokens of every text for each limit, and the shares to pack in."""
    limits = [r for r in table(spark, d, "pack_limits").select("limit_id", "tokenizer", "capacity").collect() if all(x is not None for x in r)]  # a fixed table of three rows
    if not limits:
        return spark.createDataFrame([], "doc_id bigint, limit_id bigint, tokens int, capacity int"), 1
    names = sorted({r.tokenizer for r in limits})
    sized = cut(token_counts(table(spark, d, "documents"), "doc_id", "text", names))  # an id and some numbers a text
    each = F.explode(F.array(*(F.struct(F.lit(r.limit_id).cast("bigint").alias("limit_id"), F.col(r.tokenizer).alias("tokens"), F.lit(r.capacity).alias("capacity")) for r in limits))).alias("x")
    return sized.select("doc_id", each).select("doc_id", "x.*"), max(1, round(sized.count() / SHARE))


def _packed(items: DataFrame, shares: int, topped: bool = True) -> DataFrame:
    out = pack(items, "doc_id", "tokens", F.col("capacity"), "limit_id", shares, topped)
    return out.select(F.col("group").alias("limit_id"), "container", F.col("key").alias("doc_id"), "piece", "first", F.col("size").alias("tokens"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text's place for each limit: limit_id, container, doc_id, piece, first (token), tokens. Harmonic bins whose room is filled."""
    return _packed(*_sized(spark, d))


def p7_harmonic(spark: SparkSession, d: str) -> DataFrame:
    """The same by harmonic bins of fixed counts alone."""
    return _packed(*_sized(spark, d), topped=False)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per limit: containers, tokens in them, the tokens of the fullest one and the share of their room that is unused, after both steps; and the containers and unused share of harmonic bins alone."""
    items, shares = _sized(spark, d)

    def fill(topped: bool) -> DataFrame:
        return _packed(items, shares, topped).groupBy("limit_id", "container").agg(F.sum("tokens").alias("tokens")).groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))

    plain = fill(False).select("limit_id", F.col("containers").alias("plain_containers"), F.col("tokens").alias("plain_tokens"))
    unused = lambda n, of: 1 - F.col(n) / (F.col(of) * F.col("capacity"))
    both = fill(True).join(plain, "limit_id").join(table(spark, d, "pack_limits").select("limit_id", "capacity"), "limit_id")
    return both.select("limit_id", "capacity", "containers", "tokens", "fullest", unused("tokens", "containers").alias("unused"), "plain_containers", unused("plain_tokens", "plain_containers").alias("plain_unused"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per limit: texts with tokens; containers that hold more than the capacity, texts not all of whose tokens are in containers just once, and texts in another number of pieces than they need (none, if all is well)."""
    items, shares = _sized(spark, d)
    packed = _packed(items, shares)
    room = items.select("limit_id", "capacity").distinct()
    over = packed.groupBy("limit_id", "container").agg(F.sum("tokens").alias("load")).join(room, "limit_id").groupBy("limit_id").agg(F.sum((F.col("load") > F.col("capacity")).cast("bigint")).alias("overfull"))
    # Pieces of a text that begin where the one before it ends: the begins add up to what their lengths give.
    ends = packed.groupBy("limit_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("held"), F.max(F.col("first") + F.col("tokens")).alias("end"), F.count_distinct("first").alias("begins"))
    both = items.filter("tokens > 0").join(ends, ["limit_id", "doc_id"], "left")
    whole = F.coalesce((F.col("held") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("begins") == F.col("pieces")), F.lit(False))
    needed = F.coalesce(F.col("pieces") == F.ceil(F.col("tokens") / F.col("capacity")), F.lit(False))
    n = both.groupBy("limit_id", F.col("capacity")).agg(F.count(F.lit(1)).alias("texts"), F.sum((~whole).cast("bigint")).alias("lost"), F.sum((~needed).cast("bigint")).alias("misplaced"))
    return n.join(over, "limit_id").select("limit_id", "capacity", "texts", "overfull", "lost", "misplaced")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse_scores(docs, fit_abuse(docs, table(spark, d, "abuse_labels"), table(spark, d, "abuse_terms")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).filter("flagged").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_counts, p1_found, p2_found, p2_report, p4_top, p4_found, p6_ids, p6_roundtrip, p7_pack, p7_harmonic, p7_fill, p7_checks, p8_scores, p8_found, p8_rates)}

_COUNTS = """
WITH k AS (SELECT DISTINCT blk_id, i, row_id, k FROM localizer_pairs WHERE k IS NOT NULL AND row_id IS NOT NULL),
f AS (SELECT blk_id, fid, min(feacnt) AS feacnt FROM tile_feacnts WHERE fid IS NOT NULL AND feacnt IS NOT NULL AND blk_id IS NOT NULL GROUP BY blk_id, fid),
c AS (SELECT 'k' AS field, k AS fid, count(*)::DOUBLE AS total, count(DISTINCT row_id) AS records, 0.4 * (SELECT count(DISTINCT row_id) FROM localizer_pairs) AS most FROM k GROUP BY k
    UNION ALL SELECT 'feacnts', fid, sum(feacnt)::DOUBLE, count(*), 0.5 * (SELECT count(DISTINCT blk_id) FROM tile_feacnts) FROM f GROUP BY fid),
m AS (SELECT field, fid, total, records, CASE WHEN total <= 4 THEN 'rare' WHEN records > most THEN 'common' END AS mark FROM c)
"""
_ROWS = "SELECT 'feaids' AS field, fid FROM batch_feaids WHERE fid IS NOT NULL UNION ALL SELECT 'k', k FROM localizer_pairs WHERE k IS NOT NULL"
_PAIRS = r"""
WITH r AS (SELECT DISTINCT row_id, lower(trim(split_name, E' \t\r\n')) AS split, source, list_sort(list_distinct(list_filter(list_transform(features, lambda x: x.idx), lambda x: x IS NOT NULL))) AS ids FROM row_blocks WHERE row_id IS NOT NULL),
s AS (SELECT DISTINCT ids, split = 'train' AS train FROM r WHERE split IN ('train', 'val', 'test') AND len(ids) > 0),
u AS (SELECT ids, train, unnest(ids) AS id FROM s),
i AS (SELECT e.ids AS a, t.ids AS b, count(*) AS n FROM u e JOIN u t ON e.id = t.id AND NOT e.train AND t.train GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE n >= 0.75 * (len(a) + len(b) - n))
"""
SQL = {
    "p2_found": _PAIRS
    + """SELECT DISTINCT least(e.row_id, t.row_id) AS row_id_1, greatest(e.row_id, t.row_id) AS row_id_2
    FROM l JOIN r e ON e.ids = l.a AND e.split IN ('val', 'test') JOIN r t ON t.ids = l.b AND t.split = 'train' WHERE e.row_id <> t.row_id""",
    "p2_report": _PAIRS
    + """, k AS (SELECT a, max((a = b)::INTEGER) AS same FROM l GROUP BY a)
    SELECT split, source, count(DISTINCT row_id) AS rows, count(DISTINCT CASE WHEN a IS NOT NULL THEN row_id END) AS overlapping, count(DISTINCT CASE WHEN same = 1 THEN row_id END) AS exact
    FROM r LEFT JOIN k ON r.ids = k.a WHERE split IN ('val', 'test') AND len(ids) > 0 GROUP BY split, source""",
    "p7_checks": "SELECT limit_id, capacity, count(*) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS lost, 0::BIGINT AS misplaced FROM pack_limits, documents WHERE text <> '' GROUP BY limit_id, capacity",
    "p1_counts": _COUNTS + "SELECT * FROM m",
    "p1_found": _COUNTS + "SELECT field, fid, mark FROM m WHERE mark IS NOT NULL",
    "p4_top": f"""WITH n AS (SELECT field, fid, count(*) AS n FROM ({_ROWS}) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, fid) AS place FROM n) SELECT field, fid, n, place::INTEGER AS place FROM o WHERE place <= 100""",
    "p4_found": f"""WITH n AS (SELECT field, fid, count(*) AS n FROM ({_ROWS}) GROUP BY ALL),
    t AS (SELECT field, sum(n) AS t FROM n GROUP BY field) SELECT field, fid FROM n JOIN t USING (field) WHERE n >= 0.01 * t""",
}
