"""Queries over intervals and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators import intervals, ordered, stats
from strandlake.plans.registry import EVENTS, events, query, table

_ISLANDS = """n AS (SELECT *, CASE WHEN beg <= max("end") OVER (PARTITION BY user_id ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {fuzz} THEN 0 ELSE 1 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS island FROM n),
    u AS (SELECT user_id, min(beg) AS beg, max("end") AS "end" FROM g GROUP BY user_id, island)"""


@query(f'WITH e AS ({EVENTS}), {_ISLANDS.format(fuzz=0)} SELECT user_id, beg, "end" FROM u')
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(events(spark, sf_dir), "user_id")


@query(f'WITH e AS ({EVENTS}), {_ISLANDS.format(fuzz=600)} SELECT user_id, beg, "end" FROM u')
def interval_fuzzy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(events(spark, sf_dir), "user_id", 600)


@query(f'WITH e AS ({EVENTS}), {_ISLANDS.format(fuzz=0)} SELECT user_id, sum("end" - beg)::BIGINT AS size FROM u GROUP BY user_id')
def interval_set_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.total_size(events(spark, sf_dir), "user_id")


@query(f"""WITH e AS ({EVENTS}) SELECT x.user_id, x.event_id, y.event_id AS other_id, least(x."end", y."end") - greatest(x.beg, y.beg) AS shared
    FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.beg < y."end" AND y.beg < x."end" """)
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = events(spark, sf_dir)
    other = mine.select("user_id", F.col("beg").alias("rbeg"), F.col("end").alias("rend"), F.col("event_id").alias("other_id"))
    return intervals.overlaps(mine, other, "user_id").where("event_id < other_id").select("user_id", "event_id", "other_id", F.expr("least(end, rend) - greatest(beg, rbeg)").alias("shared"))


#: Two hours a user from each click on, as windows to look at.
_LOOK = f"SELECT user_id, beg - 1800 AS rbeg, beg + 5400 AS rend, event_id AS look_id FROM ({EVENTS}) WHERE event_id % 50 = 0"


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_id % 50 = 0").select("user_id", (F.col("beg") - 1800).alias("rbeg"), (F.col("beg") + 5400).alias("rend"), F.col("event_id").alias("look_id"))


@query(f'WITH e AS ({EVENTS}), s AS ({_LOOK}) SELECT user_id, beg, "end", event_id FROM e WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e."end" > s.rbeg AND e.beg < s.rend)')
def interval_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _looks(spark, sf_dir).select("user_id", F.col("rbeg").alias("beg"), F.col("rend").alias("end"))
    return intervals.touching(events(spark, sf_dir), wanted, "user_id", ["event_id"]).select("user_id", "beg", "end", "event_id")


@query(f"""WITH e AS ({EVENTS}), s AS ({_LOOK}) SELECT user_id, look_id, event_id, greatest(beg, rbeg) AS "from", least("end", rend) AS "to", beg < rbeg AS open_left, "end" > rend AS open_right
    FROM e JOIN s USING (user_id) WHERE beg < rend AND rbeg < "end" """)
def interval_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = intervals.clipped(events(spark, sf_dir), _looks(spark, sf_dir), "user_id")
    return cut.select("user_id", "look_id", "event_id", "from", "to", "open_left", "open_right")


@query(f"""WITH e AS ({EVENTS}), o AS (SELECT user_id, beg + 77 AS pos, event_id FROM e)
    SELECT user_id, pos, event_id, (SELECT max(beg) FROM e WHERE e.user_id = o.user_id AND e.beg <= o.pos) AS last_beg FROM o""")
def interval_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    return intervals.latest(own.select("user_id", (F.col("beg") + 77).alias("pos"), "event_id"), own.select("user_id", F.col("beg").alias("last_beg")), "user_id", "pos", "last_beg")


#: Events as annotations of a contig a user, which ends where the last one starts.
_ANNO = f"""WITH r AS ({EVENTS}), m AS (SELECT user_id, min(beg) AS low, max(beg) - min(beg) + 1 AS clen FROM r GROUP BY user_id),
    e AS (SELECT user_id, beg - low + (event_id % 7) AS beg, "end" - low + (event_id % 7) AS "end", event_id % 2 AS orient, event_id % 5 AS score, CASE WHEN event_id % 3 = 0 THEN 'x' END AS label, event_id % 11 = 0 AS parsed FROM r JOIN m USING (user_id)),
    {_ISLANDS.format(fuzz=0)}, f AS (SELECT user_id, lag("end", 1, 0) OVER (PARTITION BY user_id ORDER BY beg, "end") AS beg, least(beg, clen) AS "end"
        FROM (SELECT user_id, beg, "end" FROM u UNION ALL SELECT user_id, clen, clen FROM m) JOIN m USING (user_id)),
    v AS (SELECT user_id, beg, "end" FROM f WHERE "end" > beg)"""


def _annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = events(spark, sf_dir)
    low = own.groupBy("user_id").agg(F.min("beg").alias("low"), (F.max("beg") - F.min("beg") + 1).alias("clen"))
    shift = F.col("event_id") % 7 - F.col("low")
    rows = own.join(low, "user_id").select("user_id", (F.col("beg") + shift).alias("beg"), (F.col("end") + shift).alias("end"), (F.col("event_id") % 2).alias("orient"), (F.col("event_id") % 5).alias("score"), F.when(F.col("event_id") % 3 == 0, "x").alias("label"), (F.col("event_id") % 11 == 0).alias("parsed"))
    return rows, low.select("user_id", "clen")


@query(f'{_ANNO} SELECT user_id, beg, "end" FROM v')
def annotation_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lengths = _annotations(spark, sf_dir)
    return intervals.uncovered(rows, lengths, "user_id")


@query(f"""{_ANNO}, a AS (SELECT count(*) AS n, sum("end" - beg)::BIGINT AS span, count(*) FILTER (orient = 1) AS oriented, count(label) AS labelled, count(*) FILTER (score > 0) AS scored, count(*) FILTER (parsed) AS parsed FROM e),
    c AS (SELECT sum("end" - beg)::BIGINT AS covered, count(*) AS blocks, sum(greatest(0, "end" - greatest(clen, beg)))::BIGINT AS spill FROM u JOIN m USING (user_id)), d AS (SELECT sum("end" - beg)::BIGINT AS uncovered, count(*) AS gaps FROM v)
    SELECT *, (span - covered) * 1000 // span AS overlap_permille FROM a, c, d""")
def annotation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.annotation_totals(*_annotations(spark, sf_dir), "user_id")


_QUANTILES = "(SELECT kind, percent::INT AS percent, max(len) AS length FROM (SELECT kind, len, sum(len) OVER (PARTITION BY kind ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY kind) AS total FROM l), (SELECT unnest(range(10, 100, 10)) AS percent) WHERE upto * 100 >= total * percent GROUP BY kind, percent)"


@query(f"""{_ANNO}, l AS (SELECT 'interval' AS kind, "end" - beg AS len FROM e UNION ALL SELECT 'covered', "end" - beg FROM u UNION ALL SELECT 'uncovered', "end" - beg FROM v) SELECT * FROM {_QUANTILES}""")
def annotation_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lengths = _annotations(spark, sf_dir)
    size = (F.col("end") - F.col("beg")).alias("len")
    kinds = (("interval", rows), ("covered", intervals.union(rows, "user_id")), ("uncovered", intervals.uncovered(rows, lengths, "user_id")))
    parts = [intervals.length_quantiles(df.select(size), list(range(10, 100, 10))).select(F.lit(kind).alias("kind"), "percent", "length") for kind, df in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LOG_STEPS = "SELECT x * 10**e AS s FROM (SELECT unnest([1, 2, 5]) AS x), (SELECT unnest(range(0, 15)) AS e)"
_LOG = f"""b AS (SELECT min(len) AS lo, max(len) AS hi, sum(len)::BIGINT AS total FROM l), s AS (SELECT s::BIGINT AS bucket FROM ({_LOG_STEPS}), b WHERE s <= greatest(1, hi) AND s >= (SELECT coalesce(max(s), 1) FROM ({_LOG_STEPS}) WHERE s <= lo)),
    h AS (SELECT greatest((SELECT min(bucket) FROM s), (SELECT max(bucket) FROM s WHERE bucket <= len)) AS bucket, len FROM l),
    k AS (SELECT s.bucket, count(len) AS n, coalesce(sum(len), 0)::BIGINT AS bases FROM s LEFT JOIN h USING (bucket) GROUP BY s.bucket)
    SELECT bucket, n, bases, (sum(bases) OVER (ORDER BY bucket DESC))::BIGINT AS upto, (sum(bases) OVER (ORDER BY bucket DESC))::BIGINT * 1000 // total AS permille FROM k, b"""
_LINEAR = """b AS (SELECT min(len) AS lo, max(len) AS hi, sum(len)::BIGINT AS total FROM l), w AS (SELECT {step} AS w FROM b), s AS (SELECT unnest(range(lo // w * w, hi // w * w + 1, w)) AS bucket FROM b, w),
    k AS (SELECT bucket, count(len) AS n, coalesce(sum(len), 0)::BIGINT AS bases FROM s LEFT JOIN (SELECT len // w * w AS bucket, len FROM l, w) USING (bucket) GROUP BY bucket)
    SELECT bucket, n, bases, (sum(bases) OVER (ORDER BY bucket DESC))::BIGINT AS upto, (sum(bases) OVER (ORDER BY bucket DESC))::BIGINT * 1000 // total AS permille FROM k, b"""
_NICE = f"coalesce((SELECT max(s)::BIGINT FROM ({_LOG_STEPS}) WHERE s * 20 <= hi - lo), 1)"


@query(f'{_ANNO}, l AS (SELECT "end" - beg AS len FROM v), {_LOG}')
def annotation_log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_histogram(intervals.uncovered(*_annotations(spark, sf_dir), "user_id").select((F.col("end") - F.col("beg")).alias("len")))


@query(f'{_ANNO}, l AS (SELECT "end" - beg AS len FROM u), {_LINEAR.format(step=_NICE)}')
def annotation_linear_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.linear_histogram(intervals.union(_annotations(spark, sf_dir)[0], "user_id").select((F.col("end") - F.col("beg")).alias("len")))


_LENGTHS = "WITH l AS (SELECT n_chars AS len FROM documents)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("n_chars").alias("len"))


@query("""WITH o AS (SELECT n_chars AS len, sum(n_chars) OVER (ORDER BY n_chars DESC RANGE UNBOUNDED PRECEDING) AS upto, sum(n_chars) OVER () AS total FROM documents)
    SELECT percent::INT AS percent, max(len) AS length FROM o, (SELECT unnest(range(10, 100, 10)) AS percent) WHERE upto * 100 >= total * percent GROUP BY percent""")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.length_quantiles(_lengths(spark, sf_dir), list(range(10, 100, 10)))


@query(f"{_LENGTHS} SELECT count(*) AS n, min(len) AS least, max(len) AS most FROM l")
def length_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).agg(F.count("*").alias("n"), F.min("len").alias("least"), F.max("len").alias("most"))


@query(f"{_LENGTHS}, {_LINEAR.format(step=_NICE)}")
def linear_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.linear_histogram(_lengths(spark, sf_dir))


@query(f"{_LENGTHS}, {_LINEAR.format(step='1500')}")
def chosen_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.linear_histogram(_lengths(spark, sf_dir), 1500)


@query(f"{_LENGTHS}, {_LOG}")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_histogram(_lengths(spark, sf_dir))


_NICE_CUT = "(SELECT CASE WHEN l = 0 THEN 0 ELSE l // d * d END FROM (SELECT l, coalesce(max(d) FILTER (ok), 1) AS d FROM (SELECT l, d, (l // d) * d >= 0.9 * l AND l // d > 0 AS ok FROM k, (SELECT unnest([1, 10, 100, 1000, 10000, 100000, 1000000]) AS d)) GROUP BY l))"


@query(f"""WITH k AS (SELECT min(n_chars) AS l FROM (SELECT n_chars FROM documents ORDER BY n_chars DESC LIMIT 100)) SELECT doc_id, n_chars FROM documents WHERE n_chars >= {_NICE_CUT}""")
def longest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.longest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 100)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 250 OFFSET 100")
def slice_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.slice_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 100, 350)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey, l_shipdate, l_orderkey, l_linenumber) - 1 AS row FROM lineitem")
def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return ordered.numbered(rows, ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row")


@query(f'WITH e AS ({EVENTS}) SELECT user_id, event_id, beg - max("end") OVER (PARTITION BY user_id ORDER BY beg, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, min("end" - beg) OVER (PARTITION BY user_id ORDER BY beg, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS least FROM e')
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("beg", "event_id")
    gap = F.col("beg") - F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events(spark, sf_dir).select("user_id", "event_id", gap.alias("gap"), F.min(F.col("end") - F.col("beg")).over(order.rowsBetween(-4, 0)).alias("least"))


@query(f"""WITH e AS ({EVENTS}), n AS (SELECT *, CASE WHEN beg >= max("end") OVER (PARTITION BY user_id ORDER BY beg, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200 THEN 1 ELSE 0 END AS new FROM e)
    SELECT user_id, event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY beg, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM n""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("beg", "event_id")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = events(spark, sf_dir).withColumn("_new", F.when(F.col("beg") >= last + 7200, 1).otherwise(0))
    return rows.select("user_id", "event_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("session"))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT item_id, 'item' FROM benchmark")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return docs.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")).unionByName(items.select(F.col("item_id").alias("id"), F.lit("item").alias("kind")))
