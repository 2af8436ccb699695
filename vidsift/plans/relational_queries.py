"""General relational coverage: joins of every kind, set operations, grouping sets, windows, nested data, sketches, UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidsift.operators.ranking import rank_by
from vidsift.registry import Registry
from vidsift.sources.tables import table
from vidsift.streaming import live

registry = Registry()


def r2(c):
    """Money to whole cents, away from binary noise at the border."""
    return F.round(c, 2)


@registry("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(r2(F.sum("l_quantity")).alias("sum_qty"), r2(F.sum("l_extendedprice")).alias("sum_base"), r2(F.sum(net)).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@registry("""SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Ten unshipped orders with the most revenue: a top-k report."""
    day = F.lit("1995-03-15").cast("timestamp_ntz")
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf, "orders").filter(F.col("o_orderdate") < day).join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") > day)
    rev = li.join(o, "l_orderkey").groupBy("l_orderkey", "o_orderdate").agg(r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))
    return rev.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@registry("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' GROUP BY n_name""")
def local_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "n_name")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    j = table(spark, sf, "lineitem").join(s, "l_suppkey").join(o, "l_orderkey").filter("c_nationkey = s_nationkey")
    return j.groupBy("n_name").agg(r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


@registry("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda d: F.lit(d).cast("timestamp_ntz")
    li = table(spark, sf, "lineitem").filter((F.col("l_shipdate") >= t("1994-01-01")) & (F.col("l_shipdate") < t("1995-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(r2(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@registry("SELECT c_custkey, c_mktsegment FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def customers_with_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@registry("SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def customers_without_urgent_orders(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@registry("""WITH a AS (SELECT video_id, count(*) AS segments FROM asr GROUP BY 1), o AS (SELECT video_id, count(*) AS reads FROM ocr GROUP BY 1)
SELECT video_id, segments, reads FROM a FULL JOIN o USING (video_id)""")
def evidence_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda t, c: table(spark, sf, t).groupBy("video_id").agg(F.count(F.lit(1)).alias(c))
    return n("asr", "segments").join(n("ocr", "reads"), "video_id", "full")


@registry("SELECT video_id FROM asr UNION SELECT video_id FROM ocr EXCEPT SELECT video_id FROM clip_features")
def videos_without_features(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda t: table(spark, sf, t).select("video_id")
    return v("asr").union(v("ocr")).distinct().subtract(v("clip_features"))


@registry("SELECT label_raw FROM detections WHERE confidence >= 0.5 INTERSECT SELECT label_raw FROM detections WHERE confidence < 0.2")
def labels_at_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "detections")
    return d.filter("confidence >= 0.5").select("label_raw").intersect(d.filter("confidence < 0.2").select("label_raw"))


@registry("SELECT source_type, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source_type, lang)")
def corpus_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").rollup("source_type", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@registry("SELECT source, source_type, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (source_type), ())")
def corpus_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupingSets([["source"], ["source_type"], []], "source", "source_type").agg(F.count(F.lit(1)).alias("n"))


@registry("""SELECT source, count(*) FILTER (WHERE source_type = 'asr') AS asr, count(*) FILTER (WHERE source_type = 'ocr') AS ocr, count(*) FILTER (WHERE source_type = 'metadata') AS metadata, count(*) FILTER (WHERE source_type = 'object') AS object FROM documents GROUP BY 1""")
def corpus_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").groupBy("source").pivot("source_type", ["asr", "ocr", "metadata", "object"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@registry("SELECT video_id, kind, n FROM (SELECT video_id, max(feature_rows) AS feature_rows, max(mapping_rows) AS mapping_rows FROM assets GROUP BY 1) UNPIVOT (n FOR kind IN (feature_rows, mapping_rows))")
def assets_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assets").groupBy("video_id").agg(F.max("feature_rows").alias("feature_rows"), F.max("mapping_rows").alias("mapping_rows"))
    return a.unpivot("video_id", ["feature_rows", "mapping_rows"], "kind", "n").filter("n IS NOT NULL")


@registry("""SELECT user_id, event_id, round(sum(value) OVER w, 4) AS running, rank() OVER v AS r, dense_rank() OVER v AS d, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS quarter,
  round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY value)""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("value")
    running = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select(
        "user_id", "event_id", F.round(running, 4).alias("running"), F.rank().over(v).cast("long").alias("r"), F.dense_rank().over(v).cast("long").alias("d"),
        F.ntile(4).over(Window.partitionBy("user_id").orderBy("value", "event_id")).cast("long").alias("quarter"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"),
    )


@registry("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day, first_value(event_type) OVER w AS first_type, nth_value(event_type, 2) OVER w AS second_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    day = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select("user_id", "event_id", F.count(F.lit(1)).over(day).alias("last_day"), F.first("event_type").over(w).alias("first_type"), F.nth_value("event_type", 2).over(w).alias("second_type"))


@registry("SELECT event_type, (json_extract(props, '$.k'))::BIGINT % 10 AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf, "events").groupBy("event_type", k.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@registry("SELECT rule, count(*) AS rows, count(DISTINCT query_vec_id) AS queries FROM (SELECT query_vec_id, unnest(matched_rules) AS rule FROM fused_results) GROUP BY 1")
def matched_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fused_results").select("query_vec_id", F.explode("matched_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("query_vec_id").alias("queries"))


@registry("""WITH p AS (SELECT ocr_id, bbox_json::JSON AS j FROM ocr WHERE bbox_json IS NOT NULL)
SELECT ocr_id, round(least(greatest((j->0->0)::DOUBLE, 0), 1), 6) AS x1, round(least(greatest((j->0->1)::DOUBLE, 0), 1), 6) AS y1, round(least(greatest((j->2->0)::DOUBLE, 0), 1), 6) AS x2, round(least(greatest((j->2->1)::DOUBLE, 0), 1), 6) AS y2 FROM p""")
def ocr_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """First and third corner of each polygon, clipped to the image."""
    o = table(spark, sf, "ocr").filter("bbox_json IS NOT NULL").withColumn("p", F.from_json("bbox_json", "array<array<double>>"))
    clip = lambda i, k: F.round(F.least(F.greatest(F.col("p")[i][k], F.lit(0.0)), F.lit(1.0)), 6)
    return o.select("ocr_id", clip(0, 0).alias("x1"), clip(0, 1).alias("y1"), clip(2, 0).alias("x2"), clip(2, 1).alias("y2"))


@registry()
def approximate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates by sketches: distinct prices and the median price of each brand; tested against exact figures."""
    p = table(spark, sf, "part")
    return p.groupBy("p_brand").agg(F.approx_count_distinct("p_retailprice").alias("prices"), F.percentile_approx("p_retailprice", 0.5, 10000).alias("median"))


@registry("SELECT * FROM events WHERE ('0x' || substring(md5(event_id::VARCHAR), 1, 8))::BIGINT % 10 = 0")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: a tenth of each event type by a hash of the id, so a row is in or out for good."""
    number = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, sf, "events").filter(number % 10 == 0)


@registry("""WITH RECURSIVE c AS (SELECT n_nationkey AS nation, n_regionkey AS step, 1 AS depth FROM nation UNION ALL SELECT nation, step + 5, depth + 1 FROM c WHERE depth < 4)
SELECT nation, max(step)::BIGINT AS last_step, count(*) AS steps FROM c GROUP BY 1""")
def recursive_steps(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("vidsift_nation")
    return spark.sql("""WITH RECURSIVE c(nation, step, depth) AS (SELECT n_nationkey, CAST(n_regionkey AS BIGINT), 1 FROM vidsift_nation UNION ALL SELECT nation, step + 5, depth + 1 FROM c WHERE depth < 4)
        SELECT nation, max(step) AS last_step, count(*) AS steps FROM c GROUP BY nation""")


@registry("SELECT label, round(sqrt(sum(x * x)), 6) AS spread FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY 1")
def grouped_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Plug-in surface: an Arrow aggregate of vectors in two steps, each batch to a partial sum, so no group gathers its vectors."""
    e = table(spark, sf, "embeddings").select("label", "embedding")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, rows in b.groupby("label"):
                m = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"label": [label], "n": [len(m)], "s": [m.sum(axis=0).tolist()]})

    p = e.mapInPandas(partial, "label int, n long, s array<double>").select("label", "n", F.posexplode("s").alias("i", "x"))
    mean = p.groupBy("label", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return mean.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("spread"))


@registry("""SELECT ocr_id, unnest(string_split(trim(text_folded), ' ')) AS word, generate_subscripts(string_split(trim(text_folded), ' '), 1)::INTEGER AS position FROM ocr WHERE trim(text_folded) <> ''""")
def word_udtf(spark: SparkSession, sf: str) -> DataFrame:
    """A Python table function over a lateral join: words with their positions."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="word string, position int")
    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split(" "), start=1):
                yield w, i

    spark.udtf.register("vidsift_words", Words)
    table(spark, sf, "ocr").filter("trim(text_folded) <> ''").createOrReplaceTempView("vidsift_ocr")
    return spark.sql("SELECT o.ocr_id, w.word, w.position FROM vidsift_ocr o, LATERAL vidsift_words(trim(o.text_folded)) w")


@registry("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the windowed stream."""
    return live.window_counts(table(spark, sf, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@registry("""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM n) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, g""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return live.session_counts(table(spark, sf, "events"), "ts", "user_id")


@registry("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1 hour'""")
def interval_sequences(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return live.sequences(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id", "ts").select("user_id", "first_id", "second_id")


@registry("SELECT s_nationkey, s_suppkey, s_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3")
def top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return rank_by(table(spark, sf, "supplier"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], "rank", 3).select("s_nationkey", "s_suppkey", "s_acctbal", "rank")


@registry("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1""")
def order_priority(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@registry("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)")
def above_average(spark: SparkSession, sf: str) -> DataFrame:
    """A scalar subquery: one row, so its broadcast is bounded."""
    c = table(spark, sf, "customer")
    mean = c.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("m"))
    return c.join(F.broadcast(mean), F.col("c_acctbal") > F.col("m")).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@registry("SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_share FROM lineitem JOIN part ON l_partkey = p_partkey")
def promotion_share(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return j.agg(F.round(100.0 * F.sum(F.when(F.col("p_type").like("PROMO%"), net).otherwise(0.0)) / F.sum(net), 6).alias("promo_share"))
