"""Queries over the driver's tables and the SQL they are checked against.

to 6 places on both sides; ties are settled by keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import aggregates as A
from quern.operators import dedup, lookup, ranking
from quern.operators import shaping as V
from quern.operators import split as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of its tables, named by its further arguments, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, t) for t in f.__code__.co_varnames[: f.__code__.co_argcount]])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest line of each order position, split by hash, with what each split holds."""
    return flagship_splits(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


LINE_KEYS, EVIDENCE = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"]


@query("""
WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1),
s AS (SELECT b.*, o.o_orderstatus, ('0x' || substr(sha256('0:' || l_orderkey::VARCHAR), 1, 15))::BIGINT AS u FROM best b JOIN orders o ON l_orderkey = o_orderkey),
t AS (SELECT *, CASE WHEN u < 23058430092136939 THEN 'test' WHEN u < 46116860184273879 THEN 'validation' ELSE 'train' END AS split FROM s)
SELECT split, count(*)::BIGINT AS lines, count(DISTINCT l_orderkey)::BIGINT AS orders, max(l_extendedprice) AS top_price, round(avg(1 / (1 + exp(-(l_quantity * 10 - 255) * 0.00368208))), 6) AS mean_expected FROM t GROUP BY split
""")
def flagship_splits(lineitem, orders):
    best = dedup.strongest(lineitem, LINE_KEYS, EVIDENCE).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return best.groupBy(P.split_label(F.col("l_orderkey")).alias("split")).agg(
        F.count("*").alias("lines"),
        F.countDistinct("l_orderkey").alias("orders"),
        F.max("l_extendedprice").alias("top_price"),
        F.round(F.avg(V.expected(F.col("l_quantity") * 10 - 255)), 6).alias("mean_expected"),
    )


@query("""
SELECT doc_id, CASE WHEN u < 23058430092136939 THEN 'test' WHEN u < 46116860184273879 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, ('0x' || substr(sha256('0:' || doc_id::VARCHAR), 1, 15))::BIGINT AS u FROM documents)
""")
def p2_hash_split(documents):
    return documents.select("doc_id", P.split_label(F.col("doc_id")).alias("split"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1
""")
def a1_strongest_dedup(lineitem):
    return dedup.strongest(lineitem.select(*LINE_KEYS, *EVIDENCE), LINE_KEYS, EVIDENCE)


@query("""
WITH w AS (SELECT l_extendedprice, l_quantity, max({'e': l_quantity, 'p': l_extendedprice}) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lineitem)
SELECT count(*)::BIGINT AS seen, count(*) FILTER (b IS NULL)::BIGINT AS kept, count(*) FILTER (b IS NOT NULL)::BIGINT AS duplicates,
count(*) FILTER (b.p <> l_extendedprice)::BIGINT AS conflicts, count(*) FILTER (b.e < l_quantity)::BIGINT AS replacements FROM w
""")
def a2_dedup_counters(lineitem):
    return dedup.counters(lineitem, LINE_KEYS, ["l_quantity"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.col("l_extendedprice"))


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INTEGER AS rank FROM lineitem) WHERE rank <= 8
""")
def r1_topk(lineitem):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return ranking.top_k(lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_suppkey"], order, 8)


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1
""")
def r2_first_best(orders):
    order = [F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"]
    return ranking.first_best(orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], order)


@query("""
WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1),
e AS (SELECT o.*, v.o_orderkey AS value_key, row_number() OVER (PARTITION BY o.o_custkey ORDER BY length(o.o_orderpriority) DESC, o.o_orderdate DESC, o.o_orderkey) AS pick
  FROM orders o JOIN v ON o.o_custkey = v.o_custkey WHERE o.o_orderdate >= v.o_orderdate - INTERVAL 90 DAY AND o.o_orderstatus = v.o_orderstatus AND abs(o.o_totalprice - v.o_totalprice) <= 100000)
SELECT o_custkey, value_key, o_orderkey AS policy_key FROM e WHERE pick = 1
""")
def r3_consistent_pick(orders):
    value = ranking.first_best(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"])
    value = value.select("o_custkey", F.col("o_orderkey").alias("value_key"), F.col("o_orderdate").alias("vd"), F.col("o_orderstatus").alias("vs"), F.col("o_totalprice").alias("vp"))
    near = orders.join(value, "o_custkey").where((F.col("o_orderdate") >= F.col("vd") - F.expr("interval 90 days")) & (F.col("o_orderstatus") == F.col("vs")) & (F.abs(F.col("o_totalprice") - F.col("vp")) <= 100000))
    pick = ranking.first_best(near, ["o_custkey"], [F.desc(F.length("o_orderpriority")), F.desc("o_orderdate"), "o_orderkey"])
    return pick.select("o_custkey", "value_key", F.col("o_orderkey").alias("policy_key"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings")
def r6_argmax(embeddings):
    return embeddings.select("vec_id", ranking.argmax_first(F.col("embedding")).alias("best"))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM o WHERE i IN (SELECT (k * ((SELECT count(*) FROM orders) - 1)) // 99 FROM (SELECT unnest(range(100)) AS k))
""")
def r8_uniform_sample(orders):
    return ranking.uniform_sample(orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query("""
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS filled FROM events
""")
def r10_ffill(events):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return ranking.filled_forward(events.select("event_id", "user_id", "ts", "event_type", "value"), value, ["user_id"], ["ts", "event_id"], "filled", F.lit(0.0)).select("event_id", "filled")


@query("""
SELECT o_custkey, count(*) FILTER (p > o_totalprice)::BIGINT AS falls, count(*) FILTER (p = o_totalprice)::BIGINT AS repeats FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY o_custkey
""")
def r11_order_check(orders):
    return ranking.order_violations(orders, ["o_custkey"], ["o_orderkey"], F.col("o_totalprice"))


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('17:3:' || c_custkey::VARCHAR), c_custkey)::BIGINT AS place FROM customer")
def r12_seeded_order(customer):
    keyed = customer.select("c_custkey", "c_nationkey", P.seeded_rank_key(F.col("c_custkey"), 17, 3).alias("seeded"))
    return ranking.numbered(keyed, ["c_nationkey"], ["seeded", "c_custkey"], "place").select("c_custkey", "c_nationkey", "place")


@query("""
SELECT l_suppkey, batch, count(*)::BIGINT AS n FROM (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 256 AS batch FROM lineitem) GROUP BY l_suppkey, batch
""")
def r13_batches(lineitem):
    placed = ranking.batches(lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 256)
    return placed.groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def s3_ordered_limit(orders):
    return ranking.limit_ordered(orders.select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], 500)


GATES_SQL = "CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' WHEN NOT o_totalprice >= 1000 THEN 'price' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'accepted' END"


def _order_gates():
    return [("status", F.col("o_orderstatus").isin("F", "O")), ("price", F.col("o_totalprice") >= 1000), ("urgent", F.col("o_orderpriority") != "1-URGENT")]


@query(f"SELECT {GATES_SQL} AS reason, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def f6_reason_counts(orders):
    return A.reason_counts(orders, _order_gates())


@query(f"SELECT o_orderkey, {GATES_SQL} AS reason FROM orders")
def f1_first_gate(orders):
    return orders.select("o_orderkey", A.first_failed(_order_gates()).alias("reason"))


@query("SELECT l_quantity::INTEGER AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def a4_hist(lineitem):
    return A.histogram(lineitem, F.col("l_quantity").cast("int"))


@query("""
WITH s AS (SELECT l_extendedprice / 100 - 500 AS s FROM lineitem),
b AS (SELECT CASE WHEN s >= -12501 AND s < -600 THEN 0 WHEN s >= -600 AND s < -200 THEN 1 WHEN s >= -200 AND s < -50 THEN 2 WHEN s >= -50 AND s < 50 THEN 3 WHEN s >= 50 AND s < 200 THEN 4 WHEN s >= 200 AND s < 600 THEN 5 WHEN s >= 600 AND s <= 12501 THEN 6 END AS bin FROM s)
SELECT g.bin::INTEGER AS bin, count(b.bin)::BIGINT AS n FROM (SELECT unnest(range(7)) AS bin) g LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin
""")
def a5_fixed_bins(lineitem):
    return A.fixed_bins(lineitem, F.col("l_extendedprice") / 100 - 500)


ELO_SQL = "greatest(-1000.0, least(1000.0, -400 * log10(1 / greatest(1e-9, least(1 - 1e-9, {0})) - 1)))"


@query(f"""
WITH g AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS p, day(o_orderdate) AS plies FROM orders),
c AS (SELECT o_custkey, count(*) AS n, sum(p) AS points, sum(plies) AS plies, count(*) FILTER (p = 1) AS w, count(*) FILTER (p = 0.5) AS d, count(*) FILTER (p = 0) AS l FROM g GROUP BY 1),
t AS (SELECT sum(n)::BIGINT AS games, count(*)::BIGINT AS groups, sum(w)::BIGINT AS wins, sum(d)::BIGINT AS draws, sum(l)::BIGINT AS losses, sum(points) / sum(n) AS score, (sum(plies) / sum(n))::DOUBLE AS mean_plies, sqrt((sum(n * n) / (sum(n) * sum(n)))::DOUBLE * ln(2 / 0.05) / 2) AS r FROM c),
b AS (SELECT *, greatest(0.0::DOUBLE, score - r) AS lo, least(1.0::DOUBLE, score + r) AS hi FROM t)
SELECT games, groups, wins, draws, losses, round(score, 6) AS score, round(mean_plies, 6) AS mean_plies, round(lo, 6) AS score_low, round(hi, 6) AS score_high,
round({ELO_SQL.format("score")}, 4) AS elo, round({ELO_SQL.format("lo")}, 4) AS elo_low, round({ELO_SQL.format("hi")}, 4) AS elo_high FROM b
""")
def a11_grouped_bound(orders):
    points = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.0)
    found = A.match_summary(orders, points, F.dayofmonth("o_orderdate"), F.col("o_custkey"))
    return found.select("games", "groups", "wins", "draws", "losses", *[F.round(c, 6).alias(c) for c in ("score", "mean_plies", "score_low", "score_high")], *[F.round(c, 4).alias(c) for c in ("elo", "elo_low", "elo_high")])


@query(f"SELECT c_custkey, round({ELO_SQL.format('(c_acctbal + 1000) / 11000')}, 4) AS elo FROM customer")
def a12_elo(customer):
    return customer.select("c_custkey", F.round(A.elo_of((F.col("c_acctbal") + 1000) / 11000), 4).alias("elo"))


@query("""
WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS wins, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS losses FROM orders GROUP BY o_custkey),
z AS (SELECT *, CASE WHEN wins + losses > 0 THEN (wins - losses) / sqrt(2.0 * (wins + losses)) ELSE 0.0 END::DOUBLE AS z FROM c)
SELECT o_custkey, wins, losses, round(CASE WHEN z = 0 THEN 0.5 ELSE (1 + 2 / sqrt(pi()) * z * exp(-z * z) * list_sum(list_transform(range(0, 120), lambda n: exp(n * ln(2 * z * z) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2)))) / 2 END, 9) AS superiority FROM z
""")
def a13_superiority(orders):
    found = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("wins"), F.count_if(F.col("o_orderstatus") == "P").alias("losses"))
    return found.withColumn("superiority", F.round(A.likelihood_of_superiority(F.col("wins"), F.col("losses")), 9))


@query("""
WITH e AS (SELECT vec_id, label, embedding AS v, CASE WHEN vec_id % 90 < 20 THEN 'early' WHEN vec_id % 90 < 60 THEN 'mid' ELSE 'endgame' END AS phase FROM embeddings),
m AS (SELECT phase, len(list_filter(range(64), lambda i: v[i + 1] > v[label + 1] OR (v[i + 1] = v[label + 1] AND i < label))) AS above FROM e)
SELECT phase, count(*)::BIGINT AS n, round(avg((above < 1)::INTEGER), 6) AS top1, round(avg((above < 5)::INTEGER), 6) AS top5 FROM m GROUP BY ROLLUP (phase)
""")
def a14_topk_accuracy(embeddings):
    found = A.topk_accuracy(embeddings, F.col("embedding"), F.col("label"), A.phase(F.col("vec_id") % 90))
    return found.select("phase", "n", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query("""
WITH b AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch, o_totalprice AS v FROM orders), m AS (SELECT batch, avg(v) AS mean, sum(v) AS total, count(*) AS n FROM b GROUP BY batch)
SELECT round(avg(mean), 4) AS batch_mean, round(sum(total) / sum(n), 4) AS row_mean, count(*)::BIGINT AS batches FROM m
""")
def a15_batch_means(orders):
    placed = ranking.ordinals(orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], "place")
    found = A.mean_of_batch_means(placed, F.floor(F.col("place") / 64), F.col("o_totalprice"))
    return found.select(F.round("batch_mean", 4).alias("batch_mean"), F.round("row_mean", 4).alias("row_mean"), "batches")


SOFT_SQL = "WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS w FROM embeddings), p AS (SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM r) "


@query(SOFT_SQL + "SELECT vec_id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy FROM p")
def a16_entropy(embeddings):
    shares = V.softmax(F.col("embedding").cast("array<double>"))
    return embeddings.select("vec_id", F.round(V.entropy(shares), 6).alias("entropy"))


@query("""
WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
f AS (SELECT user_id, t, value::DOUBLE AS m FROM s WHERE t = 1 UNION ALL SELECT s.user_id, s.t, least(0.999, (1.0 + s.t) / (10.0 + s.t))::DOUBLE * f.m + (1 - least(0.999, (1.0 + s.t) / (10.0 + s.t)))::DOUBLE * s.value FROM f JOIN s ON s.user_id = f.user_id AND s.t = f.t + 1)
SELECT user_id, round(arg_max(m, t), 3) AS mean FROM f GROUP BY user_id
""")
def a17_moving_average(events):
    return A.moving_averages(events, ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("mean", 3).alias("mean"))


@query("SELECT event_id, (CASE WHEN value > 80 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (12500 - least(abs(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 700 + 1)), 499)) ELSE greatest(-11999, least(11999, round_even(value * 100 - 3000.5, 0))) END)::INTEGER AS score FROM events")
def e12_encode_score(events):
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    mate = F.when(F.col("value") > 80, (sign * (F.col("event_id") % 700 + 1)).cast("int"))
    return events.select("event_id", V.encode_score(F.col("value") * 100 - 3000.5, mate).alias("score"))


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal * 0.00368208)), 6) AS expected, round(CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END, 6) AS to_move FROM customer")
def e14_expected(customer):
    turn = F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("w")
    return customer.select("c_custkey", F.round(V.expected(F.col("c_acctbal")), 6).alias("expected"), F.round(V.to_move(F.col("c_acctbal"), turn), 6).alias("to_move"))


@query("SELECT page_id, nullif(regexp_extract(url, '[0-9][0-9'']*'), '')::BIGINT AS number, length(html) * CASE WHEN contains(lower(url), 'gb') THEN 1024 ELSE 1 END::BIGINT AS scaled FROM pages")
def e16_numbers(pages):
    scaled = F.length("html") * F.when(F.contains(F.lower("url"), F.lit("gb")), F.lit(1024)).otherwise(F.lit(1))
    return pages.select("page_id", T.first_int(F.col("url")).alias("number"), scaled.cast("long").alias("scaled"))


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END)::INTEGER AS value FROM orders")
def e18_result_value(orders):
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("1/2-1/2")
    return orders.select("o_orderkey", V.result_value(result, F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise("w")).cast("int").alias("value"))


@query("SELECT c_custkey, round(1 / (1 + pow(10, -c_acctbal / 400)), 6) AS bar, round((exp(2 * c_acctbal / 3500) - 1) / (exp(2 * c_acctbal / 3500) + 1), 6) AS graph FROM customer")
def e23_display(customer):
    return customer.select("c_custkey", F.round(V.bar(F.col("c_acctbal")), 6).alias("bar"), F.round(V.graph(F.col("c_acctbal") / 10), 6).alias("graph"))


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'early' WHEN p_size < 60 THEN 'mid' ELSE 'endgame' END AS phase FROM part")
def e24_phase(part):
    return part.select("p_partkey", A.phase(F.col("p_size")).alias("phase"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey < 100 THEN (o_orderkey + 1) / 100.0 ELSE 0.05 + 0.95 * 0.5 * (1 + cos(pi() * least(1.0, (o_orderkey - 100) / 9900.0))) END, 6)::DOUBLE AS rate FROM orders")
def e25_learning_rate(orders):
    return orders.select("o_orderkey", F.round(V.learning_rate(F.col("o_orderkey"), 10000, 100), 6).alias("rate"))


@query("""
WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rn FROM nation) WHERE rn = 1)
SELECT s_suppkey, n_name, s_acctbal FROM supplier JOIN nation USING (n_nationkey) WHERE false UNION ALL SELECT s.s_suppkey, d.n_name, s.s_acctbal FROM supplier s JOIN d ON s.s_nationkey = d.n_nationkey WHERE s.s_acctbal >= 1000
""".replace("SELECT s_suppkey, n_name, s_acctbal FROM supplier JOIN nation USING (n_nationkey) WHERE false UNION ALL ", ""))
def j1_rating_join(supplier, nation):
    one = ranking.first_best(nation, ["n_regionkey"], [F.desc("n_nationkey")])
    return lookup.keyed_attributes(supplier.withColumnRenamed("s_nationkey", "n_nationkey"), one, "n_nationkey", [F.col("n_name")]).where("s_acctbal >= 1000").select("s_suppkey", "n_name", "s_acctbal")


@query("""
SELECT c.c_custkey, coalesce(o.top, CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END, -1.0) AS rating FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
""")
def j2_fallback(customer, orders):
    top = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    found = lookup.left_lookup(customer, top, F.col("c_custkey") == F.col("o_custkey"), F.col("top"), [F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(-1.0)], "rating")
    return found.select("c_custkey", "rating")


@query("""
WITH h AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ply FROM events), b AS (SELECT 'purchase' AS event_type, 'bought' AS name UNION ALL SELECT 'signup', 'joined')
SELECT user_id, arg_max(ply, ply) FILTER (name IS NOT NULL) AS ply, arg_max(name, ply) FILTER (name IS NOT NULL) AS name FROM h LEFT JOIN b USING (event_type) GROUP BY user_id
""")
def j3_last_match(events):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    history = events.select("user_id", "event_type", F.row_number().over(w).alias("ply"))
    book = events.sparkSession.createDataFrame([("purchase", "bought"), ("signup", "joined")], "event_type string, name string")
    return lookup.last_match(history, book, "event_type", "user_id", "ply", ["name"])


@query("""
WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS steps FROM events GROUP BY user_id), b AS (SELECT ['click'] AS p, 'A' AS name UNION ALL SELECT ['click', 'view'], 'B' UNION ALL SELECT ['view'], 'C' UNION ALL SELECT ['view', 'view', 'click'], 'D' UNION ALL SELECT ['purchase'], 'E')
SELECT s.user_id, max(len(p))::INTEGER AS matched, arg_max(name, len(p)) AS name FROM s LEFT JOIN b ON s.steps[1:len(b.p)] = b.p GROUP BY s.user_id
""")
def j4_prefix(events):
    book = events.sparkSession.createDataFrame([(["click"], "A"), (["click", "view"], "B"), (["view"], "C"), (["view", "view", "click"], "D"), (["purchase"], "E")], "prefix array<string>, name string")
    return lookup.longest_prefix(lookup.first_steps(events, "user_id", ["ts", "event_id"], "event_type", 3), "steps", book, "prefix", "name", "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j5_missing(customer, orders):
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.missing(customer, urgent, ["c_custkey"]).select("c_custkey")


@query("SELECT vec_id, CASE WHEN label >= 2 THEN embedding[label - 1] END AS one, embedding[label + 1] AS two FROM embeddings")
def j7_gather(embeddings):
    found = lookup.gather(F.col("embedding"), F.array(F.col("label") - 2, F.col("label")))
    return embeddings.select("vec_id", found[0].alias("one"), found[1].alias("two"))


@query("""
SELECT conv_id, turn, next_turn, next_chars FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, lead(length(text)) OVER w::INTEGER AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'
""")
def j8_pairing(conversations):
    rows = conversations.withColumn("chars", F.length("text"))
    found = lookup.adjacent_pairs(rows, "conv_id", "turn", ["turn", "chars"], F.col("role") == "user", F.col("role") == "assistant")
    return found.select("conv_id", "turn", "next_turn", "next_chars")


@query("SELECT event_id, length(event_type)::INTEGER AS size FROM events")
def j9_evaluate_once(events):
    return lookup.evaluate_once(events, "event_type", lambda keys: keys.withColumn("size", F.length("event_type"))).select("event_id", "size")


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def p6_first_identity(orders):
    return dedup.first_arrival(orders.select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def u1_union(supplier, customer):
    return dedup.concatenated([supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))])


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 50")
def u2_difference(part, lineitem):
    return lookup.missing(part.select("p_partkey"), lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT key, arg_min(name, o) AS name FROM (SELECT s_suppkey AS key, s_name AS name, 0 AS o FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer) GROUP BY key")
def u3_first_wins(supplier, customer):
    return dedup.first_source([supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))], ["key"])


W_SQL = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 300) AS s FROM embeddings), r AS (SELECT vec_id, list_transform(s, lambda x: 1 / (1 + exp(-x * 0.00368208)) / 0.04 + x / 2000) AS r FROM s), w AS (SELECT vec_id, list_transform(r, lambda x: exp(x - list_max(r))) AS w FROM r) "


@query(W_SQL + "SELECT vec_id, unnest(range(64))::INTEGER AS place, round(unnest(list_transform(w, lambda x: x / list_sum(w))), 6) AS target FROM w")
def v1_policy_targets(embeddings):
    found = embeddings.select("vec_id", V.policy_targets(F.transform("embedding", lambda x: x.cast("double") * 300)).alias("t"))
    return found.select("vec_id", F.posexplode("t").alias("place", "target")).withColumn("target", F.round("target", 6))


@query(SOFT_SQL + "SELECT vec_id, round(2 * list_sum(list_transform(range(64), lambda i: p[i + 1] * (i + 0.5) / 64)) - 1, 6) AS value FROM p")
def v3_bin_value(embeddings):
    return embeddings.select("vec_id", F.round(V.value_of_bins(V.softmax(F.col("embedding").cast("array<double>"))), 6).alias("value"))


@query(SOFT_SQL + "SELECT vec_id, round(-0.7 * ln(p[label + 1]) - 0.3 * ln(p[1]), 6) AS loss FROM p")
def v4_cross_entropy(embeddings):
    values = F.col("embedding").cast("array<double>")
    places, targets = F.array(F.col("label"), F.lit(0), F.lit(-1)), F.array(F.lit(0.7), F.lit(0.3), F.lit(0.5))
    return embeddings.select("vec_id", F.round(V.cross_entropy(values, places, targets), 6).alias("loss"))


@query("SELECT p_partkey, round(CASE WHEN 1 - p_size / 50.0 >= 1.0 - 1e-7 THEN -12000 WHEN p_size / 50.0 >= 1.0 - 1e-7 THEN 12000 ELSE greatest(-11999, least(11999, 100 + 380 * ln((p_size / 50.0) / (1 - p_size / 50.0)))) END, 4)::DOUBLE AS score FROM part")
def v6_old_scores(part):
    win = F.col("p_size") / 50.0
    return part.select("p_partkey", F.round(V.old_score(win, 1 - win), 4).alias("score"))


@query("""
WITH v AS (SELECT l_suppkey, list(n ORDER BY l_returnflag) AS v FROM (SELECT l_suppkey, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1), r AS (SELECT l_suppkey, list_transform(v, lambda x: pow(x / list_max(v), 2)) AS r FROM v)
SELECT l_suppkey, round(r[1] / list_sum(r), 6) AS first FROM r
""")
def v7_visit_policy(lineitem):
    n = lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").cast("double").alias("n"))
    v = n.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))), lambda r: r["n"]).alias("v"))
    return v.select("l_suppkey", F.round(V.visit_policy(F.col("v"), 0.5)[0], 6).alias("first"))


@query("""
WITH e AS (SELECT vec_id, embedding AS q, list_transform(range(64), lambda i: ((i * 7) % 5)::DOUBLE) AS n FROM embeddings), w AS (SELECT vec_id, n, list_transform(range(1, 65), lambda i: q[i]::DOUBLE * n[i]) AS w FROM e),
s AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN n[i] > 0 THEN w[i] / n[i] ELSE list_sum(w) / list_sum(n) - 0.3 END + 1.5 * sqrt(list_sum(n) + 1) / 64 / (1 + n[i])) AS s FROM w)
SELECT vec_id, (list_position(s, list_max(s)) - 1)::INTEGER AS pick FROM s
""")
def m1_puct(embeddings):
    visits = F.array(*[F.lit(float(i * 7 % 5)) for i in range(64)])
    sums = F.zip_with(F.col("embedding").cast("array<double>"), visits, lambda q, n: q * n)
    return embeddings.select("vec_id", ranking.argmax_first(V.puct_scores(F.array_repeat(F.lit(1 / 64), 64), visits, sums)).alias("pick"))
