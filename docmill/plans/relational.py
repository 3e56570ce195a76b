"""The SQL surface: joins, aggregates, windows, set operations, and scalar functions.

Each entry is SQL that Catalyst plans over the tables as views. Where DuckDB's dialect differs, the second
text is the oracle's; else one text serves both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.scratch import written
from docmill.session import TABLES, register, table

SAME: dict[str, str] = {
    # ------------------------------------------------------------ joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT n_nationkey, count(s_suppkey) AS n_suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    "join_full": "SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, nc, ns FROM (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c_nationkey = s_nationkey",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_nested_loop": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND length(a.n_name) <> length(b.n_name)",
    "join_star": "SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "in_subquery": "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "correlated_subquery": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "common_table_expression": "WITH r AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), m AS (SELECT avg(s) AS a FROM r) SELECT o_custkey, round(s, 2) AS total FROM r, m WHERE s > 2 * a",
    # ------------------------------------------------------------ aggregates
    "agg_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
    "agg_filter_clause": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_having": "SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 1000",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_moments": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag",
    "agg_extremes": "SELECT o_orderstatus, max(o_totalprice) AS top, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus",
    "agg_max_by": "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_orderstatus",
    "agg_mode": "SELECT c_mktsegment, mode(n) AS commonest FROM (SELECT c_mktsegment, CASE WHEN c_nationkey < 20 THEN 'most' ELSE 'rest' END AS n FROM customer) t GROUP BY c_mktsegment",
    # ------------------------------------------------------------ windows, order, top-k
    "win_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
    "win_distribution": "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS quartile FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows_frame": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS q2 FROM lineitem",
    "win_range_frame": "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM customer",
    "topk_per_group": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "sort_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "sort_nulls": "SELECT k, v FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS v FROM orders) t ORDER BY v ASC NULLS LAST, k",
    "sort_nulls_first": "SELECT k, v, row_number() OVER (ORDER BY v ASC NULLS FIRST, k DESC) AS place FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS v FROM nation) t",
    # ------------------------------------------------------------ set operations
    "setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "setop_union_all": "SELECT 'c' AS side, c_nationkey AS k FROM customer UNION ALL SELECT 's' AS side, s_nationkey AS k FROM supplier",
    "setop_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier",
    "setop_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "setop_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "setop_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    # ------------------------------------------------------------ scalar functions
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_name, 2, 4) AS s, replace(p_type, ' ', '_') AS t, concat(p_brand, '-', p_type) AS c, lpad(cast(p_size AS varchar(10)), 4, '0') AS p, reverse(p_brand) AS r, levenshtein(p_brand, p_type) AS d FROM part",
    "fn_math": "SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 2) AS p, p_size % 7 AS m, round(sqrt(p_retailprice), 6) AS q, floor(p_retailprice / 10) * 10 AS f, abs(p_size - 25) AS a FROM part",
    "fn_conditional": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS tier, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, greatest(o_custkey, 100) AS g FROM orders",
    "fn_date": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q FROM orders",
}

DIFFERENT: dict[str, tuple[str, str]] = {
    "join_range": (
        "SELECT a.e AS event_id, count(b.event_id) AS near FROM (SELECT event_id AS e, user_id AS u, ts AS t FROM events WHERE event_type = 'purchase') a LEFT JOIN events b ON a.u = b.user_id AND b.ts BETWEEN a.t - INTERVAL 1 HOUR AND a.t GROUP BY a.e",
        "SELECT a.e AS event_id, count(b.event_id) AS near FROM (SELECT event_id AS e, user_id AS u, ts AS t FROM events WHERE event_type = 'purchase') a LEFT JOIN events b ON a.u = b.user_id AND b.ts BETWEEN a.t - INTERVAL 1 HOUR AND a.t GROUP BY a.e",
    ),
    "lateral_words": (
        "SELECT conv_id, turn, w FROM conversations LATERAL VIEW explode(split(text, ' ')) x AS w",
        "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations",
    ),
    "win_groups_frame": (
        # Spark has no GROUPS frames: peers have one dense rank, and a range over ranks is a frame over groups
        "SELECT c_custkey, g, count(*) OVER (PARTITION BY c_mktsegment ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM (SELECT c_custkey, c_mktsegment, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS g FROM customer) t",
        "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS g, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM customer",
    ),
    "join_hint_broadcast": (
        "SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "join_hint_merge": (
        "SELECT /*+ MERGE(o) */ c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment",
        "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    ),
    "join_hint_hash": (
        "SELECT /*+ SHUFFLE_HASH(c) */ c_mktsegment, round(sum(o_totalprice), 2) AS total FROM customer c JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment",
        "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    ),
    "sample_by_hash": (
        "SELECT o_orderkey FROM orders WHERE cast(conv(substring(md5(cast(o_orderkey AS string)), 1, 4), 16, 10) AS int) < 6554",
        "SELECT o_orderkey FROM orders WHERE CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS INTEGER) < 6554",
    ),
    "fn_struct_map": (
        "SELECT p_partkey, m['brand'] AS brand, size(map_keys(m)) AS n, s.size + 1 AS next_size, array_join(sort_array(map_values(transform_values(m, (k, v) -> upper(v)))), '|') AS loud FROM (SELECT p_partkey, map('brand', p_brand, 'type', p_type) AS m, named_struct('size', p_size, 'name', p_name) AS s FROM part)",
        "SELECT p_partkey, p_brand AS brand, 2 AS n, s.size + 1 AS next_size, array_to_string(list_sort([upper(p_brand), upper(p_type)]), '|') AS loud FROM (SELECT *, {'size': p_size, 'name': p_name} AS s FROM part)",
    ),
    "fn_json_extract": (
        "SELECT event_id, get_json_object(j, '$.a.b') AS b, from_json(j, 'a struct<b: string, c: array<int>>').a.c[1] AS second, to_json(named_struct('k', user_id)) AS back FROM (SELECT event_id, user_id, concat('{\"a\": {\"b\": \"', event_type, '\", \"c\": [1, ', cast(user_id AS string), ']}}') AS j FROM events)",
        "SELECT event_id, json_extract_string(j, '$.a.b') AS b, CAST(json_extract(j, '$.a.c[1]') AS INTEGER) AS second, '{\"k\":' || user_id || '}' AS back FROM (SELECT event_id, user_id, '{\"a\": {\"b\": \"' || event_type || '\", \"c\": [1, ' || user_id || ']}}' AS j FROM events)",
    ),
    "lateral_join": (
        "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
        "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
    ),
    "lateral_unnest": (
        "SELECT conv_id, turn, w FROM conversations JOIN LATERAL explode(split(text, ' ')) x(w)",
        "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations",
    ),
    "agg_list": (
        "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, to_json(sort_array(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey",
    ),
    "agg_arg_max": (
        "SELECT o_orderstatus, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top_key FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_key FROM orders GROUP BY o_orderstatus",
    ),
    "qualify_latest": (
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1",
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    ),
    "pivot_status": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority",
    ),
    "unpivot_price": (
        "SELECT p_partkey, measure, amount FROM (SELECT p_partkey, cast(p_size AS double) AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR measure IN (size, price))",
        "SELECT p_partkey, 'size' AS measure, cast(p_size AS double) AS amount FROM part UNION ALL SELECT p_partkey, 'price' AS measure, p_retailprice AS amount FROM part",
    ),
    "recursive_cte": (
        "WITH RECURSIVE t(k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM t WHERE k < 24) SELECT k, n_name FROM t JOIN nation ON k = n_nationkey",
        "WITH RECURSIVE t(k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM t WHERE k < 24) SELECT k, n_name FROM t JOIN nation ON k = n_nationkey",
    ),
    "fn_date_arithmetic": (
        "SELECT o_orderkey, cast(date_trunc('month', o_orderdate) AS date) AS m, datediff(date '1998-12-31', cast(o_orderdate AS date)) AS age, cast(cast(o_orderdate AS date) + INTERVAL 7 DAY AS date) AS due FROM orders",
        "SELECT o_orderkey, cast(date_trunc('month', o_orderdate) AS date) AS m, cast(date_diff('day', cast(o_orderdate AS date), date '1998-12-31') AS integer) AS age, cast(cast(o_orderdate AS date) + INTERVAL 7 DAY AS date) AS due FROM orders",
    ),
    "fn_json": (
        "SELECT event_id, coalesce(size(json_object_keys(props)), 0) AS n_keys FROM events",
        "SELECT event_id, cast(coalesce(len(json_keys(props)), 0) AS integer) AS n_keys FROM events",
    ),
    "fn_regexp": (
        "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, p_type rlike '^[A-Z]' AS cap FROM part",
        "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_matches(p_type, '^[A-Z]') AS cap FROM part",
    ),
    "fn_array": (
        "SELECT vec_id, round(aggregate(transform(embedding, x -> cast(x AS double) * x), 0D, (a, x) -> a + x), 4) AS sq, size(filter(embedding, x -> x > 0)) AS positive, round(cast(array_max(embedding) AS double), 5) AS top FROM embeddings",
        "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x AS double) * x)), 4) AS sq, cast(len(list_filter(embedding, lambda x: x > 0)) AS integer) AS positive, round(cast(list_max(embedding) AS double), 5) AS top FROM embeddings",
    ),
    "asof_join": (
        # the latest row at or before each row's time, by one sort over the union of both sides
        "SELECT event_id, last_view FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events) t WHERE event_type = 'purchase'",
        "SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    ),
}


def _run(text: str):
    names = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))

    def query(spark, sf_dir):
        register(spark, sf_dir, names)
        return spark.sql(text)

    return query


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """A union by the names of the columns, in whatever order they stand; a column that one side lacks is null there."""
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    two = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    return one.unionByName(two, allowMissingColumns=True)


def exact_quantiles(rows: DataFrame, by: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """by, and a column for each wanted quantile, between two values in proportion; nulls do not count.

    Values are counted by ranges of their order and only those of the ranges that hold the ranks are looked at, so no
    group's values come together in one task.
    """
    plain = rows.select(F.struct(F.col(by).alias("b")).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    values = written(plain.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()), "values")
    parts = values.groupBy("g", "part").agg(F.sum("c").alias("n"))  # a row a group and partition
    w = Window.partitionBy("g")
    parts = parts.withColumns({"before": F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), "all": F.sum("n").over(w)}).na.fill(0, ["before"])
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in wanted.items()]))
    ranks = parts.withColumn("w", asked).withColumn("at", F.col("w.q") * (F.col("all") - 1))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    held = values.join(F.broadcast(ranks.select("g", "part", "before").distinct()), ["g", "part"])
    sums = held.withColumn("last", F.col("before") + F.sum("c").over(Window.partitionBy("g", "part").orderBy("v")))
    found = sums.select(F.col("g").alias("h"), F.col("v"), (F.col("last") - F.col("c")).alias("first"), "last")
    at = ranks.select("g", F.col("w.name").alias("name"), "at", "rank").join(found, (F.col("g") == F.col("h")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    each = at.groupBy("g", "name").agg((low + (F.max("at") - F.floor(F.max("at"))) * (high - low)).alias("x"))
    known = each.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in wanted])
    every = rows.select(F.struct(F.col(by).alias("b")).alias("g")).distinct()  # in a struct, so that nulls are a group
    return every.join(known, "g", "left").select(F.col("g.b").alias(by), *wanted)


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = exact_quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"p25": 0.25, "p90": 0.9})
    return found.select("l_returnflag", F.round("p25", 4).alias("p25"), F.round("p90", 4).alias("p90"))


def approximate(spark: SparkSession, d: str) -> DataFrame:
    """Sketches held against exact figures: the relative error of the counts, and the distance of the median.

    The exact figures come from aggregates of their own: with distinct counts in the same one every row would be
    written for each of them, and every sketch be built from rows that were shuffled.
    """
    t = table(spark, d, "lineitem")
    sketched = t.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey", 14)).alias("supps"), F.expr("approx_percentile(l_extendedprice, 0.5, 10000)").alias("median"))
    count = lambda c, name: t.filter(F.col(c).isNotNull()).select(F.col("l_returnflag").alias("f"), c).distinct().groupBy("f").agg(F.count("*").alias(name))
    exact = exact_quantiles(t, "l_returnflag", "l_extendedprice", {"middle": 0.5}).withColumnRenamed("l_returnflag", "f")
    for one in (count("l_partkey", "n_parts"), count("l_suppkey", "n_supps"), exact):
        sketched = sketched.join(F.broadcast(one), F.col("l_returnflag").eqNullSafe(F.col("f")), "left").drop("f")
    near = lambda a, b, e: F.abs(F.col(a) - F.col(b)) <= e * F.col(b)
    known = sketched.na.fill(0, ["n_parts", "n_supps"])
    return known.select("l_returnflag", near("parts", "n_parts", 0.05).alias("distinct_ok"), near("supps", "n_supps", 0.05).alias("sketch_ok"), near("median", "middle", 0.02).alias("median_ok"))


#: Queries that are DataFrame code, with their SQL.
CODE = {
    "agg_approximate": (approximate, "SELECT l_returnflag, true AS distinct_ok, true AS sketch_ok, true AS median_ok FROM lineitem GROUP BY l_returnflag"),
    "agg_quantile": (quantiles, "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag"),
    "setop_union_by_name": (union_by_name, "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name, s_suppkey AS k FROM supplier"),
}


def queries() -> dict:
    return {name: run for name, (run, _) in CODE.items()} | {name: _run(text) for name, text in SAME.items()} | {name: _run(text) for name, (text, _) in DIFFERENT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CODE.items()} | dict(SAME) | {name: text for name, (_, text) in DIFFERENT.items()}
