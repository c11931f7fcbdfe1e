"""The relational surface: scans, joins, aggregates, windows, set operations and functions, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.runtime import table

#: name -> (tables, Spark SQL, SQL of the check where it differs). One query for each kind of operator.
SPECS: dict[str, tuple[str, str, str | None]] = {
    "scan_project_filter": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus IS NOT NULL", None),
    "distinct_values": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "like_and_case": ("part", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END AS metal FROM part WHERE p_name LIKE '%a%'", None),
    "values_rows": ("nation", "SELECT v.a, v.b, count(n_nationkey) AS n FROM (VALUES (0, 'x'), (1, 'y'), (9, 'z')) AS v(a, b) LEFT JOIN nation ON n_regionkey = a GROUP BY v.a, v.b", None),
    "inner_join": ("orders customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", None),
    "left_join": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", None),
    "right_join": ("orders customer", "SELECT c_custkey, max(o_totalprice) AS top FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "full_join": ("supplier customer", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON s_nationkey = c_nationkey", None),
    "semi_in": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "anti_exists": ("customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", None),
    "self_join": ("nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "range_join": ("supplier", "SELECT band, count(*) AS n FROM supplier JOIN (VALUES ('low', -1000, 0), ('mid', 0, 5000), ('high', 5000, 10000)) AS b(band, lo, hi) ON s_acctbal >= lo AND s_acctbal < hi GROUP BY band", None),
    "cross_join_small": ("region", "SELECT r_name, k FROM region CROSS JOIN (VALUES (1), (2)) AS v(k)", None),
    "correlated_scalar": ("orders customer", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", None),
    "aggregates": ("lineitem", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS q, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_suppkey) AS suppliers, round(stddev(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag", None),
    "median_quantiles": ("orders", "SELECT o_orderpriority, median(o_totalprice) AS med, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, median(o_totalprice) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority"),
    "filtered_aggregate": ("lineitem", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem GROUP BY l_suppkey", None),
    "arg_max": ("orders", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_orderkey AS top FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1"),
    "having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "nested_aggregate": ("orders", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x GROUP BY n", None),
    "grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", None),
    "cube": ("customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)", None),
    "rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "window_dedupe": ("events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) x WHERE rn = 1", None),
    "window_functions": ("orders", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_orderkey) OVER w AS next, CAST(ntile(4) OVER w AS BIGINT) AS quarter, first_value(o_orderkey) OVER w AS first, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "window_frames": ("events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day FROM events", None),
    "gaps_and_islands": ("events", "SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS days FROM (SELECT user_id, d, date_sub(d, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT)) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) x) y GROUP BY user_id, g", "SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS days FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) x) y GROUP BY user_id, g"),
    "top_k": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 25", None),
    "offset_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20", None),
    "union_distinct": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("customer supplier", "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier", None),
    "intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("part lineitem", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45", None),
    "cte_max": ("orders", "WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, o_totalprice FROM orders) SELECT yr, max(o_totalprice) AS top FROM y GROUP BY yr", None),
    "recursive_cte": ("region", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n, r_name FROM r JOIN region ON r_regionkey = n % 5", None),
    "date_functions": ("orders", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, last_day(CAST(o_orderdate AS DATE)) AS e, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, last_day(CAST(o_orderdate AS DATE)) AS e, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS n FROM orders"),
    "string_functions": ("customer", "SELECT c_custkey, lower(c_mktsegment) AS l, substring(c_name, 1, 4) AS s, regexp_replace(c_name, '[0-9]+', '#') AS r, split_part(c_name, '#', 2) AS p, length(c_name) AS n FROM customer", "SELECT c_custkey, lower(c_mktsegment) AS l, substring(c_name, 1, 4) AS s, regexp_replace(c_name, '[0-9]+', '#') AS r, split_part(c_name, '#', 2) AS p, CAST(length(c_name) AS INT) AS n FROM customer"),
    "json_functions": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "math_functions": ("supplier", "SELECT s_suppkey, round(abs(s_acctbal), 1) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(ln(abs(s_acctbal) + 1), 6) AS l, s_acctbal / nullif(s_nationkey, 0) AS q FROM supplier", "SELECT s_suppkey, round(abs(s_acctbal), 1) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(ln(abs(s_acctbal) + 1), 6) AS l, s_acctbal / nullif(s_nationkey, 0) AS q FROM supplier"),
    "array_functions": ("embeddings", "SELECT vec_id, size(embedding) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 6) AS first, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x), 4) AS norm FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm FROM embeddings"),
    "map_functions": ("orders", "SELECT o_orderkey, element_at(map(o_orderstatus, o_orderpriority), 'F') AS f, CAST(size(map_keys(map_from_arrays(array(o_orderstatus, 'Z'), array(1, 2)))) AS BIGINT) AS n FROM orders", "SELECT o_orderkey, map_extract(MAP {o_orderstatus: o_orderpriority}, 'F')[1] AS f, len(map_keys(MAP([o_orderstatus, 'Z'], [1, 2]))) AS n FROM orders"),
    "sequence_explode": ("region", "SELECT r_regionkey, CAST(d AS DATE) AS d FROM region LATERAL VIEW explode(sequence(DATE '2024-02-27', DATE '2024-03-02', INTERVAL 1 DAY)) t AS d", "SELECT r_regionkey, CAST(unnest(generate_series(DATE '2024-02-27', DATE '2024-03-02', INTERVAL 1 DAY)) AS DATE) AS d FROM region"),
    "casts": ("manifest", "SELECT doc_id, try_cast(nullif(published_on, '') AS DATE) AS published, is_current = 'true' AS cur FROM manifest", "SELECT doc_id, try_cast(nullif(published_on, '') AS DATE) AS published, is_current = 'true' AS cur FROM manifest"),
}


def _query(names: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(_bound(sql, names.split()), **{n: table(spark, d, n) for n in names.split()})

    return run


def _bound(sql: str, names: list[str]) -> str:
    """Table names in FROM and JOIN as parameters, so that no view has to be registered."""
    import re

    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}} AS {n}" if not re.search(rf"\b(FROM|JOIN)\s+{n}\s+[ab]\b", sql) else rf"\1 {{{n}}}", sql)
    return sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"sql_{k}": _query(t, q) for k, (t, q, _) in SPECS.items()}
SQL: dict[str, str] = {f"sql_{k}": other or q for k, (_, q, other) in SPECS.items()}
