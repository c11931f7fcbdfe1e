import pytest

from lodestream import config
from lodestream.plans import answer, execute, guard
from tests.test_bulletins import TABLE, D

# One statement of every family of Spark's grammar that isn't a query.
COMMANDS = [
    "CREATE DATABASE d", "ALTER DATABASE d SET LOCATION '/x'", "CREATE TABLE t (a INT) USING parquet", "CREATE TABLE t LIKE stations", "REPLACE TABLE t (a INT) USING parquet",
    "ALTER TABLE stations ADD COLUMN z INT", "ALTER TABLE stations RENAME TO other", "ALTER VIEW city_daily AS SELECT 1", "DROP TABLE IF EXISTS stations", "TRUNCATE TABLE stations",
    "CREATE TEMPORARY VIEW v USING csv OPTIONS (path '/x')", "CREATE FUNCTION f AS 'some.Class'", "CREATE TEMPORARY FUNCTION f(x INT) RETURNS INT RETURN x", "DROP FUNCTION f",
    "INSERT OVERWRITE DIRECTORY '/x' USING csv SELECT 1", "INSERT INTO stations TABLE stations", "LOAD DATA INPATH '/x' INTO TABLE stations", "MSCK REPAIR TABLE stations", "REFRESH TABLE stations",
    "REFRESH '/x'", "UNCACHE TABLE stations", "CLEAR CACHE", "ADD FILE '/x'", "LIST JARS", "SET spark.sql.ansi.enabled", "SET TIME ZONE 'UTC'", "DECLARE VARIABLE v INT DEFAULT 1", "SET VAR v = 2",
    "SHOW TABLES", "SHOW FUNCTIONS", "DESCRIBE FUNCTION abs", "DESCRIBE QUERY SELECT 1", "EXPLAIN EXTENDED SELECT 1", "COMMENT ON TABLE stations IS 'x'", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END",
    "FROM stations INSERT INTO a SELECT 1 INSERT INTO b SELECT 2", "SELECT 1 INTO x", "SELECT 1; SELECT 2", "", ";", "SELECT",
]
# Every way to read what isn't on the list, and every way to name a function.
BAD = COMMANDS + [
    "TABLE pg_tables", "SELECT 1 FROM global_temp.stations", "SELECT 1 FROM spark_catalog.default.stations", "SELECT 1 FROM orc.`/x`", "SELECT 1 FROM `binaryFile`.`/x`", "SELECT 1 FROM IDENTIFIER('stat' || 'ions')",
    "SELECT 1 FROM range(9)", "SELECT 1 FROM explode(array(1))", "SELECT 1 FROM TABLE(SELECT 1)", "SELECT TRANSFORM (city) USING 'cat' FROM stations", "SELECT /*+ BROADCAST(s) */ 1 FROM stations s",
    "WITH inner_only AS (SELECT 1 a) SELECT (WITH x AS (SELECT 2 b) SELECT max(b) FROM x) FROM x", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT 1 WHERE 1 IN (SELECT 1 FROM avro.`/x`)",
    "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x))", "SELECT max(1) FILTER (WHERE java_method('java.lang.Math', 'abs', 1) = 1) FROM stations",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.dir')", "SELECT IDENTIFIER('ab' || 's')(1)", "SELECT builtin.abs(1)", "SELECT system.builtin.reflect('a', 'b')", "SELECT abs(expr => 1)",
    "SELECT try_reflect('java.lang.Math', 'abs', 1)", "SELECT * FROM stations LATERAL VIEW stack(2, 1, 2) t AS a", "SELECT * FROM stations LATERAL VIEW json_tuple('{}', 'a') t AS a", "SELECT * FROM stations LATERAL VIEW OUTER inline(array(struct(1))) t AS a",
    "SELECT * FROM stations PIVOT (reflect('a', 'b') FOR city IN ('x'))", "SELECT * FROM aqi_categories UNPIVOT (v FOR k IN (aqi_min, aqi_max))", "SELECT ?", "SELECT :named", "SELECT input_file_block_start()", "SELECT spark_partition_id()", "SELECT current_catalog()",
    "SELECT version()", "SELECT secret FROM stations", "SELECT city FROM stations LIMIT length('abc')", "SELECT city FROM stations LIMIT (SELECT 3)", "SELECT * FROM stations |> WHERE true |> AGGREGATE reflect('a', 'b')",
]
GOOD = [
    "SELECT max(aqi) AS worst, min(date) AS first FROM city_aqi_daily WHERE prominent_pollutant LIKE 'PM%'",
    "SELECT aqi_category, count(*) AS n FROM city_aqi_daily GROUP BY aqi_category HAVING count(*) > 1",
    "WITH late AS (SELECT * FROM city_aqi_daily WHERE date > DATE '2024-11-06') SELECT city, avg(aqi) FROM late GROUP BY ALL",
    "SELECT t.date, c.severity_rank FROM city_aqi_daily t LEFT JOIN aqi_categories c ON t.aqi BETWEEN c.aqi_min AND c.aqi_max ORDER BY 1",
    "SELECT trunc(date, 'month') AS m, round(stddev(aqi), 1) AS sd FROM city_aqi_daily GROUP BY 1",
    "SELECT date, aqi - lag(aqi) OVER (PARTITION BY city ORDER BY date) AS step FROM city_aqi_daily",
    "SELECT if(aqi IS NULL, 'none', CASE WHEN aqi > 400 THEN 'high' ELSE 'low' END) AS label FROM city_aqi_daily",
    "SELECT DISTINCT date_format(date, 'yyyy') AS y FROM city_aqi_daily WHERE month(date) IN (10, 11)",
    "SELECT city FROM city_aqi_daily UNION ALL SELECT aqi_category FROM aqi_categories",
    "SELECT c, x FROM (SELECT city AS c, collect_list(aqi) AS xs FROM city_aqi_daily GROUP BY city) LATERAL VIEW explode(filter(xs, v -> v > 100)) t AS x",
    "SELECT * FROM (SELECT aqi_category, aqi FROM city_aqi_daily) PIVOT (max(aqi) FOR aqi_category IN ('Severe', 'Poor'))",
    "SELECT extract(YEAR FROM date) AS y, trim(BOTH ' ' FROM city) AS c, city || '!' AS e, -aqi % 7 AS r, aqi BETWEEN 1 AND 9 AS b FROM city_aqi_daily WHERE city LIKE 'K%' AND NOT aqi <=> NULL",
    "SELECT city, count(*) FILTER (WHERE aqi > 100) AS n FROM city_aqi_daily GROUP BY GROUPING SETS ((city), ())",
    "SELECT city, sum(aqi) OVER w AS s FROM city_aqi_daily WINDOW w AS (PARTITION BY city ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "SELECT date FROM city_aqi_daily a WHERE aqi_category IN (SELECT aqi_category FROM aqi_categories WHERE severity_rank > 5)",
]


@pytest.fixture(scope="module")
def views(spark):
    rows = [("Kanpur", D(2024, 11, d), 150 + 30 * d, "Severe" if d > 8 else "Poor", "PM2.5", 3, 4) for d in range(1, 11) if d != 5]
    cats = [("Poor", 4, 201, 300), ("Severe", 6, 401, 500)]
    return {"city_aqi_daily": spark.createDataFrame(rows, TABLE), "aqi_categories": spark.createDataFrame(cats, "aqi_category string, severity_rank int, aqi_min int, aqi_max int")}


@pytest.mark.parametrize("sql", BAD)
def test_rejected(spark, views, sql):
    with pytest.raises(guard.Rejected):
        guard.guarded(spark, sql, views)


def test_no_function_outside_the_list_by_any_name(spark):
    names = [r.function for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect() if r.function.isidentifier() and r.function != "not"]  # an operator
    assert len(names) > 400
    for n in names:
        known = n.lower() in guard.FUNCTIONS
        tries = [f"SELECT IDENTIFIER('{n}')(1)", f"SELECT builtin.{n}(1)", f"SELECT {n}(arg => 1)"]
        tries += [] if n.lower() in guard.GENERATORS else [f"SELECT 1 FROM stations LATERAL VIEW {n}(1) t AS a"]
        tries += [] if known else [f"SELECT {n}(1)", f"SELECT 1 FROM stations PIVOT ({n}(1) FOR city IN ('x'))", f"SELECT sum({n}(1)) OVER () FROM stations", f"SELECT 1 ORDER BY {n}()"]
        for sql in tries:
            with pytest.raises(guard.Rejected):
                guard.check(spark, sql)


def test_questions_at_once_never_share_a_name(spark):
    one, two = ({"stations": spark.createDataFrame([(x,)], "city string")} for x in "ab")
    a, b = (guard.guarded(spark, "SELECT city FROM stations", v) for v in (one, two))
    assert a.first().city == "a" and b.first().city == "b" and not spark.catalog.tableExists("stations")


@pytest.mark.parametrize("sql", GOOD)
def test_accepted_and_bounded(spark, views, sql):
    assert guard.check(spark, sql) == 1000
    assert guard.guarded(spark, sql, views).collect()


def test_limits_and_messages(spark, views):
    assert guard.check(spark, "SELECT aqi FROM city_aqi_daily LIMIT 12") == 12
    assert guard.check(spark, "SELECT aqi FROM city_aqi_daily LIMIT 7000") == 1000
    with pytest.raises(guard.Rejected, match="people.*not allowed"):
        guard.check(spark, "SELECT * FROM people")
    with pytest.raises(guard.Rejected, match="nope"):
        guard.guarded(spark, "SELECT nope FROM city_aqi_daily", views)


def test_execute_caps_and_times_out(spark, views):
    r = execute.execute(spark, "SELECT city, aqi FROM city_aqi_daily ORDER BY aqi", views, 60, most=3)
    assert len(r.rows) == 3 and r.truncated and "| Kanpur | 180 |" in r.markdown()
    assert not execute.execute(spark, "SELECT NULL AS x", views, 60).truncated
    slow = "SELECT count(*) FROM (SELECT explode(sequence(1, 3000000)) AS a) x JOIN (SELECT explode(sequence(1, 200000)) AS b) y ON a % 7919 <> b"
    with pytest.raises(TimeoutError):
        execute.execute(spark, slow, views, 2)


def test_repair_loop(spark, views):
    cfg = config.Pipeline("t")
    asked = []

    def planner(q, error, context):
        asked.append(error)
        return "SELECT nope FROM city_aqi_daily" if not error else "SELECT count(*) AS n FROM city_aqi_daily WHERE date >= DATE '2024-11-01' AND date <= CAST('2024-11-10' AS DATE)"

    out = answer.answer_data(spark, "q", views, planner, cfg, ["Kanpur"])
    assert out.attempts == 2 and out.result.rows == [(9,)] and "nope" in asked[1]
    assert (out.coverage[0]["days_reported"], out.coverage[0]["days_in_range"], out.low_coverage) == (9, 10, False)
    assert answer.answer_data(spark, "q", views, lambda q, e, c: "SELECT 1; SELECT 2", cfg).attempts == 3
    assert answer.answer_data(spark, "q", views, lambda q, e, c: "-- no", cfg).unanswerable
    assert answer.sql_period("SELECT 1") is None


def test_answers(spark, views):
    chunk = {"chunk_id": "c1", "text": "First. Second.", "title": "A <b>", "page_start": 1, "page_end": 2}
    assert answer.synthesise("q", [], None, "policy").not_found
    a = answer.synthesise("q", [chunk], None, "policy", lambda q, c, d: ("x", ["[c1]", "c9"]))
    assert a.citations == ["c1"] and a.dropped == 1
    assert 'title="A &lt;b&gt;"' in answer.prompt("q", [chunk])
    cfg = config.Pipeline("t")
    calls = []
    bot = answer.Assistant(spark, cfg, lambda q: calls.append(q) or [chunk], views, lambda q, e, c: "SELECT max(aqi) AS worst FROM city_aqi_daily")
    assert bot.answer("Which air purifier should I buy?").route == "out_of_scope" and not calls
    mixed = bot.answer("What was the highest AQI in Kanpur, and what does Stage IV require?")
    assert mixed.route == "mixed" and set(mixed.citations) == {"c1", "SQL"} and "worst = 450" in mixed.text
    broken = answer.Assistant(spark, cfg, lambda q: [chunk], views, lambda q, e, c: 1 / 0)
    assert broken.answer("What was the highest AQI in Kanpur, and what does Stage IV require?").citations == ["c1"]
    with pytest.raises(ZeroDivisionError):
        answer.Assistant(spark, cfg, lambda q: 1 / 0, views, lambda q, e, c: "").answer("What does Stage III of GRAP require?")


def test_examples(spark):
    q = spark.createDataFrame([(1, "On which weekday is the index of Temokot lowest?"), (2, "")], "query_id int, question string")
    ex = spark.createDataFrame(list(enumerate(e for e, _ in answer.EXAMPLES)), "no long, example string")
    got = answer.pick_examples(q, ex).orderBy("query_id", "rank").collect()
    assert got[0].no == 2 and [r.no for r in got if r.query_id == 2] == [0, 1, 2, 3]
