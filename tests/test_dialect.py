"""Statements of the dialect, answered by the engine and by DuckDB over the same small tables."""

import duckdb
import pytest

from marlstone.engine import Engine
from marlstone.errors import NotAllowed, Overflow, ParseError, PlanError
from marlstone.functions.duck import inlined
from marlstone.plans.parser import parse

from .test_queries import plain

EV = [(1, "a", 10, "x-1"), (2, "b", None, "y-2"), (3, "A", 7, "z"), (4, None, 3, "0x1f"), (5, "b", 7, "12")]
PAY = [("0xa", "0xb", 1, 0, "10", "2024-01-05 10:00:00"), ("0xb", "0xc", 2, 0, "4", "2024-02-05 11:30:00"), ("0xb", "0xa", 2, 1, "250000000000000000000", "2024-02-05 11:30:01"), ("0xA", "0xc", 150, 2, "010", "2024-12-31 23:59:59"), ("0xc", "0xd", 301, 0, "7", "2025-01-01 00:00:00")]

ALIKE = r"""
SELECT list(n ORDER BY id DESC) AS l, string_agg(who, '-' ORDER BY id DESC) AS s, first(who ORDER BY n DESC, id) AS f, last(who ORDER BY id) AS z FROM ev
SELECT who, list(id ORDER BY n NULLS FIRST, id) AS l FROM ev GROUP BY who
SELECT list(who) AS l, count(DISTINCT who) AS c, list(DISTINCT n ORDER BY n DESC) AS d FROM ev WHERE id < 4
SELECT '{"a": {"b": [1, 2]}}'->'a'->'b'->1 AS x, '{"a": "q"}'->>'a' AS y, '{"a": "q"}'->'a' AS z
SELECT json_type('{"a": [1]}', '$.a') AS a, json_type('12345678901') AS b, json_type('"s"') AS c, json_type('null') AS d
SELECT json_extract('{"a": [1, 2, 3]}', '$.a[#-1]') AS a, json_extract('{"a":{"z":1,"b":2}}', '$.a') AS o
SELECT strftime(ts, '%Y-%m-%d') AS d, date_diff('day', ts, TIMESTAMP '2024-12-31 00:00:00') AS n, extract(epoch FROM ts) AS e, extract(isodow FROM ts) AS i FROM pay
SELECT unnest([id, n]) AS u FROM ev WHERE id < 3
SELECT * FROM generate_series(1, 3) t(x)
SELECT * FROM generate_series(5, 1, -2)
SELECT * FROM range(3)
SELECT len([1, 2, 3]) AS a, contains([1, 2], 2) AS b, len('abc') AS c, contains('abc', 'b') AS d
SELECT sum(TRY_CAST(val AS HUGEINT)) AS s FROM pay
SELECT n % 0 AS z, id / 2 AS h, id // 2 AS d FROM ev
SELECT * REPLACE (id * 2 AS id) FROM ev WHERE id < 3
SELECT * EXCLUDE (who) REPLACE (n + 1 AS n) FROM ev WHERE id = 1
SELECT id FROM ev ORDER BY id LIMIT 2.5
SELECT TRUE = 1 AS a, (id > 2) = 0 AS b FROM ev
SELECT try(CAST(t AS INTEGER)) AS a FROM ev
SELECT regexp_extract(t, '[a-z]-([0-9])') AS a, regexp_replace('aa', 'a', 'b') AS r, regexp_replace('aa', 'a', 'b', 'g') AS g FROM ev
SELECT xor(id, 3) AS x, from_hex('4142') AS h FROM ev WHERE id = 1
SELECT quantile_cont(n, 0.5) AS q, median(n) AS m, quantile_disc(n, 0.5) AS d, mode(n) AS o FROM ev
SELECT format('{} is {:.2f}', who, n / 3) AS f FROM ev WHERE id = 1
SELECT CAST(2.7::DOUBLE AS BIGINT) AS a, CAST(2.5::DOUBLE AS INT) AS b, CAST(3.5::DOUBLE AS INT) AS c, CAST(2.5 AS INT) AS d, CAST('2.5' AS INT) AS e, (-2.5)::INT AS f
SELECT n FROM ev ORDER BY ALL
SELECT list_reverse_sort([3, NULL, 1]) AS l
SELECT sha256('a') AS s, md5('a') AS m
WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 2) % 7 FROM r) SELECT k FROM r
WITH RECURSIVE r(k) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT k + 1 FROM r WHERE k < 4) SELECT sum(k) AS s FROM r
SELECT id, n FROM ev UNION ALL BY NAME SELECT blk AS id, val AS extra FROM pay
SELECT id, last_value(who IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS l FROM ev
SELECT count(*) FILTER (WHERE n > 5) OVER () AS c FROM ev
SELECT count(*), max(n), id % 2 FROM ev GROUP BY ALL
SELECT upper(who) AS u, count(*) AS n FROM ev GROUP BY u HAVING n >= 1 ORDER BY u
SELECT id AS n FROM ev WHERE n > 5
SELECT id * 2 AS twice FROM ev WHERE twice > 4
SELECT DISTINCT ON (who) who, id FROM ev ORDER BY who, id DESC
SELECT who, id FROM ev QUALIFY rank() OVER (PARTITION BY lower(who) ORDER BY id) = 1
SELECT id, row_number() OVER (ORDER BY id DESC) AS rn FROM ev QUALIFY rn <= 2
SELECT src, blk FROM pay QUALIFY blk = max(blk) OVER (PARTITION BY src)
SELECT e.id, p.blk FROM ev e JOIN pay p ON e.id >= p.ix AND e.id <= p.blk
SELECT e.id, p.blk FROM pay p LEFT JOIN ev e ON e.id BETWEEN p.ix AND p.blk
SELECT e.id, p.blk FROM ev e LEFT JOIN pay p ON e.id > p.ix AND e.id < p.blk
SELECT p.src, (SELECT e.who FROM ev e WHERE e.id <= p.blk ORDER BY e.id DESC LIMIT 1) AS w FROM pay p
SELECT p.src, x.id FROM pay p, LATERAL (SELECT id FROM ev WHERE id > p.ix ORDER BY id LIMIT 2) x
SELECT (SELECT count(*) FROM ev e WHERE e.id < p.blk) AS c FROM pay p
SELECT src IN (SELECT dst FROM pay) AS i, src NOT IN (SELECT who FROM ev) AS n FROM pay
SELECT substr(t, -2) AS a, substr(t, 0, 2) AS b, t[1:2] AS c, t[-1] AS d FROM ev
SELECT list_reduce([1, 2, 3], lambda a, x: a * 10 + x) AS r
SELECT struct_pack(a := 1, b := 'x').b AS b, row(1, 2) AS r
SELECT MAP {'a': 1, 'b': 2}['b'] AS m, map_keys(MAP {'a': 1}) AS k
SELECT split_part(t, '-', 1) AS a, split_part(t, '-', -1) AS b, split_part(t, '-', 0) AS z FROM ev
SELECT 'ab' LIKE 'a\b' AS a, 'a\b' LIKE 'a\b' AS b, 'a_b' LIKE 'a!_b' ESCAPE '!' AS c, who ILIKE 'A%' AS d FROM ev
SELECT 5 IN (1, 5, NULL) AS a, NULL IS DISTINCT FROM 1 AS b, (1, 2) < (1, 3) AS c
SELECT CAST(ts AS DATE) + 3 AS d, CAST(ts AS DATE) + INTERVAL 33 HOUR AS h, ts::DATE - DATE '2024-01-01' AS n FROM pay
SELECT date_trunc('month', ts) AS m, date_trunc('day', CAST(ts AS DATE)) AS d, CAST(ts AS VARCHAR) AS t FROM pay
SELECT round(2.345, 2) AS a, round(id / 3, 1) AS b, floor(2.7::DOUBLE) AS c, sign(-3) AS d, trunc(-2.7::DOUBLE) AS e FROM ev
SELECT 1 << 4 AS a, 255 >> 2 AS b, 6 & 3 AS c, 6 | 3 AS d, 2 ^ 3 AS e, 2 ** 3 AS f
SELECT printf('%5.1f|%d|%s|%05d', 1.25::DOUBLE, 42, 'x', 7) AS p
SELECT typeof(id) AS a, typeof(who) AS b, typeof(ts) AS c, typeof([1.5]) AS d FROM ev, pay LIMIT 1
SELECT bool_and(n > 2) AS a, bool_or(n > 9) AS b, bit_xor(id) AS c FROM ev
SELECT if(id > 2, 'big', 'small') AS a, coalesce(who, '?') AS b, ifnull(n, 0) AS c, nullif(id, 2) AS d, greatest(id, n) AS e FROM ev
SELECT id, CASE who WHEN 'a' THEN 1 WHEN 'b' THEN 2 END AS c FROM ev
FROM ev SELECT id WHERE who ^@ 'a'
SELECT who FROM ev EXCEPT SELECT src FROM pay
(SELECT id FROM ev) INTERSECT (SELECT blk FROM pay) ORDER BY 1
SELECT * FROM (VALUES (1, 'x'), (2, NULL)) v(a, b) ORDER BY a
WITH t AS MATERIALIZED (SELECT id, who FROM ev), u(k) AS (SELECT id FROM t) SELECT count(*) AS c FROM u JOIN t ON u.k = t.id
SELECT sum(n) FILTER (WHERE id > 1) AS s, count(DISTINCT (id % 2, who)) AS d FROM ev
SELECT who, sum(n) AS s FROM ev GROUP BY ROLLUP (who)
SELECT grouping(who) AS g, count(*) AS c FROM ev GROUP BY CUBE (who)
SELECT regexp_matches('abc', 'B', 'i') AS a, regexp_full_match('abc', 'a.c') AS b, 'abc' ~ 'a.*' AS c, regexp_extract_all('a1b2', '[0-9]') AS d
SELECT hex(255) AS a, hex('ab') AS b, hex(CAST(-1 AS HUGEINT)) AS c, chr(65) AS d, ascii('A') AS e
SELECT lag(n, 1, 0) OVER (ORDER BY id) AS a, ntile(2) OVER (ORDER BY id) AS b, cume_dist() OVER (ORDER BY id) AS c, nth_value(id, 2) OVER (ORDER BY id) AS d FROM ev
SELECT sum(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, avg(n) OVER (PARTITION BY id % 2) AS a FROM ev
SELECT id FROM ev WHERE id - 3 > -1 AND 10 - id >= 6
SELECT TRY_CAST(val AS BIGINT) AS k, count(*) AS n FROM pay GROUP BY 1
SELECT sum(val::HUGEINT)::VARCHAR AS s FROM pay
SELECT "src" AS "Who", count(*) AS "n x" FROM pay GROUP BY "src"
SELECT a.id FROM ev a ANTI JOIN pay p ON a.id = p.blk
SELECT id FROM ev JOIN (SELECT blk AS id, dst FROM pay) USING (id)
SELECT count(*) AS n FROM (SELECT * FROM ev x JOIN ev y ON x.id = y.n)
SELECT from_json('{"a": 1, "b": "x"}', '{"a": "INTEGER", "b": "VARCHAR"}').b AS b
SELECT to_json({'a': 1, 'b': NULL, 'c': [1, 2]})::VARCHAR AS j, to_json('x')::VARCHAR AS s, to_json(1.5::DOUBLE)::VARCHAR AS d
SELECT date_part('doy', ts) AS a, dayofweek(ts) AS b, isodow(ts) AS c, week(ts) AS d, quarter(ts) AS q FROM pay
SELECT count(n) AS a, stddev_samp(n) AS b, corr(id, n) AS c FROM ev
SELECT id FROM ev OFFSET 3
SELECT max(CASE WHEN id > 2 THEN t END) AS a, min(t) FILTER (WHERE id > 100) AS b FROM ev
SELECT least(id, 2) AS a, power(2, id) AS p, log(100) AS l, ln(1) AS z, pi() AS pi FROM ev
SELECT row_number() OVER w AS r, sum(n) OVER w AS s FROM ev WINDOW w AS (PARTITION BY id % 2 ORDER BY id)
SELECT trim('  x '), ltrim('xxa', 'x'), lpad('a', 3, '*'), repeat('ab', 2), reverse('abc'), left('abc', 2), right('abc', -1)
SELECT x, x IN (SELECT n FROM ev) AS a FROM range(8) t(x)
SELECT s.id FROM (SELECT id, who FROM ev) s(id, w) WHERE w = 'a'
SELECT array_length(list(id)) AS n, list(id ORDER BY id)[2] AS f FROM ev
SELECT interval '1 day' > interval '2 hours' AS a
SELECT t.id, t.who FROM ev t WHERE EXISTS (SELECT 1 FROM pay p WHERE p.blk = t.id AND p.ix < t.n)
SELECT string_split('a,b', ',')[1] AS a, string_split('ab', '') AS b, concat_ws('-', 'a', NULL, 'b') AS c, concat('a', NULL, 'b') AS d
SELECT id::DOUBLE / 0 AS a, -1 / 0 AS b, 0 / 0 AS c FROM ev WHERE id = 1
""".strip().splitlines()


@pytest.fixture(scope="module")
def both(spark):
    con, engine = duckdb.connect(), Engine(spark)
    con.execute("SET error_on_division_by_zero = false")
    con.execute("CREATE TABLE ev (id BIGINT, who VARCHAR, n BIGINT, t VARCHAR)")
    con.executemany("INSERT INTO ev VALUES (?, ?, ?, ?)", EV)
    con.execute("CREATE TABLE pay (src VARCHAR, dst VARCHAR, blk BIGINT, ix BIGINT, val VARCHAR, ts TIMESTAMP)")
    con.executemany("INSERT INTO pay VALUES (?, ?, ?, ?, ?, ?::TIMESTAMP)", PAY)
    engine.register("ev", spark.createDataFrame(EV, "id bigint, who string, n bigint, t string"))
    engine.register("pay", spark.createDataFrame(PAY, "src string, dst string, blk bigint, ix bigint, val string, ts string").selectExpr("src", "dst", "blk", "ix", "val", "cast(ts as timestamp_ntz) ts"))
    return con, engine


@pytest.mark.parametrize("text", ALIKE)
def test_alike(both, text):
    con, engine = both
    con.execute(text)
    names = [d[0].lower() for d in con.description]
    want = sorted(repr(tuple(map(plain, r))) for r in con.fetchall())
    df = engine.sql(text)
    assert [c.lower() for c in df.columns] == names
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == want


@pytest.mark.parametrize(("text", "rows"), [
    ("SELECT list_transform([1, 2], x -> x + 1) AS m", [([2, 3],)]),  # the older spelling of a function
    ("SELECT n % 0 AS z, id // 0 AS d FROM ev WHERE id = 1", [(None, None)]),
    ("SELECT sum(TRY_CAST(t AS BIGINT)) AS s FROM ev", [(43,)]),
    ("SELECT sum(id * 3000000000000000000) AS s FROM ev WHERE id = 3", [(9 * 10**18,)]),
    ("SELECT {'a': id, 'b': who} AS s FROM ev WHERE id = 1", [((1, "a"),)]),
    ("SELECT TRY(error('x')) AS a, TRY(json_extract('nope', '$.a')) AS b, TRY(1 // 0) AS c", [(None, None, None)]),
])
def test_answers(both, text, rows):
    assert [tuple(r) for r in both[1].sql(text).collect()] == rows


@pytest.mark.parametrize(("text", "kind"), [
    ("SELECT min(TRY_CAST(val AS BIGINT)) AS s FROM pay", PlanError), ("SELECT json_extract('nope', '$.a') AS a", PlanError), ("SELECT list_reduce(list_filter([1], lambda x: x > 1), lambda a, x: a) AS r", PlanError), ("SELECT error('stop') AS e", PlanError),
    ("SELECT DISTINCT who FROM ev ORDER BY n", PlanError), ("WITH x(a, a) AS (SELECT 1, 2) SELECT * FROM x", PlanError), ("SELECT * FROM unnest([1, 2]) t(x)", PlanError), ("SELECT * FROM range(DATE '2024-01-01', DATE '2024-01-03') t(d)", PlanError), ("SELECT * FROM (SELECT 3 AS n) s, range(s.n) t(x)", PlanError),
    ("SELECT CAST(struct_pack(a := 1) AS VARCHAR) AS a", PlanError), ("SELECT 'abc' GLOB 'a*' AS a", PlanError), ("SELECT reflect('java.lang.System', 'exit') AS a", NotAllowed), ("SELECT COLUMNS('a') FROM ev", NotAllowed), ("SELECT current_user() AS u", NotAllowed), ("SELECT * FROM read_csv('x')", NotAllowed),
    ("SELECT id, FROM", ParseError), ("SELECT (1", ParseError), ("SELECT 1 +", ParseError), ("SELECT id * 9223372036854775807 AS x FROM ev", Overflow), ("SELECT CAST(id * 100 AS TINYINT) AS x FROM ev", Overflow), ("SELECT 1 << 63 AS a", Overflow), ("SELECT strftime(ts, '%Q') AS a FROM pay", PlanError), ("SELECT CAST('x' AS BIGINT) AS a", PlanError),
])
def test_refusals(both, text, kind):
    engine = both[1]
    with pytest.raises(kind):
        engine.answer(text)


def test_ranges_join_by_block(both, spark):
    """A join by two bounds is planned as an equality join, and gives each pair once, whatever the lengths."""
    engine = Engine(spark)
    engine.register("pts", spark.sql("SELECT id * 37 % 1000 AS at, id FROM range(300)"))
    engine.register("spans", spark.sql("SELECT id, id * 13 % 900 AS lo, id * 13 % 900 + CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 700 ELSE id % 50 END AS hi FROM range(200) UNION ALL SELECT 900, 50, 20 UNION ALL SELECT 901, NULL, 5 UNION ALL SELECT 902, 5000, 6000"))
    for kind, low, high in (("JOIN", ">=", "<="), ("RIGHT JOIN", ">", "<"), ("LEFT JOIN", ">=", "<")):
        text = f"SELECT p.id AS p, s.id AS s FROM pts p {kind} spans s ON p.at {low} s.lo AND p.at {high} s.hi"
        df = engine.sql(text)
        want = spark.sql(text.replace("FROM pts", "FROM pts"))
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) and df.count() > 100
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if kind != "LEFT JOIN":  # points without a range must stay there
            assert "_w" in plan and "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_points_without_a_range_stay_by_block(both, spark):
    """An outer join by two bounds that keeps its points is no nested loop either; points that repeat, have null or lie outside stay, each as often as it should."""
    engine = Engine(spark)
    pts = spark.sql("SELECT IF(id % 50 = 7, NULL, id * 37 % 1000) AS at, id % 290 AS id FROM range(300) UNION ALL SELECT 37, 1 UNION ALL SELECT -5, 400 UNION ALL SELECT 9000000000, 401")
    spans = spark.sql("SELECT id, id * 13 % 900 AS lo, id * 13 % 900 + CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 700 ELSE id % 50 END AS hi FROM range(0, 200, 9) UNION ALL SELECT 900, 50, 20 UNION ALL SELECT 901, NULL, 5 UNION ALL SELECT 902, -9, -5 UNION ALL SELECT 903, -9, -5")
    engine.register("pts", pts)
    for name, held in (("spans", spans), ("none", spans.where("false"))):
        engine.register(name, held)
        for low, high in ((">=", "<="), (">", "<"), (">=", "<")):
            for joined in (f"pts p LEFT JOIN {name} s", f"{name} s RIGHT JOIN pts p"):
                text = f"SELECT p.id AS p, p.at, s.id AS s FROM {joined} ON p.at {low} s.lo AND p.at {high} s.hi"
                df = engine.sql(text)
                want = spark.sql(text)
                assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) and df.where("s IS NULL").count() >= 8
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # Rows that may differ each time they are read are read once, as Spark joins them.
    for side in ("(SELECT at + random() * 0 AS at FROM pts)", "(SELECT at FROM pts LIMIT 5)"):
        assert "`_w`" not in engine.sql(f"EXPLAIN SELECT p.at FROM {side} p LEFT JOIN spans s ON p.at >= s.lo AND p.at <= s.hi").first()[0]
        assert "_hits" not in engine.sql(f"EXPLAIN SELECT p.at FROM {side} p LEFT JOIN spans s ON p.at >= s.lo AND p.at <= s.hi").first()[0]


def test_latest_rows_are_carried(both, spark):
    engine, con = Engine(spark), duckdb.connect()
    rows = [(i, i % 5 if i % 11 else None, (i * 37) % 50 if i % 13 else None, i % 3) for i in range(200)]
    con.execute("CREATE TABLE ev (id BIGINT, k BIGINT, t BIGINT, kind BIGINT)")
    con.executemany("INSERT INTO ev VALUES (?, ?, ?, ?)", rows)
    engine.register("ev", spark.createDataFrame(rows, "id bigint, k bigint, t bigint, kind bigint"))
    for op, way in (("<=", "DESC"), ("<", "DESC"), (">=", "ASC"), (">", "ASC")):
        text = f"SELECT e.id, (SELECT p.t * 2 FROM ev p WHERE p.kind = 1 AND p.k = e.k AND p.t {op} e.t ORDER BY p.t {way} LIMIT 1) AS v FROM ev e WHERE e.kind <> 1"
        df = engine.sql(text)
        con.execute(text)
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.fetchall()))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" in plan


def test_top_per_group_is_cut_before_the_shuffle(both):
    for text in ("SELECT src, blk FROM pay QUALIFY row_number() OVER (PARTITION BY src ORDER BY blk DESC) = 1", "SELECT src, blk FROM pay QUALIFY blk = min(blk) OVER (PARTITION BY src)"):
        assert "WindowGroupLimit" in both[1].sql(text)._jdf.queryExecution().executedPlan().toString()


def test_constants_move_to_the_scan(spark, sf_dir):
    engine = Engine(spark)
    engine.register("events", spark.read.parquet(f"{sf_dir}/events.parquet"))
    plan = engine.sql("SELECT event_id FROM events WHERE event_id - 95 > 0")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,95)" in plan


def test_calls_are_put_in_place_within_functions():
    assert "duck_mod(" not in inlined("duck_mod(x, 2) + duck_div(duck_mod(x, 3), 2)")
    assert inlined("length('duck_mod(1, 2)')") == "length('duck_mod(1, 2)')"


def test_a_tree_reads_what_it_should():
    assert parse("SELECT 1 + 2 * 3 AS x").body.items[0].x.op == "+"
    assert parse("SELECT NOT a = b OR c AS x").body.items[0].x.op == "OR"
    assert parse("FROM t").body.items[0].x.table is None
