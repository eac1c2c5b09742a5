import json
import threading
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.engine import Budget, CancelToken, Engine, Gate, Limits
from marlstone.errors import Cancelled, LimitExceeded, NoSegments, NotAllowed, Overflow, ParseError, PlanError, SeamError, Timeout
from marlstone.functions.duck import strftime
from marlstone.operators.aggregates import exact_double_sum, guarded, signed_fold, sum_of_text
from marlstone.operators.joins import latest_row, not_in, range_join
from marlstone.operators.recursion import fixpoint
from marlstone.plans.dialect import spark_sql
from marlstone.plans.inspect import base_tables, canonical, parquet_scans, plan_metrics, reach, refs
from marlstone.sources.facts import facts, text_rows, union_segments, widened
from marlstone.sources.tables import HostTables, arrow_ipc, describe, for_each_batch, json_rows
from marlstone.streaming.seam import MemoryTip, seam


@pytest.fixture
def engine(spark):
    made = Engine(spark)
    made.register("ev", spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "A", 7), (4, None, 3)], "id bigint, who string, n bigint"))
    return made


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("text", "want"), [
    ("FROM ev SELECT id WHERE n > 5", [(1,), (3,)]),
    ("SELECT * EXCLUDE (n, who) FROM ev", [(1,), (2,), (3,), (4,)]),
    ("SELECT id FROM ev WHERE who ^@ 'a'", [(1,)]),
    ("SELECT id // 2 AS h FROM ev", [(0,), (1,), (1,), (2,)]),
    ("SELECT id // 0 AS h FROM ev WHERE id = 1", [(None,)]),
    ("SELECT id FROM ev QUALIFY row_number() OVER (PARTITION BY lower(who) ORDER BY n DESC) = 1", [(1,), (2,), (4,)]),
    ("SELECT DISTINCT ON (lower(who)) id, n FROM ev ORDER BY lower(who), n", [(2, None), (3, 7), (4, 3)]),
    ("SELECT id FROM (SELECT id, n FROM ev ORDER BY n LIMIT 3) t", [(1,), (3,), (4,)]),
    ("SELECT id FROM (SELECT id, n FROM ev ORDER BY n DESC LIMIT 1) t", [(1,)]),
    ("WITH t AS MATERIALIZED (SELECT id FROM ev) SELECT count(*) AS c FROM t", [(4,)]),
    ("SELECT [x * 2 FOR x IN [id, 5] IF x > 2] AS l FROM ev WHERE id < 4", [([10],), ([10],), ([6, 10],)]),
    ("SELECT list_transform([id, 1], lambda x: x + 1) AS l FROM ev WHERE id = 1", [([2, 2],)]),
    ("SELECT list_reduce([id, 2, 3], lambda a, x: a * 2 + x) AS r FROM ev WHERE id = 1", [(11,)]),
    ("SELECT [7, 8, 9][2] AS a, [7, 8][-1] AS b, [7][5] AS c", [(8, 8, None)]),
    ("SELECT substring('hello', 0, 2) AS a, substr('hello', -3, 2) AS b, split_part('a-b', '-', 0) AS c", [("h", "ll", "")]),
    ("SELECT 'it''s \\' AS t", [("it's \\",)]),
    ('SELECT "id" FROM ev WHERE ID = 1', [(1,)]),
    ("SELECT id::VARCHAR AS t FROM ev WHERE id = 1", [("1",)]),
    ("SELECT who FROM ev WHERE who IN ('a', 'b') UNION ALL SELECT 'x' ORDER BY 1", [("a",), ("b",), ("x",)]),
    ("SELECT row_number() OVER (ORDER BY n) AS r, id FROM ev", [(1, 4), (2, 3), (3, 1), (4, 2)]),
])
def test_dialect(engine, text, want):
    assert rows(engine.sql(text)) == sorted(want, key=str)


@pytest.mark.parametrize(("text", "kind"), [
    ("DROP TABLE ev", NotAllowed), ("SELECT 1; SELECT 2", NotAllowed), ("SELECT * FROM 'x.parquet'", NotAllowed), ("SELECT * FROM parquet.`/etc`", NotAllowed), ("SELECT * FROM read_parquet('x')", NotAllowed),
    ("COPY ev TO 'x'", NotAllowed), ("SELECT * FROM nowhere", NotAllowed), ("SELECT strptime('a', 'b')", NotAllowed), ("SELECT approx_count_distinct(id) FROM ev", NotAllowed), ("SELECT java_method('a', 'b')", NotAllowed),
    ("SELECT * FROM ev PIVOT (count(*) FOR who IN ('a'))", PlanError), ("SELECT id FROM ev ORDER BY 'x'", PlanError), ("SELECT " + "(" * 70 + "1" + ")" * 70, PlanError), ("SELECT ( FROM ev", ParseError), ("", ParseError), ("INSERT INTO ev VALUES (1)", NotAllowed),
])
def test_refusals(engine, text, kind):
    with pytest.raises(kind):
        engine.sql(text)


def test_inspection(spark, engine):
    tables, functions = reach(spark, "WITH t AS (SELECT * FROM ev) SELECT lower(who) FROM t JOIN other o ON EXISTS (SELECT 1 FROM deep d WHERE d.x = o.x)")
    assert tables == {"ev", "other", "deep"} and "lower" in functions
    assert refs("SELECT * FROM ev a JOIN ev b USING (id) JOIN (WITH t AS (SELECT 1 AS id) SELECT * FROM t) USING (id)") == {"ev": 2}
    assert base_tables(spark, "WITH ev AS (SELECT * FROM ev) SELECT * FROM ev") == {"ev"}
    one, two = engine.sql("SELECT a.id FROM ev a WHERE a.n > 1"), engine.sql("select zz.id from ev as zz where zz.n > 1")
    assert canonical(one) == canonical(two) != canonical(engine.sql("SELECT id FROM ev WHERE n > 2"))


def test_scans_push_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_tax" not in plan and parquet_scans(df) == 1
    assert parquet_scans(df.unionAll(df)) == 2


def test_views_and_catalogue(engine):
    engine.view("v", "SELECT id, n FROM ev WHERE n IS NOT NULL")
    engine.view("w", "SELECT count(*) AS c FROM v")
    assert rows(engine.sql("SELECT c FROM w")) == [(3,)] and engine.has_table("W") and engine.tables() == ["ev", "v", "w"]
    with pytest.raises(PlanError):
        engine.view("ev", "SELECT 1 AS x")
    with pytest.raises(PlanError):
        engine.register("v", engine.sql("SELECT 1 AS x"))
    found = rows(engine.sql("SELECT table_name, table_type FROM information_schema.tables"))
    assert found == [("ev", "BASE TABLE"), ("v", "VIEW"), ("w", "VIEW")]
    assert ("ev", "who", "VARCHAR") in rows(engine.sql("SELECT table_name, column_name, data_type FROM information_schema.columns"))
    assert "Physical Plan" in engine.sql("EXPLAIN SELECT id FROM ev").first().plan


def test_limits_gate_and_overflow(engine):
    with pytest.raises(LimitExceeded):
        engine.answer("SELECT id FROM ev", Limits(max_rows=2))
    assert len(engine.answer("SELECT id FROM ev", Limits(max_rows=4, timeout_s=60))) == 4
    with pytest.raises(Overflow):
        engine.answer("SELECT id + 9223372036854775807 AS x FROM ev")
    gate, order = Gate(1), []

    def work(i):
        with gate.admitted():
            order.append(i)
            time.sleep(0.01)

    threads = []
    for i in range(6):
        threads.append(threading.Thread(target=work, args=(i,)))
        threads[-1].start()
        time.sleep(0.005)
    [t.join() for t in threads]
    assert order == sorted(order)


def test_bytes_cancel_and_metrics(engine, spark):
    engine.register("big", spark.range(200_000).selectExpr("id", "repeat('x', 100) AS t"))
    with pytest.raises(LimitExceeded, match="bytes"):
        engine.answer("SELECT id, t FROM big", Limits(max_rows=None, max_bytes=10_000))
    engine.register_scalar_function("slowly", lambda i: time.sleep(0.01) or i, "bigint")
    slow = "SELECT max(slowly(id)) AS n FROM big"
    with pytest.raises(Timeout):
        engine.answer(slow, Limits(timeout_s=1.0))
    token = CancelToken()
    threading.Timer(1.0, token.cancel).start()
    with pytest.raises(Cancelled):
        engine.answer(slow, token=token)
    with pytest.raises(Cancelled):
        engine.answer("SELECT 1 AS x", token=token)
    before = engine.metrics.rows
    assert len(engine.answer("SELECT id FROM ev")) == 4 and engine.metrics.rows == before + 4
    df = engine.sql("SELECT n, count(*) AS c FROM ev GROUP BY n")
    df.collect()
    assert plan_metrics(df)["peak_memory"] >= 0
    assert Limits.serving().timeout_s and Budget("1g", 2, "/tmp/x").conf()["spark.local.dir"] == "/tmp/x"
    names = engine.function_names()
    assert {"strftime", "list_reduce", "sum", "json_extract"} <= set(names) and not {"read_csv", "reflect"} & set(names)
    assert "information_schema.tables" in engine.visible_tables()


def test_scalar_functions(engine):
    engine.register_scalar_function("plus_len", lambda n, s: None if n is None or s is None else n + len(s), "bigint")
    assert rows(engine.sql("SELECT plus_len(n, who) AS x FROM ev")) == sorted([(11,), (None,), (8,), (None,)], key=str)
    with pytest.raises(NotAllowed):
        engine.sql("SELECT some_other(n) AS x FROM ev")


@pytest.mark.parametrize(("text", "kind", "said"), [
    ("SELECT nope FROM ev", PlanError, "Binder Error: Referenced column"), ("SELECT who, count(*) AS c FROM ev", PlanError, "must appear in the GROUP BY clause"), ("SELECT (SELECT id FROM ev) AS x", PlanError, "More than one row returned"),
    ("SELECT id * 9223372036854775807 AS x FROM ev", Overflow, "Out of Range Error"), ("SELECT CAST(who AS DATE) AS d FROM ev", PlanError, "Conversion Error: Could not convert string"),
])
def test_errors_in_duckdbs_words(engine, text, kind, said):
    with pytest.raises(kind, match=said):
        engine.answer(text)


def test_text_functions(engine):
    engine.register_text_function("glue", 2, lambda a, b: f"{a}+{b}")
    assert rows(engine.sql("SELECT glue(who, 'z') AS g FROM ev")) == [("A+z",), ("a+z",), ("b+z",), (None,)]

    def fails(_):
        raise ValueError("no")

    engine.register_text_function("fails", 1, fails)
    with pytest.raises(PlanError):
        engine.answer("SELECT fails(who) AS f FROM ev")


FOLD = [("t", [("0xaa", "0xbb", "100"), ("0xbb", "0xcc", "30"), ("0xaa", "0xcc", "5")], {"0xaa": -105, "0xbb": 70, "0xcc": 35}), ("zeros", [("0xaa", "0xbb", "50"), ("0xbb", "0xaa", "50")], {}), ("nulls", [("0xaa", "0xbb", "not a number"), ("0xaa", "0xbb", ""), ("0xaa", "0xbb", " 7")], {"0xaa": -7, "0xbb": 7})]


@pytest.mark.parametrize(("name", "data", "want"), FOLD)
@pytest.mark.parametrize("parts", [1, 3])
def test_signed_fold(spark, name, data, want, parts):
    df = spark.createDataFrame(data, "f string, t string, value string").repartition(parts)
    v = F.col("value").try_cast("decimal(38,0)")
    found = signed_fold([(df, [F.col("t")], [v]), (df, [F.col("f")], [-v])], ["who"], ["net"])
    assert {r.who: int(r.net) for r in found.collect()} == want


def test_exact_numbers(spark):
    big = 10**37 * 9
    df = spark.createDataFrame([(Decimal(big),), (Decimal(big),)], "v decimal(38,0)")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|overflow|OVERFLOW"):
        assert signed_fold([(df, [F.lit(1)], [F.col("v")])], ["k"], ["s"]).collect()[0].s is None
    text = spark.createDataFrame([("12",), (" 30 ",), ("x",), (None,), ("9" * 30,)], "t string")
    assert text.agg(sum_of_text(F.col("t"))).first()[0] == 42 + int("9" * 30)
    with pytest.raises(Exception, match="more than 38 digits"):
        spark.createDataFrame([("9" * 40,)], "t string").agg(sum_of_text(F.col("t"))).collect()
    with pytest.raises(Exception, match="dropped"):
        text.agg(F.sum(guarded(F.col("t"), F.col("t").try_cast("bigint")))).collect()
    doubles = spark.createDataFrame([(k, v) for k in (1, None) for v in (0.1, 0.2, 0.3, 1e16, -1e16, None)], "k int, v double")
    assert {r.k if r.k == r.k else None: r.s for r in exact_double_sum(doubles.repartition(5), ["k"], "v", "s").collect()} == {1: 0.6, None: 0.6}


def test_exact_double_sums_of_any_size(spark):
    import math
    import random

    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-300, 300) for _ in range(3000)] + [5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0, 1.0, 2.0**53, 2.0**52 - 0.5]
    rows_ = [(i % 3, v) for i, v in enumerate(values)] + [(7, None), (8, float("inf")), (8, 1.0), (9, float("nan")), (10, float("inf")), (10, float("-inf")), (11, 5e-324), (11, 5e-324), (12, 1e16), (12, 1.0), (12, -1e16)]
    found = {r.k: r.s for r in exact_double_sum(spark.createDataFrame(rows_, "k int, v double").repartition(7), ["k"], "v", "s").collect()}
    for k in range(3):
        assert found[k] == math.fsum(v for i, v in rows_ if i == k)
    assert found[7] is None and found[8] == float("inf") and math.isnan(found[9]) and math.isnan(found[10]) and found[11] == 1e-323 and found[12] == 1.0


def test_joins(spark):
    left = spark.createDataFrame([(1,), (5,), (9,), (None,)], "a bigint")
    right = spark.createDataFrame([(0, 5, "x"), (5, 9, "y"), (20, 30, "z"), (None, 3, "n"), (8, 2, "b")], "lo bigint, hi bigint, t string")
    for how in ("inner", "left", "right"):
        want = left.join(right, (F.col("a") >= F.col("lo")) & (F.col("a") <= F.col("hi")), how)
        assert rows(range_join(left, right, "a", "lo", "hi", how).select("a", "lo", "hi", "t")) == rows(want)
    seen = latest_row(spark.createDataFrame([("k", 5), ("k", 1), ("m", 9), ("k", None)], "k string, at int"), spark.createDataFrame([("k", 2, "u"), ("k", 5, "v"), ("m", 10, "w"), ("k", None, "q")], "k string, b int, v string"), ["k"], "at", "b", ["v"])
    assert rows(seen) == sorted([("k", 5, "v"), ("k", 1, None), ("m", 9, None), ("k", None, None)], key=str)
    base = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    for other in ([], [(1,)], [(1,), (None,)]):
        df = spark.createDataFrame(other, "y int")
        base.createOrReplaceTempView("nb")
        df.createOrReplaceTempView("no")
        assert rows(not_in(base, "x", df, "y")) == rows(spark.sql("SELECT x FROM nb WHERE x NOT IN (SELECT y FROM no)"))


def test_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    found = fixpoint(spark.createDataFrame([(1,)], "a int"), lambda new: new.join(edges, "a").select(F.col("b").alias("a")))
    assert rows(found) == [(1,), (2,), (3,)]
    with pytest.raises(LimitExceeded):
        fixpoint(spark.createDataFrame([(1,)], "a bigint"), lambda new: new.select(F.col("a") + 1), most=3)


def test_facts_and_segments(spark, tmp_path):
    one, two = spark.createDataFrame([(1, 5)], "b bigint, x int"), spark.createDataFrame([(2, 6, "m")], "b bigint, x bigint, memo string")
    assert dict(union_segments([one, two]).dtypes) == {"b": "bigint", "x": "bigint", "memo": "string"}
    with pytest.raises(PlanError):
        union_segments([one, spark.createDataFrame([("q",)], "x string")])
    whole = facts(one, two, {"b": "bigint", "late": "string"}, "b", after=1, through=2)
    assert [r.asDict() for r in whole.collect()] == [{"b": 2, "x": 6, "memo": "m", "late": None}]
    with pytest.raises(Exception, match="without a block"):
        facts(spark.createDataFrame([(None,)], "b bigint"), None, {}, "b", after=0).collect()
    wide = widened(text_rows(spark, [{"v": "12"}, {"v": "9" * 40}, {"v": None, "w": 3}]), ["v"]).collect()
    assert [(r.v_dec, r.v_overflow, r.w) for r in wide] == [(12, False, None), (None, True, None), (None, False, "3")]
    nest = tmp_path / "nest"
    nest.mkdir()
    import pandas as pd

    pd.DataFrame({"id": [1], "value": ["7"]}).to_parquet(nest / "pay-aa.parquet")
    pd.DataFrame({"id": [2], "value": ["x"]}).to_parquet(nest / "pay-bb.parquet")
    (nest / "schema.json").write_text(json.dumps({"pay": {"value": "word32"}, "later": {"id": "bigint", "n": "word16"}}))
    engine = Engine(spark)
    assert engine.open_segments(str(nest)) == ["later", "pay"]
    assert rows(engine.sql("SELECT id, value_dec, value_overflow FROM pay")) == [(1, Decimal(7), False), (2, None, True)]
    assert engine.sql("SELECT n_dec FROM later").count() == 0
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(NoSegments):
        engine.open_segments(str(empty))


def test_seam(spark):
    """Whatever is sealed and listed when, each block comes once."""
    tip = MemoryTip("b")
    assert seam(spark.createDataFrame([(1,)], "b bigint"), tip, "t").count() == 0  # nothing sealed isn't block 0
    tip.append("t", [{"b": i} for i in range(1, 21)])
    for sealed, listed in ((0, 0), (5, 5), (5, 9), (12, 20), (20, 20)):
        tip.seal_through("t", sealed)
        cold = spark.range(1, listed + 1).select(F.col("id").alias("b"))
        assert sorted(r.b for r in seam(cold, tip, "t").collect()) == list(range(1, 21))
    with pytest.raises(SeamError):
        tip.append("t", [{"b": 3}])
    with pytest.raises(SeamError):
        tip.append("t", [{"b": None}])
    with pytest.raises(SeamError):
        tip.seal_through("t", 4)


def test_host_tables_and_encodings(spark):
    host = HostTables(spark)
    df = spark.createDataFrame([(1, Decimal("1.50"), "é", datetime(2024, 1, 2, 3, 4, 5), [1, None], 2**60, float("nan"))], "i int, d decimal(10,2), s string, t timestamp_ntz, l array<int>, b bigint, f double")
    host.create_table_as("A", df)
    host.begin()
    host.create_table_as("b", df)
    host.drop_relation("a")
    host.rollback()
    assert list(host.tables) == ["a"]
    with pytest.raises(PlanError):
        host.create_table_as("a", df)
    assert rows(host.load_parquet("c", host.write_parquet(df.drop("f")))) == rows(df.drop("f"))
    assert json.loads(next(json_rows(df))) == {"i": 1, "d": "1.50", "s": "é", "t": "2024-01-02 03:04:05", "l": [1, None], "b": str(2**60), "f": None}
    assert describe(df)[:4] == [("i", "INTEGER"), ("d", "DECIMAL(10,2)"), ("s", "VARCHAR"), ("t", "TIMESTAMP")]
    import pyarrow as pa

    assert pa.ipc.open_stream(arrow_ipc(df)).read_all().num_rows == 1
    sizes = []
    assert for_each_batch(spark.range(20), lambda b: sizes.append(len(b)), 8) == 20 and sum(sizes) == 20 and max(sizes) == 8


def test_strftime_and_spelling():
    assert strftime("t", "%Y-%m") == "concat(date_format(t, 'yyyy'), '-', date_format(t, 'MM'))"
    with pytest.raises(ValueError):
        strftime("t", "%Q")
    assert spark_sql("SELECT a -- note\nFROM t;") == "SELECT a FROM t"
