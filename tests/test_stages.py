"""Edge cases on small frames: NULLs, empty inputs, padding, precedence, names, limits."""

import datetime

import pytest

from plandag import Catalog, Pipeline, Proj, Stage, StageError
from plandag.functions.expr import ExpressionError, c, compile_expr, i, op, s
from plandag.functions.predicate import Pred, compile_predicates
from plandag.sources import sinks
from plandag.streaming.session import QuerySession, counted


@pytest.fixture()
def cat(spark):
    cat = Catalog(spark, "")
    cat.register("a", spark.createDataFrame([(1, 1.0), (2, None), (None, 3.0), (3, 4.0)], "k bigint, v double"))
    cat.register("b", spark.createDataFrame([(1, 10), (1, 11), (4, 12)], "k bigint, w int"))
    cat.register("bn", spark.createDataFrame([(1, 10), (None, 11)], "k bigint, w int"))
    cat.register("empty", spark.createDataFrame([], "k bigint, w int"))
    cat.register("chars", spark.createDataFrame([("a", 1), ("a ", 2), (" a", 3), (None, 4)], "t string, n int"))
    return cat


def run(cat, *stages):
    return sorted(map(tuple, Pipeline(cat).run(stages).collect()), key=str)


def ks(cat, stage):
    return sorted((r[0] for r in Pipeline(cat).run([stage]).collect()), key=lambda x: (x is None, x))


def test_null_keys_never_join(cat):
    out = run(cat, Stage("LEFT_OUTER_JOIN", ("a", "bn"), "o", on=Pred("a.k", "EQ", "bn.k"), project=(Proj("k", "a.k"), Proj("w", "bn.w"))))
    assert out == sorted([(1, 10), (2, None), (None, None), (3, None)], key=str)


def test_aggregates_skip_nulls_and_empty_input_gives_one_row(cat):
    tail = (Proj("n", None, "COUNTSTAR"), Proj("c", "w", "COUNT"), Proj("s", "w", "SUM"))
    assert run(cat, Stage("AGGREGATION", ("empty",), "o", project=tail)) == [(0, 0, None)]
    assert run(cat, Stage("AGGREGATION", ("a",), "o", project=(Proj("n", None, "COUNTSTAR"), Proj("c", "v", "COUNT"), Proj("m", "v", "AVG")))) == [(4, 3, 8 / 3)]


@pytest.mark.parametrize(("members", "negate", "want"), [("b", False, [1]), ("b", True, [2, 3]), ("bn", True, []), ("empty", True, [1, 2, 3, None]), ("empty", False, [])])
def test_membership(cat, members, negate, want):
    assert ks(cat, Stage("IN", ("a", members), "o", compare=("a.k", "EQ"), on=f"{members}.k", negate=negate, project=(Proj("k", "a.k"),))) == want


@pytest.mark.parametrize(("members", "want"), [("b", [2, 3]), ("bn", []), ("empty", [1, 2, 3, None])])
def test_correlated_not_in(cat, members, want):
    assert ks(cat, Stage("DEPENDENCY_IN", ("a", members), "o", compare=("a.k", f"{members}.k"), on=Pred(f"{members}.w", "GT", i(5)), negate=True, project=(Proj("k", "a.k"),))) == want


def pairs_of(cat, left, right):
    return [tuple(r) for r in cat.table(left).collect()], [tuple(r) for r in cat.table(right).collect()]


HOLDS = {"LT": lambda a, b: a < b, "LE": lambda a, b: a <= b, "GT": lambda a, b: a > b, "GE": lambda a, b: a >= b}


@pytest.mark.parametrize("op_", HOLDS)
@pytest.mark.parametrize("negate", [False, True])
@pytest.mark.parametrize(("keyed", "flipped"), [(False, False), (True, True)])
def test_exists_with_an_inequality(cat, spark, op_, negate, keyed, flipped):
    cat.register("l", spark.createDataFrame([(1, 5, 0), (1, 10, 1), (2, 5, 2), (None, 5, 3), (1, None, 4), (3, 12, 5)], "k bigint, x int, id int"))
    cat.register("r", spark.createDataFrame([(1, 10), (1, 7), (2, None), (None, 5), (3, 12)], "k bigint, y int"))
    on = [Pred("l.x", op_, "r.y") if not flipped else Pred("r.y", {"LT": "GT", "GT": "LT", "LE": "GE", "GE": "LE"}[op_], "l.x")]
    on += ["AND", Pred("l.k", "EQ", "r.k"), "AND", Pred("r.y", "GT", i(6))] if keyed else []
    left, right = pairs_of(cat, "l", "r")
    hit = lambda k, x: any(None not in (x, y) and HOLDS[op_](x, y) and (not keyed or (k is not None and k == j and y > 6)) for j, y in right)
    got = run(cat, Stage("DEPENDENCY_EXIST", ("l", "r"), "o", on=on, negate=negate, project=(Proj("id", "l.id"),)))
    assert got == [(n,) for k, x, n in left if hit(k, x) != negate]


@pytest.mark.parametrize("negate", [False, True])
def test_correlated_in_with_an_inequality(cat, spark, negate):
    cat.register("l", spark.createDataFrame([(1, 5, 0), (1, 10, 1), (2, 5, 2), (None, 5, 3), (None, 50, 4), (3, None, 5), (4, 0, 6)], "k bigint, x int, id int"))
    cat.register("r", spark.createDataFrame([(1, 10), (2, 4), (None, 6), (3, 12)], "k bigint, y int"))
    left, right = pairs_of(cat, "l", "r")

    def member(k, x):
        seen = [j for j, y in right if None not in (x, y) and y > x]
        if not seen:
            return False
        return True if k is not None and k in seen else None if k is None or None in seen else False

    got = run(cat, Stage("DEPENDENCY_IN", ("l", "r"), "o", compare=("l.k", "r.k"), on=Pred("r.y", "GT", "l.x"), negate=negate, project=(Proj("id", "l.id"),)))
    assert got == [(n,) for k, x, n in left if member(k, x) is (not negate)]


@pytest.mark.parametrize("name", ["corr_not_in", "exists_theta", "not_exists_key_and_theta"])
def test_one_inequality_tries_no_pairs(spark, name):
    from plandag import queries

    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_results_are_whole(spark):
    df = spark.range(25_000).selectExpr("id", "id % 7 as m")
    assert len(sinks.columns(df)["id"]) == 25_000 and len(sinks.columns(df, 10)["id"]) == 10
    parts = list(sinks.column_batches(df, 4000))
    assert [len(p["m"]) for p in parts] == [4000] * 6 + [1000] and sorted(x for p in parts for x in p["id"]) == list(range(25_000))
    assert len(sinks.box(df.limit(1500)).split("\n")) == 1504
    assert sinks.box(df.limit(3), 2).split("\n")[-1] == "(the first 2 rows; there are more)" and "more" not in sinks.box(df.limit(2), 2)


def test_rows_are_counted(cat):
    session = QuerySession(cat, count_rows=True)
    session.submit(1, Stage("FULL_SCAN", ("b",), "some", where=Pred("w", "GT", i(10))))
    session.submit(1, Stage("LEFT_OUTER_JOIN", ("a", "some"), "o", on=Pred("a.k", "EQ", "some.k"), project=(Proj("k", "a.k"), Proj("w", "some.w"))))
    assert len(session.result(1).collect()) == 4
    assert session.counts(1) == {"some": {"scanned": 3, "kept": 2}, "o": {"scanned": 4, "kept": 4}}


def test_file_lists(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    cat = Catalog(spark, str(tmp_path))
    files = [f.rpartition("/")[2] for f in cat.metadata("t")["files"]]
    assert len(files) == 4
    some = [cat.subset("t", files[:k]).count() for k in range(5)]
    assert some[0] == 0 < some[1] < some[2] < some[4] == 100 and cat.subset("t", cat.metadata("t")["files"][:1]).count() == some[1]
    with pytest.raises(ValueError):
        cat.subset("t", ["other"])


def test_json_operands_are_no_tokens(cat, spark):
    cat.register("u", spark.createDataFrame([(1, 0, 2), (5, 0, 2)], "A int, COLUMN int, B int"))
    text = '{"kind": "FILTER", "inputs": ["u"], "alias": "o", "where": [{"lv": "A", "op": "BETWEEN", "rv": ["COLUMN", "B"]}]}'
    assert run(cat, Stage.from_json(text)) == [(1, 0, 2)]
    text = '{"kind": "FILTER", "inputs": ["u"], "alias": "o", "where": [{"lv": {"kind": "COLUMN", "value": "A"}, "op": "IN", "rv": [["INT32", 5], {"kind": "INT32", "value": 6}]}]}'
    assert run(cat, Stage.from_json(text)) == [(5, 0, 2)]


@pytest.mark.parametrize(("negate", "members", "n"), [(False, "b", 4), (True, "b", 0), (False, "empty", 0), (True, "empty", 4)])
def test_uncorrelated_exists(cat, negate, members, n):
    assert len(run(cat, Stage("EXIST", ("a", members), "o", negate=negate))) == n


def test_scalar_subquery_counts_no_rows_as_zero(cat):
    stage = Stage("DEPENDENCY_INNER_JOIN", ("a", "b"), "o", compare=(i(1), "GT"), scalar=Proj("n", "b.w", "COUNT"), on=Pred("b.k", "EQ", "a.k"), project=(Proj("k", "a.k"),))
    assert ks(cat, stage) == [2, 3, None]


def test_scalar_subquery_with_inequality(cat):
    stage = Stage("DEPENDENCY_INNER_JOIN", ("a", "b"), "o", compare=(i(12), "EQ"), scalar=Proj("m", "b.w", "MAX"), on=Pred("b.k", "GT", "a.k"), project=(Proj("k", "a.k"),))
    assert ks(cat, stage) == [1, 2, 3]


def test_block_filter_pads_and_masks(cat):
    assert run(cat, Stage("BLOCK_FILTER", ("chars",), "o", where=[Pred("t", "EQ", s("a "))], mask=("n",))) == [(None, 1), (None, 2)]


def test_precedence(spark):
    df = spark.createDataFrame([(x, y, z) for x in (True, False) for y in (True, False) for z in (True, False)], "a boolean, b boolean, c boolean")
    a, b, cc = (Pred(n, "EQ", compile_expr([c(n), c(n), op("OR"), c(n), op("NOT"), op("OR")])) for n in "abc")
    for items, want in (([a, "OR", b, "AND", cc], "a or b and c"), (["NOT", a, "AND", "(", b, "OR", cc, ")"], "not a and (b or c)"), ([a, b], "a and b")):
        assert df.where(compile_predicates(items)).count() == df.where(want).count()


def test_case_binds_and_tighter_and_needs_no_else(spark):
    w = [op("CASE"), op("WHEN"), c("a"), i(1), op("="), op("OR"), c("a"), i(2), op("="), op("AND"), c("b"), i(1), op("="), op("THEN"), s("x"), op("END")]
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "a int, b int").select(compile_expr(w).alias("r"))
    assert [r.r for r in df.collect()] == ["x", None, "x"]


@pytest.mark.parametrize("tokens", [[], [op("+")], [i(1), i(2)], [i(1), op("?")], [op("CASE"), op("END")], [op("EXTRACT"), s("WEEK"), c("d")]])
def test_bad_tokens(spark, tokens):
    with pytest.raises(ExpressionError):
        compile_expr(tokens)


def test_division_by_zero_is_null_and_dates(spark):
    df = spark.createDataFrame([(7, 0, datetime.date(2024, 2, 29))], "a int, b int, d date")
    e = lambda *t: compile_expr(list(t))
    row = df.select(e(c("a"), c("b"), op("/")), e(c("a"), i(2), op("/")), e(c("a"), i(2), op("div")), e(op("EXTRACT"), s("DAY"), c("d")), e(op("SUBSTRING"), s("abcdef"), i(0), i(2))).first()
    assert tuple(row) == (None, 3.5, 3, 29, "ab")


@pytest.mark.parametrize("stage", [Stage("NO", ("a",), "o"), Stage("INNER_JOIN", ("a",), "o"), Stage("LEFT_OUTER_JOIN", ("a", "b"), "o"), Stage("AGGREGATION", ("a",), "o", project=(Proj("x", "k"), Proj("x", "v"))), Stage("INNER_JOIN", ("a", "b"), "o", on=Pred("a.k", "EQ", "b.k")), Stage("FULL_SCAN", ("a",), "o", limit=-1), Stage("AGGREGATION", ("a",), "o", project=(Proj("x", "k", "TOP"),))])
def test_bad_stages(cat, stage):
    with pytest.raises(StageError):
        Pipeline(cat).run([stage])


def test_union_distinct_and_limits(cat):
    both = Stage("UNION", ("b", "b"), "o", distinct=True, order_by=(("w", "DESC"),), limit=2, offset=1)
    assert run(cat, both) == [(1, 10), (1, 11)]
    assert len(run(cat, Stage("UNION", ("b", "b"), "o"))) == 6


def test_overlay(cat, spark):
    cat.with_overlay("b", "k", deleted=spark.createDataFrame([(1,), (9,)], "k bigint"), inserted=spark.createDataFrame([(1, 99)], "k bigint, w int"))
    assert run(cat, Stage("FULL_SCAN", ("b",), "o")) == [(1, 99), (4, 12)]


def test_json_box_and_session(cat):
    text = '{"kind": "FILTER", "inputs": ["b"], "alias": "o", "where": [{"lv": "w", "op": "GT", "rv": ["INT32", 10]}], "project": [{"alias": "w2", "expr": [["COLUMN", "w"], ["INT32", 2], ["OPERATOR", "*"]]}]}'
    session = QuerySession(cat)
    session.submit(7, Stage.from_json(text))
    assert sorted(r.w2 for r in session.result(7).collect()) == [22, 24]
    assert sinks.box(session.result(7).orderBy("w2")).split("\n")[1:4:2] == ["| w2 |", "| 22 |"]
    df, seen = counted(cat.table("b"), "seen")
    df.count()
    assert seen.get == {"rows": 3}
    session.end(7)
    with pytest.raises(StageError):
        session.result(7)


def test_stream(spark, cat, tmp_path):
    from plandag.streaming.continuous import run_on_stream

    cat.table("b").write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema("k bigint, w int").parquet(str(tmp_path / "in"))
    q = run_on_stream(stream, "s", cat, [Stage("INNER_JOIN", ("s", "a"), "o", on=Pred("s.k", "EQ", "a.k"), project=(Proj("w", "s.w"),))], lambda df, _: out.extend(r.w for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(out) == [10, 11]


def test_filters_and_columns_reach_the_scan(spark):
    from plandag import queries

    plan = queries.queries()["filter_compare"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "IsNotNull(l_quantity)" in plan and "l_extendedprice" not in plan


def test_placement(spark):
    from plandag.operators.placement import best_replicas

    replicas = spark.createDataFrame([("f1", "a"), ("f2", "a"), ("f3", "a"), ("f3", "b"), ("f3", "b"), ("f4", "b"), ("f4", "c"), ("f5", "d"), ("f5", "e")], "file string, node string")
    metrics = spark.createDataFrame([("a", 9.0), ("b", 4.0), ("c", 4.0)], "node string, score double")
    got = {r.file: (r.node, r.score) for r in best_replicas(replicas, metrics).collect()}
    assert got == {"f1": ("a", 9.0), "f2": ("a", 9.0), "f3": ("b", 4.0), "f4": ("b", 4.0), "f5": ("d", 0.0)}


def odd_tables(spark, tmp_path, customers, suppliers):
    import duckdb

    from plandag import queries

    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return queries.queries(), queries.oracle_sql(), con


def test_placement_of_odd_rows_is_as_in_sql(spark, tmp_path):
    """NULL and repeated keys, files in several nations, nations with one supplier or none, ties, negative and missing scores."""
    import random

    from tests.oracle import compare

    draw = random.Random(5)
    pick = lambda *of: draw.choice(of)
    customers = [(pick(None, *range(400)), "", pick(None, *range(14)), pick(None, float("nan"), 9000.0, 9500.0, 9900.0, -5.0, 10.0)) for _ in range(600)]
    suppliers = [(pick(None, *range(30)), pick(None, *range(6)), pick(None, float("nan"), 0.0, -8.0, -8.0, 40.0, 60.0, 90.0)) for _ in range(40)]
    suppliers += [(50 + n % 3, n, 90.0 - n) for n in range(6, 12)] + [(None, 12, 5.0)]
    found, sql, con = odd_tables(spark, tmp_path, customers, suppliers)
    compare(found["placement_ranking"](spark, str(tmp_path)), con, sql["placement_ranking"])


def test_placement_makes_no_pairs(spark, tmp_path):
    from tests.oracle import compare

    found, sql, con = odd_tables(spark, tmp_path, [(n, "", n % 2, 10.0 * n) for n in range(1200)], [(n, n % 2, float(n % 97)) for n in range(1000)])
    df = found["placement_ranking"](spark, str(tmp_path))
    compare(df, con, sql["placement_ranking"])
    assert max(join_rows(df)) <= 1200


NAN = float("nan")
MANY = [(n, "", n % 3, 37.0 * (n % 270)) for n in range(3000)], [(n, n % 3, 91.0 * (n % 110)) for n in range(900)]
ODD = [(n % 50, "", (None, 0, 1, 7)[n % 4], (None, NAN, 9500.0, 9501.0, 9999.0)[n % 5]) for n in range(200)], [(n % 30, (None, 0, 1, 8)[n % 4], (None, NAN, 9000.0, 9001.0, 5.0)[n % 5]) for n in range(90)]


@pytest.mark.parametrize("name", ["join_theta", "join_left", "join_right"])
@pytest.mark.parametrize("tables", [MANY, ODD, (ODD[0], []), ([], ODD[1])], ids=["many", "odd", "no suppliers", "no customers"])
def test_spread_joins(spark, tmp_path, name, tables):
    """As in SQL, and no task makes much more than its share where a few keys, or none, make nearly all rows."""
    from pyspark.sql import functions as F

    from tests.oracle import compare

    found, sql, con = odd_tables(spark, tmp_path, *tables)
    df = found[name](spark, str(tmp_path))
    compare(df, con, sql[name])
    by_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert tables is not MANY or max(by_task) <= 0.1 * sum(by_task)


def test_only_some_joins_are_spread(cat):
    for kind, on in (("FULL_OUTER_JOIN", Pred("a.k", "EQ", "b.k")), ("INNER_JOIN", None), ("IN", Pred("a.k", "EQ", "b.k"))):
        with pytest.raises(StageError):
            Pipeline(cat).run([Stage(kind, ("a", "b"), "o", on=on, compare=("a.k", "EQ"), project=(Proj("k", "a.k"),), spread=True)])


def join_rows(df):
    """The rows that each join has made once df was collected."""

    def walk(node):
        if "Join" in (name := node.nodeName()):
            yield node.metrics().apply("numOutputRows").value()
        kids = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else []
        for k in kids or map(node.children().apply, range(node.children().size())):
            yield from walk(k)

    return list(walk(df._jdf.queryExecution().executedPlan()))
