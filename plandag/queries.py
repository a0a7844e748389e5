"""Queries over the relational tables, each a list of stages, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plandag.functions.expr import Tok, c, cast, date, dbl, dec, i, op, s
from plandag.functions.predicate import Pred
from plandag.operators.placement import best_replicas
from plandag.plans.pipeline import Pipeline
from plandag.plans.stage import Proj, Stage
from plandag.sources.catalog import Catalog, overlay

CASE, WHEN, THEN, ELSE, END = map(op, ("CASE", "WHEN", "THEN", "ELSE", "END"))
MONEY, BIG, INT = cast("decimal(15,2)"), cast("bigint"), cast("int")
WIDE = cast("decimal(38,2)")


def cols(*names: str) -> tuple[Proj, ...]:
    return tuple(Proj(n.rpartition(".")[2], n) for n in names)


def total(alias: str, *tokens: object) -> Proj:
    return Proj(alias, list(tokens), "SUM")


def count(alias: str = "n") -> Proj:
    return Proj(alias, None, "COUNTSTAR")


def within(name: str, low: str, high: str) -> list:
    return [Pred(name, "GE", date(low)), "AND", Pred(name, "LT", date(high))]


def wide(alias: str, *names: str, source: str) -> Stage:
    """The sums of a stage as DECIMAL(38,2), the other columns as they are."""
    return Stage("AGGREGATION", (source,), alias, project=tuple(Proj(n.lstrip("+"), [c(n.lstrip("+")), WIDE] if n[0] == "+" else n) for n in names))


HIGH = [CASE, WHEN, c("o_orderpriority"), s("1-URGENT"), op("="), op("OR"), c("o_orderpriority"), s("2-HIGH"), op("="), THEN, i(1), ELSE, i(0), END]
LOW = [CASE, WHEN, c("o_orderpriority"), s("1-URGENT"), op("<>"), op("AND"), c("o_orderpriority"), s("2-HIGH"), op("<>"), THEN, i(1), ELSE, i(0), END]
DISCOUNTED = [c("l_extendedprice"), i(1), c("l_discount"), op("-"), op("*")]
EXACT_DISCOUNTED = [c("l_extendedprice"), MONEY, i(1), c("l_discount"), MONEY, op("-"), op("*")]

#: name: stages, SQL.
PLANS: dict[str, tuple[list[Stage], str]] = {
    "scan_project": (
        [Stage("FULL_SCAN", ("orders",), "out", project=cols("o_orderkey", "o_custkey", "o_orderstatus"))],
        "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    ),
    "filter_compare": (
        [Stage("INDEX_SCAN", ("lineitem",), "out", where=[Pred("l_quantity", "GE", i(10)), "AND", Pred("l_quantity", "LT", i(20)), "AND", Pred("l_discount", "GT", dbl(0.03)), "AND", Pred("l_tax", "LE", dbl(0.05)), "AND", Pred("l_returnflag", "EQ", s("R")), "AND", Pred("l_linestatus", "NE", s("O"))], project=cols("l_orderkey", "l_linenumber", "l_quantity"))],
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.03 AND l_tax <= 0.05 AND l_returnflag = 'R' AND l_linestatus <> 'O'",
    ),
    "filter_like": (
        [Stage("FULL_SCAN", ("part",), "out", where=[Pred("p_name", "LIKE", s("%widget%")), "AND", Pred("p_name", "NOTLIKE", s("red%"))], project=cols("p_partkey", "p_name"))],
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' AND p_name NOT LIKE 'red%'",
    ),
    "filter_between_in": (
        [Stage("FILTER", ("part",), "out", where=[Pred("p_size", "BETWEEN", (i(10), i(20))), "AND", Pred("p_type", "IN", [s("PROMO"), s("ECONOMY")]), "AND", Pred("p_brand", "NOTIN", [s("Brand#11"), s("Brand#12")])], project=cols("p_partkey", "p_type", "p_size"))],
        "SELECT p_partkey, p_type, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('PROMO','ECONOMY') AND p_brand NOT IN ('Brand#11','Brand#12')",
    ),
    "filter_or": (
        [Stage("FILTER", ("orders",), "out", where=[Pred("o_orderstatus", "EQ", s("P")), "OR", Pred("o_orderstatus", "EQ", s("F")), "AND", Pred("o_totalprice", "GT", i(200000))], project=cols("o_orderkey"))],
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_totalprice > 200000)",
    ),
    "filter_is_null": (
        [Stage("LEFT_OUTER_JOIN", ("nation", "supplier"), "out", on=[Pred("n_nationkey", "EQ", "s_nationkey"), "AND", Pred("s_acctbal", "GT", i(5000))], where=Pred("s_suppkey", "IS"), project=cols("n_nationkey", "s_suppkey"))],
        "SELECT n.n_nationkey, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000 WHERE s.s_suppkey IS NULL",
    ),
    "expr_arith": (
        [Stage("FULL_SCAN", ("orders",), "out", project=(*cols("o_orderkey"), Proj("plus_v", [c("o_totalprice"), MONEY, dec("1.5", 3, 2), op("+"), WIDE]), Proj("int_v", [c("o_custkey"), i(2), op("*"), i(1), op("-")])))],
        "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) + CAST(1.5 AS DECIMAL(3,2)) AS DECIMAL(38,2)) AS plus_v, o_custkey * 2 - 1 AS int_v FROM orders",
    ),
    "expr_case": (
        [Stage("FULL_SCAN", ("orders",), "out", project=(*cols("o_orderkey"), Proj("high", HIGH)))],
        "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS high FROM orders",
    ),
    "expr_case_like": (
        [Stage("FULL_SCAN", ("part",), "out", project=(*cols("p_partkey"), Proj("k", [CASE, WHEN, c("p_type"), s("PRO%"), op("LIKE"), THEN, s("p"), WHEN, c("p_name"), s("%rod"), op("LIKE"), THEN, s("r"), ELSE, s("o"), END])))],
        "SELECT p_partkey, CASE WHEN p_type LIKE 'PRO%' THEN 'p' WHEN p_name LIKE '%rod' THEN 'r' ELSE 'o' END AS k FROM part",
    ),
    "expr_substring": (
        [Stage("FULL_SCAN", ("part",), "out", project=(*cols("p_partkey"), Proj("b", [op("SUBSTRING"), c("p_brand"), i(6), i(2)])))],
        "SELECT p_partkey, SUBSTRING(p_brand, 7, 2) AS b FROM part",
    ),
    "expr_extract": (
        [Stage("FULL_SCAN", ("orders",), "out", project=(*cols("o_orderkey"), *(Proj(k, [op("EXTRACT"), s(unit), c("o_orderdate")]) for k, unit in (("y", "YEAR"), ("m", "MONTH"), ("d", "DAY")))))],
        "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d FROM orders",
    ),
    "agg_global": (
        [
            Stage("AGGREGATION", ("lineitem",), "sums", where=[*within("l_shipdate", "1996-01-01", "1997-01-01"), "AND", Pred("l_discount", "BETWEEN", (dbl(0.05), dbl(0.07))), "AND", Pred("l_quantity", "LT", i(24))], project=(total("revenue", c("l_extendedprice"), MONEY, c("l_discount"), MONEY, op("*")), count())),
            Stage("AGGREGATION", ("sums",), "out", project=(Proj("revenue", [c("revenue"), cast("decimal(38,4)")]), Proj("n", "n"))),
        ],
        "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(38,4)) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    ),
    "agg_group": (
        [
            Stage("AGGREGATION", ("lineitem",), "sums", group_by=("l_returnflag", "l_linestatus"), project=(*cols("l_returnflag", "l_linestatus"), total("sum_qty", c("l_quantity"), MONEY), Proj("mn", "l_shipdate", "MIN"), Proj("mx", "l_extendedprice", "MAX"), count())),
            wide("out", "l_returnflag", "l_linestatus", "+sum_qty", "mn", "mx", "n", source="sums"),
        ],
        "SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS sum_qty, MIN(l_shipdate) AS mn, MAX(l_extendedprice) AS mx, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_avg": (
        [Stage("AGGREGATION", ("lineitem",), "avgs", group_by=("l_returnflag",), project=(*cols("l_returnflag"), Proj("a", "l_quantity", "AVG"))), Stage("AGGREGATION", ("avgs",), "out", project=(*cols("l_returnflag"), Proj("a", [c("a"), i(4), op("ROUND")])))],
        "SELECT l_returnflag, ROUND(AVG(l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_count_col": (
        [
            Stage("LEFT_OUTER_JOIN", ("supplier", "customer"), "both", on=[Pred("s_nationkey", "EQ", "c_nationkey"), "AND", Pred("c_acctbal", "GT", i(9000))], project=cols("s_nationkey", "c_custkey"), spread=True),
            Stage("AGGREGATION", ("both",), "out", group_by=("s_nationkey",), project=(*cols("s_nationkey"), Proj("n", "c_custkey", "COUNT"))),
        ],
        "SELECT s.s_nationkey, COUNT(c.c_custkey) AS n FROM supplier s LEFT JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_acctbal > 9000 GROUP BY s.s_nationkey",
    ),
    "agg_count_distinct": (
        [Stage("AGGREGATION", ("lineitem",), "out", group_by=("l_returnflag",), project=(*cols("l_returnflag"), Proj("n", "l_suppkey", "COUNTDISTINCT")))],
        "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_min_max_string": (
        [Stage("AGGREGATION", ("part",), "out", group_by=("p_type",), project=(*cols("p_type"), Proj("mn", "p_name", "MIN"), Proj("mx", "p_name", "MAX")))],
        "SELECT p_type, MIN(p_name) AS mn, MAX(p_name) AS mx FROM part GROUP BY p_type",
    ),
    "agg_of_agg": (
        [
            Stage("LEFT_OUTER_JOIN", ("customer", "orders"), "both", on=[Pred("c_custkey", "EQ", "o_custkey"), "AND", Pred("o_orderpriority", "NE", s("5-LOW"))], project=cols("c_custkey", "o_orderkey")),
            Stage("AGGREGATION", ("both",), "counts", group_by=("c_custkey",), project=(*cols("c_custkey"), Proj("c_count", "o_orderkey", "COUNT"))),
            Stage("AGGREGATION", ("counts",), "out", group_by=("c_count",), project=(*cols("c_count"), count("custdist"))),
        ],
        "SELECT c_count, COUNT(*) AS custdist FROM (SELECT c.c_custkey, COUNT(o.o_orderkey) AS c_count FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority <> '5-LOW' GROUP BY c.c_custkey) t GROUP BY c_count",
    ),
    "agg_first_in_group": (
        [Stage("INNER_JOIN", ("orders", "customer"), "out", on=Pred("o_custkey", "EQ", "c_custkey"), group_by=("o_custkey",), project=(*cols("o_custkey", "c_name"), count()))],
        "SELECT o.o_custkey, MIN(c.c_name) AS c_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey",
    ),
    "having": (
        [Stage("AGGREGATION", ("orders",), "out", group_by=("o_custkey",), project=(*cols("o_custkey"), count()), having=Pred("n", "GT", i(12)))],
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    ),
    "order_limit_offset": (
        [Stage("FULL_SCAN", ("orders",), "out", project=cols("o_orderkey", "o_totalprice"), order_by=(("o_totalprice", "DESC"), ("o_orderkey", "ASC")), limit=10, offset=5)],
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10 OFFSET 5",
    ),
    "top_k": (
        [Stage("AGGREGATION", ("customer",), "out", project=cols("c_custkey", "c_acctbal"), order_by=(("c_acctbal", "DESC"), ("c_custkey", "ASC")), limit=20)],
        "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    ),
    "index_table_scan": (
        [
            Stage("INDEX_SCAN", ("part",), "keys", where=[Pred("p_type", "EQ", s("PROMO")), "AND", Pred("p_size", "LT", i(5))], project=cols("p_partkey")),
            Stage("INDEX_TABLE_SCAN", ("lineitem", "keys"), "out", on=Pred("l_partkey", "EQ", "p_partkey"), project=cols("l_orderkey", "l_linenumber", "l_partkey")),
        ],
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size < 5)",
    ),
    "join_inner_equi": (
        [Stage("FULL_SCAN", ("customer",), "building", where=Pred("c_mktsegment", "EQ", s("BUILDING"))), Stage("INNER_JOIN", ("orders", "building"), "out", on=Pred("o_custkey", "EQ", "c_custkey"), project=cols("o_orderkey", "c_name"))],
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    ),
    "join_multi_key_residual": (
        [Stage("INNER_JOIN", ("lineitem:a", "lineitem:b"), "out", on=[Pred("a.l_orderkey", "EQ", "b.l_orderkey"), "AND", Pred("a.l_linestatus", "EQ", "b.l_linestatus"), "AND", Pred("a.l_suppkey", "NE", "b.l_suppkey"), "AND", Pred("a.l_shipdate", "LT", "b.l_shipdate")], project=(count(),))],
        "SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus AND a.l_suppkey <> b.l_suppkey AND a.l_shipdate < b.l_shipdate",
    ),
    "join_date_key": (
        [Stage("INNER_JOIN", ("orders", "lineitem"), "out", on=[Pred("o_orderdate", "EQ", "l_shipdate"), "AND", Pred("o_orderkey", "EQ", "l_orderkey")], project=(count(),))],
        "SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderdate = l.l_shipdate AND o.o_orderkey = l.l_orderkey",
    ),
    "join_theta": (
        [Stage("INNER_JOIN", ("supplier:a", "supplier:b"), "out", on=Pred("a.s_acctbal", "LT", "b.s_acctbal"), project=(Proj("x", "a.s_suppkey"), Proj("y", "b.s_suppkey")), spread=True)],
        "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal",
    ),
    "join_left": (
        [Stage("LEFT_OUTER_JOIN", ("supplier", "customer"), "out", on=[Pred("s_nationkey", "EQ", "c_nationkey"), "AND", Pred("c_acctbal", "GT", i(9500))], project=cols("s_suppkey", "c_custkey"), spread=True)],
        "SELECT s.s_suppkey, c.c_custkey FROM supplier s LEFT JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_acctbal > 9500",
    ),
    "join_right": (
        [Stage("RIGHT_OUTER_JOIN", ("supplier", "customer"), "out", on=[Pred("s_nationkey", "EQ", "c_nationkey"), "AND", Pred("s_acctbal", "GT", i(9000))], project=cols("s_suppkey", "c_custkey"), spread=True)],
        "SELECT s.s_suppkey, c.c_custkey FROM supplier s RIGHT JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_acctbal > 9000",
    ),
    "join_cross": (
        [Stage("CROSS_JOIN", ("region", "nation"), "out", project=cols("r_name", "n_name"))],
        "SELECT r_name, n_name FROM region CROSS JOIN nation",
    ),
    "join_three_way": (
        [
            Stage("INNER_JOIN", ("nation", "region"), "nr", on=Pred("n_regionkey", "EQ", "r_regionkey"), where=Pred("r_name", "EQ", s("ASIA")), project=cols("n_nationkey", "n_name")),
            Stage("INNER_JOIN", ("supplier", "nr"), "sn", on=Pred("s_nationkey", "EQ", "n_nationkey"), project=cols("s_suppkey", "s_nationkey", "n_name")),
            Stage("INNER_JOIN", ("lineitem", "sn"), "ls", on=Pred("l_suppkey", "EQ", "s_suppkey"), project=cols("l_orderkey", "s_nationkey", "n_name", "l_extendedprice", "l_discount")),
            Stage("INNER_JOIN", ("customer", "orders"), "co", on=Pred("c_custkey", "EQ", "o_custkey"), project=cols("c_nationkey", "o_orderkey")),
            Stage(
                "INNER_JOIN",
                ("ls", "co"),
                "sums",
                on=[Pred("l_orderkey", "EQ", "o_orderkey"), "AND", Pred("s_nationkey", "EQ", "c_nationkey")],
                group_by=("n_name",),
                project=(*cols("n_name"), total("revenue", *EXACT_DISCOUNTED)),
            ),
            Stage("AGGREGATION", ("sums",), "out", project=(*cols("n_name"), Proj("revenue", [c("revenue"), cast("decimal(38,4)")]))),
        ],
        "SELECT n.n_name, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2)))) AS DECIMAL(38,4)) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name",
    ),
    "semi_in": (
        [
            Stage("AGGREGATION", ("lineitem",), "large", group_by=("l_orderkey",), project=(*cols("l_orderkey"), Proj("q", "l_quantity", "SUM")), having=Pred("q", "GT", i(250))),
            Stage("IN", ("orders", "large"), "out", compare=("o_orderkey", "EQ"), on="l_orderkey", project=cols("o_orderkey")),
        ],
        "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250)",
    ),
    "anti_not_in": (
        [Stage("FULL_SCAN", ("lineitem",), "large", where=Pred("l_quantity", "GT", i(45)), project=cols("l_partkey")), Stage("IN", ("part", "large"), "out", compare=("p_partkey", "EQ"), on="l_partkey", negate=True, project=cols("p_partkey"))],
        "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    ),
    "exists_uncorrelated": (
        [Stage("EXIST", ("nation", "orders"), "out", on=Pred("o_totalprice", "GT", i(100000)), project=cols("n_name"))],
        "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000)",
    ),
    "corr_scalar": (
        [
            Stage("DEPENDENCY_INNER_JOIN", ("lineitem:l", "lineitem:l2"), "small", compare=("l.l_quantity", "LT"), scalar=Proj("half", [dbl(0.5), c("l2.l_quantity"), op("AVG"), op("*")]), on=Pred("l2.l_partkey", "EQ", "l.l_partkey"), project=cols("l.l_extendedprice")),
            Stage("AGGREGATION", ("small",), "sums", project=(total("s", c("l_extendedprice"), MONEY),)),
            wide("out", "+s", source="sums"),
        ],
        "SELECT CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS s FROM lineitem l WHERE l.l_quantity < (SELECT 0.5 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l.l_partkey)",
    ),
    "corr_exists": (
        [Stage("DEPENDENCY_EXIST", ("orders", "lineitem"), "out", on=[Pred("l_orderkey", "EQ", "o_orderkey"), "AND", Pred("l_shipdate", "GT", "o_orderdate")], group_by=("o_orderpriority",), project=(*cols("o_orderpriority"), count()))],
        "SELECT o_orderpriority, COUNT(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate) GROUP BY o_orderpriority",
    ),
    "corr_not_exists": (
        [Stage("DEPENDENCY_EXIST", ("customer", "orders"), "out", on=[Pred("o_custkey", "EQ", "c_custkey"), "AND", Pred("o_totalprice", "GT", i(300000))], negate=True, project=cols("c_custkey"))],
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    ),
    "corr_in": (
        [Stage("DEPENDENCY_IN", ("customer", "supplier"), "out", compare=("c_nationkey", "s_nationkey"), on=Pred("s_acctbal", "GT", "c_acctbal"), project=cols("c_custkey"))],
        "SELECT c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT s.s_nationkey FROM supplier s WHERE s.s_acctbal > c.c_acctbal)",
    ),
    "corr_not_in": (
        [Stage("DEPENDENCY_IN", ("customer", "supplier"), "out", compare=("c_nationkey", "s_nationkey"), on=Pred("s_acctbal", "GT", "c_acctbal"), negate=True, project=cols("c_custkey"))],
        "SELECT c_custkey FROM customer c WHERE c.c_nationkey NOT IN (SELECT s.s_nationkey FROM supplier s WHERE s.s_acctbal > c.c_acctbal)",
    ),
    "exists_theta": (
        [Stage("DEPENDENCY_EXIST", ("customer", "supplier"), "out", on=Pred("s_acctbal", "LT", "c_acctbal"), project=cols("c_custkey"))],
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_acctbal < c.c_acctbal)",
    ),
    "not_exists_key_and_theta": (
        [
            Stage(
                "DEPENDENCY_EXIST",
                ("customer", "supplier"),
                "out",
                on=[Pred("s_nationkey", "EQ", "c_nationkey"), "AND", Pred("s_acctbal", "GE", "c_acctbal"), "AND", Pred("s_suppkey", "GT", i(10))],
                negate=True,
                project=cols("c_custkey"),
            )
        ],
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS "
        "(SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal >= c.c_acctbal AND s.s_suppkey > 10)",
    ),
    "join_full": (
        [Stage("FULL_OUTER_JOIN", ("supplier", "nation"), "out", on=Pred("s_suppkey", "EQ", "n_nationkey"), project=cols("s_suppkey", "n_name"))],
        "SELECT s.s_suppkey, n.n_name FROM supplier s FULL JOIN nation n ON s.s_suppkey = n.n_nationkey",
    ),
    "filter_is_not_null": (
        [
            Stage("LEFT_OUTER_JOIN", ("supplier", "nation"), "both", on=Pred("s_suppkey", "EQ", "n_nationkey"), project=cols("s_suppkey", "n_name")),
            Stage("FILTER", ("both",), "out", where=Pred("n_name", "ISNOT")),
        ],
        "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_suppkey = n.n_nationkey WHERE n.n_name IS NOT NULL",
    ),
    "filter_not": (
        [
            Stage(
                "FULL_SCAN",
                ("orders",),
                "out",
                where=["NOT", "(", Pred("o_orderpriority", "EQ", s("5-LOW")), "OR", Pred("o_totalprice", "LT", i(200000)), ")"],
                project=cols("o_orderkey"),
            )
        ],
        "SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '5-LOW' OR o_totalprice < 200000)",
    ),
    "expr_trim": (
        [
            Stage(
                "FULL_SCAN",
                ("nation",),
                "out",
                project=tuple(Proj(f.lower(), [s("  "), c("n_name"), op("||"), s(" "), op("||"), op(f)]) for f in ("TRIM", "LTRIM", "RTRIM")),
            )
        ],
        "SELECT trim('  ' || n_name || ' ') AS trim, ltrim('  ' || n_name || ' ') AS ltrim, rtrim('  ' || n_name || ' ') AS rtrim FROM nation",
    ),
    "expr_literals": (
        [
            Stage(
                "FULL_SCAN",
                ("region",),
                "out",
                project=(
                    *cols("r_name"),
                    Proj("t", Tok("TIMESTAMP", "2024-02-29 12:34:56")),
                    Proj("yes", Tok("BOOLEAN", "true")),
                    Proj("tiny", [Tok("INT8", 7), INT]),
                    Proj("small", [Tok("INT16", -300), INT]),
                ),
            )
        ],
        "SELECT r_name, TIMESTAMP '2024-02-29 12:34:56' AS t, TRUE AS yes, 7 AS tiny, -300 AS small FROM region",
    ),
    "union_all": (
        [Stage("FULL_SCAN", ("supplier",), "a", project=(Proj("k", "s_nationkey"),)), Stage("FULL_SCAN", ("customer",), "b", project=(Proj("k", "c_nationkey"),)), Stage("UNION", ("a", "b"), "out")],
        "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer",
    ),
    "union_distinct": (
        [Stage("FULL_SCAN", ("supplier",), "a", project=(Proj("k", "s_nationkey"),)), Stage("FULL_SCAN", ("customer",), "b", project=(Proj("k", "c_nationkey"),)), Stage("UNION", ("a", "b"), "out", distinct=True)],
        "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey AS k FROM customer",
    ),
    "block_filter": (
        [Stage("BLOCK_FILTER", ("customer",), "kept", where=[Pred("c_mktsegment", "EQ", s("BUILDING")), Pred("c_acctbal", "GE", i(0))], mask=("c_custkey", "c_mktsegment"), project=cols("c_custkey", "c_name", "c_mktsegment"))],
        "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_mktsegment FROM customer WHERE RTRIM(c_mktsegment) = 'BUILDING' AND c_acctbal >= 0",
    ),
    "q11_shape": (
        [
            Stage("AGGREGATION", ("lineitem",), "by_supplier", group_by=("l_suppkey",), project=(*cols("l_suppkey"), total("v", c("l_extendedprice"), MONEY))),
            Stage("AGGREGATION", ("by_supplier",), "whole", project=(total("all_v", c("v")),)),
            Stage("INNER_JOIN", ("by_supplier", "whole"), "both", on=Pred("v", "GT", [c("all_v"), dec("0.0105", 10, 4), op("*")]), project=(Proj("l_suppkey", "l_suppkey"), Proj("v", [c("v"), WIDE]))),
        ],
        "SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS v FROM lineitem GROUP BY l_suppkey HAVING SUM(CAST(l_extendedprice AS DECIMAL(15,2))) > (SELECT SUM(CAST(l_extendedprice AS DECIMAL(15,2))) * CAST(0.0105 AS DECIMAL(10,4)) FROM lineitem)",
    ),
    "q12_shape": (
        [
            Stage("FULL_SCAN", ("lineitem",), "shipped", where=within("l_shipdate", "1996-01-01", "1997-01-01"), project=cols("l_orderkey", "l_returnflag")),
            Stage("INNER_JOIN", ("orders", "shipped"), "joined", on=Pred("o_orderkey", "EQ", "l_orderkey"), project=cols("l_returnflag", "o_orderpriority")),
            Stage("AGGREGATION", ("joined",), "out", group_by=("l_returnflag",), project=(*cols("l_returnflag"), total("high", *HIGH), total("low", *LOW)), order_by=(("l_returnflag", "ASC"),)),
        ],
        "SELECT l.l_returnflag, CAST(SUM(CASE WHEN o.o_orderpriority = '1-URGENT' OR o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(SUM(CASE WHEN o.o_orderpriority <> '1-URGENT' AND o.o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate >= DATE '1996-01-01' AND l.l_shipdate < DATE '1997-01-01' GROUP BY l.l_returnflag",
    ),
    "q14_shape": (
        [
            Stage("FULL_SCAN", ("lineitem",), "shipped", where=within("l_shipdate", "1996-01-01", "1996-02-01")),
            Stage("INNER_JOIN", ("shipped", "part"), "sums", on=Pred("l_partkey", "EQ", "p_partkey"), project=(total("promo_v", CASE, WHEN, c("p_type"), s("PROMO%"), op("LIKE"), THEN, *DISCOUNTED, ELSE, dbl(0.0), END), total("all_v", *DISCOUNTED))),
            Stage("AGGREGATION", ("sums",), "out", project=(Proj("promo", [dbl(100.0), c("promo_v"), op("*"), c("all_v"), op("/"), i(4), op("ROUND")]),)),
        ],
        "SELECT ROUND(100.00 * SUM(CASE WHEN p.p_type LIKE 'PROMO%' THEN l.l_extendedprice * (1 - l.l_discount) ELSE 0 END) / SUM(l.l_extendedprice * (1 - l.l_discount)), 4) AS promo FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_shipdate >= DATE '1996-01-01' AND l.l_shipdate < DATE '1996-02-01'",
    ),
}


def run_plan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Pipeline(Catalog(spark, sf_dir)).run(PLANS[name][0])


def wal_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order is deleted, every hundredth comes back with its insert."""
    orders = Catalog(spark, sf_dir).table("orders").select("o_orderkey", "o_totalprice")
    return overlay(orders, "o_orderkey", orders.where("o_orderkey % 10 = 0"), orders.where("o_orderkey % 100 = 0"))


def scan_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the listed files of a table: here all that there are, by name."""
    cat = Catalog(spark, sf_dir)
    files = [path.rpartition("/")[2] for path in cat.metadata("part")["files"]]
    return cat.subset("part", files).select("p_partkey", "p_name")


def placement_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, the suppliers of their nation as nodes; large accounts have one replica."""
    cat = Catalog(spark, sf_dir)
    customer, supplier = cat.table("customer"), cat.table("supplier")
    large = F.col("c_acctbal") > 9000
    nodes = supplier.select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("node"))
    files = customer.select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("group"), large.alias("large"))
    one = files.where("large").join(nodes.groupBy("group").agg(F.min("node").alias("node")), "group").groupBy("file").agg(F.min("node").alias("node"))
    return best_replicas(one, supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score")), (files.where("not large"), nodes))


PLACEMENT_SQL = """
WITH near AS (SELECT c_custkey AS file, s_suppkey AS node, c_acctbal FROM customer JOIN supplier ON c_nationkey = s_nationkey),
replicas AS (SELECT file, node FROM near WHERE c_acctbal <= 9000 UNION SELECT file, min(node) FROM near WHERE c_acctbal > 9000 GROUP BY file),
counted AS (SELECT file, node, count(*) OVER (PARTITION BY file) AS choices FROM replicas),
forced AS (SELECT node, count(*) + 1 AS penalty FROM counted WHERE choices = 1 GROUP BY node),
scored AS (SELECT c.file, c.node, coalesce(s.s_acctbal, 0.0) / CASE WHEN choices > 1 THEN coalesce(f.penalty, 1) ELSE 1 END AS score
           FROM counted c LEFT JOIN supplier s ON c.node = s.s_suppkey LEFT JOIN forced f ON c.node = f.node)
SELECT file, node, score FROM scored QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, node) = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run_plan(name) for name in PLANS} | {"wal_overlay": wal_overlay, "scan_file_list": scan_file_list, "placement_ranking": placement_ranking}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items()} | {
        "wal_overlay": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 100 = 0",
        "scan_file_list": "SELECT p_partkey, p_name FROM part",
        "placement_ranking": PLACEMENT_SQL,
    }
