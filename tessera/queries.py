"""The driver's query set: statements of the dialect over the Parquet tables, each with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expressions as ex
from tessera.operators import dml
from tessera.plans.compiler import ROWID, Compiler, Scope
from tessera.sources.store import duplicates, prefix_averages
from tessera.sql.parser import parse

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")


def table_of(spark: SparkSession, sf_dir: str) -> Callable[[str], tuple[str, DataFrame]]:
    """External tables by name: ``sf_dir/name.parquet``, opened when a statement names them."""
    return lambda name: (name, spark.read.parquet(f"{sf_dir}/{name.lower()}.parquet"))


def run(spark: SparkSession, sf_dir: str, sql: str, names: str, params: tuple = (), **options) -> DataFrame:
    """A SELECT over external tables, its columns named by ``names``."""
    made = Compiler(table_of(spark, sf_dir), params, **options).select(parse(sql))
    return made.df.toDF(*names.split())


#: name: (statement, output names, SQL for DuckDB, parameters)
SELECTS: dict[str, tuple] = {
    "scan_project": ("SELECT n_name, n_regionkey FROM nation", "n_name n_regionkey", "SELECT n_name, n_regionkey FROM nation"),
    "select_star": ("SELECT * FROM region", "r_regionkey r_name", "SELECT * FROM region"),
    "filter_compare": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_discount >= 0.05 AND l_tax != 0.02 AND l_linenumber < 5 AND l_linenumber <= 4",
        "l_orderkey l_linenumber l_quantity",
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_discount >= 0.05 AND l_tax <> 0.02 AND l_linenumber < 5 AND l_linenumber <= 4",
    ),
    "filter_and_or_not": (
        "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3) OR c_custkey = 1",
        "c_custkey", "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3) OR c_custkey = 1",
    ),
    "filter_isnull": (
        "SELECT d.doc_id, l.quality IS NULL FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.toxic IS NOT NULL",
        "doc_id missing", "SELECT d.doc_id, CAST(l.quality IS NULL AS BIGINT) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.toxic IS NOT NULL",
    ),
    "truthy_where": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2", "l_orderkey l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 <> 0"),
    "truthy_text": ("SELECT c_custkey FROM customer WHERE c_name OR c_custkey = 7", "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey = 7"),
    "like_prefix": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'sTaN%'", "p_partkey p_type", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE 'stan%'"),
    "like_suffix": ("SELECT c_custkey FROM customer WHERE c_name LIKE '%7'", "c_custkey", "SELECT c_custkey FROM customer WHERE c_name LIKE '%7'"),
    "like_underscore": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_1'", "p_partkey", "SELECT p_partkey FROM part WHERE lower(p_brand) LIKE 'brand#_1'"),
    "like_case": ("SELECT c_custkey, c_mktsegment LIKE 'b%G' FROM customer", "c_custkey hit", "SELECT c_custkey, CAST(lower(c_mktsegment) LIKE 'b%g' AS BIGINT) AS hit FROM customer"),
    "arith_int": ("SELECT l_orderkey, l_linenumber, l_orderkey * 2 + l_linenumber - 7 FROM lineitem", "l_orderkey l_linenumber v", "SELECT l_orderkey, l_linenumber, l_orderkey * 2 + l_linenumber - 7 AS v FROM lineitem"),
    "arith_real": ("SELECT s_suppkey, s_acctbal * 2 + 0.5, s_acctbal / 4 FROM supplier", "s_suppkey v w", "SELECT s_suppkey, s_acctbal * 2 + CAST(0.5 AS DOUBLE) AS v, s_acctbal / 4 AS w FROM supplier"),
    "int_div_trunc": ("SELECT o_orderkey, (o_custkey - 700) / 7 FROM orders", "o_orderkey v", "SELECT o_orderkey, CAST(trunc((o_custkey - 700) / 7.0) AS BIGINT) AS v FROM orders"),
    "int_mod": ("SELECT o_orderkey, (o_custkey - 700) % 7 FROM orders", "o_orderkey v", "SELECT o_orderkey, (o_custkey - 700) % 7 AS v FROM orders"),
    "real_mod_trunc": ("SELECT s_suppkey, s_acctbal % 7 FROM supplier", "s_suppkey v", "SELECT s_suppkey, CAST(CAST(trunc(s_acctbal) AS BIGINT) % 7 AS DOUBLE) AS v FROM supplier"),
    "div_zero_null": (
        "SELECT p_partkey, p_size / (p_size - p_size), p_retailprice / 0, p_size % 0, p_size / 0 IS NULL FROM part",
        "p_partkey a b c d", "SELECT p_partkey, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS BIGINT) AS c, CAST(1 AS BIGINT) AS d FROM part",
    ),
    "unary_minus": ("SELECT s_suppkey, -s_acctbal, +s_nationkey, - - s_suppkey FROM supplier", "s_suppkey a b c", "SELECT s_suppkey, -s_acctbal AS a, s_nationkey AS b, s_suppkey AS c FROM supplier"),
    "bool_projection": (
        "SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus = 'O', NOT o_custkey = 3 FROM orders",
        "o_orderkey a b", "SELECT o_orderkey, CAST(o_totalprice > 1000 AND o_orderstatus = 'O' AS BIGINT) AS a, CAST(NOT o_custkey = 3 AS BIGINT) AS b FROM orders",
    ),
    "cross_class_compare": ("SELECT c_custkey, c_custkey < c_name, c_name = 1 FROM customer", "c_custkey a b", "SELECT c_custkey, CAST(1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM customer"),
    "three_valued": (
        "SELECT d.doc_id, l.quality = 1 AND d.n_chars > 500, l.quality = 1 OR d.n_chars > 500, NOT l.quality = 1 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "doc_id a b c",
        "SELECT d.doc_id, CAST(l.quality = 1 AND d.n_chars > 500 AS BIGINT) AS a, CAST(l.quality = 1 OR d.n_chars > 500 AS BIGINT) AS b, CAST(NOT l.quality = 1 AS BIGINT) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "point_lookup": ("SELECT * FROM orders WHERE o_orderkey = ?", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "SELECT * FROM orders WHERE o_orderkey = 77", (77,)),
    "range_sandwich": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < ?", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900", (900,)),
    "composite_prefix": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 32 AND l_linenumber > 1", "l_orderkey l_linenumber l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 32 AND l_linenumber > 1"),
    "contradiction": ("SELECT o_orderkey FROM orders WHERE o_custkey = 1 AND o_custkey = 2", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey = 1 AND o_custkey = 2"),
    "global_agg": (
        "SELECT COUNT(*), SUM(l_linenumber), MIN(l_quantity), MAX(l_quantity), SUM(l_quantity) FROM lineitem",
        "n s lo hi q", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS q FROM lineitem",
    ),
    "count_star_vs_col": ("SELECT COUNT(*), COUNT(l.doc_id), COUNT(l.quality) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "a b c", "SELECT count(*) AS a, count(l.doc_id) AS b, count(l.quality) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "agg_empty": ("SELECT COUNT(*), SUM(o_custkey), AVG(o_custkey), MIN(o_orderpriority) FROM orders WHERE o_orderkey < 0", "n s a m", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, avg(o_custkey) AS a, min(o_orderpriority) AS m FROM orders WHERE o_orderkey < 0"),
    "avg_int": ("SELECT o_orderstatus, AVG(o_custkey) + 0 FROM orders GROUP BY o_orderstatus", "o_orderstatus a", "SELECT o_orderstatus, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS a FROM orders GROUP BY o_orderstatus"),
    "min_max_text": ("SELECT MIN(c_name), MAX(c_mktsegment) FROM customer", "lo hi", "SELECT min(c_name) AS lo, max(c_mktsegment) AS hi FROM customer"),
    "group_by_one": ("SELECT l_returnflag, COUNT(*) FROM lineitem GROUP BY l_returnflag", "l_returnflag n", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "group_by_multi": (
        "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity), SUM(l_linenumber) FROM lineitem WHERE l_linenumber < 6 GROUP BY l_returnflag, l_linestatus",
        "l_returnflag l_linestatus n q s",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_linenumber < 6 GROUP BY l_returnflag, l_linestatus",
    ),
    "group_by_expr": ("SELECT COUNT(*), MIN(o_orderkey) FROM orders GROUP BY o_custkey % 10", "n lo", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders GROUP BY o_custkey % 10"),
    "group_by_constant": ("SELECT COUNT(*) FROM orders GROUP BY 1", "n", "SELECT count(*) AS n FROM orders"),
    "group_by_no_agg": ("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", "a b", "SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders"),
    "agg_in_expression": ("SELECT o_orderstatus, SUM(o_custkey) + COUNT(*) * 2 FROM orders GROUP BY o_orderstatus", "o_orderstatus v", "SELECT o_orderstatus, CAST(sum(o_custkey) + count(*) * 2 AS BIGINT) AS v FROM orders GROUP BY o_orderstatus"),
    "having": ("SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14", "o_custkey n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14"),
    "having_unselected_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_orderkey) - MIN(o_orderkey) > 14000", "o_custkey", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_orderkey) - min(o_orderkey) > 14000"),
    "order_by_unselected_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 12", "o_custkey", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 12"),
    "distinct_one": ("SELECT DISTINCT l_returnflag FROM lineitem", "l_returnflag", "SELECT DISTINCT l_returnflag FROM lineitem"),
    "distinct_multi": ("SELECT DISTINCT l_returnflag, l_linenumber % 3 FROM lineitem ORDER BY l_linenumber % 3", "l_returnflag v", "SELECT DISTINCT l_returnflag, CAST(l_linenumber % 3 AS BIGINT) AS v FROM lineitem"),
    "order_by_multi_dir": ("SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40", "o_orderpriority o_orderkey", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40"),
    "order_by_ordinal": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 DESC LIMIT 30", "o_custkey o_orderkey", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 DESC LIMIT 30"),
    "order_by_hidden": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 25", "o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "topk": ("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", "p_partkey p_retailprice", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10"),
    "limit_offset": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT ? OFFSET 5", "p_partkey", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 15 OFFSET 5", (15,)),
    "offset_only": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", "n_nationkey", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000", "o_orderkey c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"),
    "join_three": (
        "SELECT s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey",
        "s_name n_name r_name", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_comma": ("SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 1", "c_custkey n_name", "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 1"),
    "join_theta": ("SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", "n_name r_name", "SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey"),
    "join_self": ("SELECT a.n_name, b.n_name FROM nation a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "x y", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_cross_small": ("SELECT a.r_name, b.r_name FROM region a, region b", "x y", "SELECT a.r_name AS x, b.r_name AS y FROM region a, region b"),
    "left_join": ("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "doc_id quality toxic", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "left_join_on_filter": ("SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "c_custkey o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "left_join_where_nullable": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0", "doc_id", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0"),
    "left_join_anti": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL", "doc_id", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL"),
    "group_by_null_key": ("SELECT l.quality, COUNT(*), COUNT(l.quality) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", "quality n m", "SELECT l.quality, count(*) AS n, count(l.quality) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality"),
    "order_nulls_first": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id LIMIT 20", "doc_id quality",
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 20",
    ),
    "order_nulls_last_desc": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id DESC LIMIT 500", "doc_id quality",
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id DESC LIMIT 500",
    ),
    "join_group_having_order": (
        "SELECT c.c_name, COUNT(*), SUM(o.o_custkey) FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_name HAVING COUNT(*) > 12 ORDER BY COUNT(*) DESC, c.c_name LIMIT 20",
        "c_name n s", "SELECT c.c_name, count(*) AS n, CAST(sum(o.o_custkey) AS BIGINT) AS s FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_name HAVING count(*) > 12 ORDER BY n DESC, c.c_name LIMIT 20",
    ),
    "opaque_columns": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL AND o_orderkey < 50", "o_orderkey o_orderdate", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 50"),
}


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    statement, names, _, *params = SELECTS[name]
    return lambda spark, sf_dir: run(spark, sf_dir, statement, names, *params)


def _scoped(spark: SparkSession, sf_dir: str, table: str) -> tuple[DataFrame, list[Scope], Compiler]:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df, [Scope(table, [(f.name, f"`{f.name}`", ex.kind_of(f.dataType)) for f in df.schema])], Compiler(table_of(spark, sf_dir))


def dml_update_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier after UPDATE supplier SET s_acctbal = s_suppkey, s_suppkey = s_suppkey + 1000 WHERE s_acctbal < 0."""
    df, scopes, c = _scoped(spark, sf_dir, "supplier")
    made = parse("UPDATE supplier SET s_acctbal = s_suppkey, s_suppkey = s_suppkey + 1000 WHERE s_acctbal < 0")
    types = dict(df.dtypes)
    sets = {name: c.expr(e, scopes).column.cast(types[name]) for name, e in made.sets}
    return dml.updated(df, sets, c.condition(made.where, scopes))


def dml_delete_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation after DELETE FROM nation WHERE n_regionkey = 2 OR n_name LIKE 'a%'."""
    df, scopes, c = _scoped(spark, sf_dir, "nation")
    return dml.deleted(df, c.condition(parse("DELETE FROM nation WHERE n_regionkey = 2 OR n_name LIKE 'a%'").where, scopes))


def insert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region after INSERT INTO region VALUES (5, 'OCEANIA')."""
    df, _, c = _scoped(spark, sf_dir, "region")
    made = parse("INSERT INTO region VALUES (5, 'OCEANIA')")
    row = spark.range(1).select(*(ex.literal(c.constant(v)).column.cast(kind).alias(name) for v, (name, kind) in zip(made.values, df.dtypes, strict=True)))
    return df.unionByName(row)


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that CREATE UNIQUE INDEX ON orders (o_custkey, o_orderpriority) would refuse."""
    return duplicates(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey", "o_orderpriority"])


def update_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that UPDATE nation SET n_nationkey = n_nationkey + 1 finds taken under UNIQUE, row by row."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn(ROWID, F.col("n_nationkey").cast("long"))
    new = dml.updated(df, {"n_nationkey": (F.col("n_nationkey") + 1).cast("int")}, None)
    return dml.update_conflicts(df, new, ["n_nationkey"]).toDF("n_nationkey")


def analyze_prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ANALYZE finds for lineitem (l_returnflag, l_linestatus, l_linenumber)."""
    rows, *averages = prefix_averages(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return spark.createDataFrame([(rows, *averages)], "total long, a long, b long, c long")


VIEWS = {f.__name__: f for f in (dml_update_view, dml_delete_view, insert_view, unique_violations, update_conflicts, analyze_prefix_stats)}
VIEW_SQL = {
    "dml_update_view": "SELECT CASE WHEN s_acctbal < 0 THEN s_suppkey + 1000 ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN CAST(s_suppkey AS DOUBLE) ELSE s_acctbal END AS s_acctbal FROM supplier",
    "dml_delete_view": "SELECT * FROM nation WHERE NOT (n_regionkey = 2 OR lower(n_name) LIKE 'a%')",
    "insert_view": "SELECT * FROM region UNION ALL SELECT 5::INTEGER, 'OCEANIA'",
    "unique_violations": "SELECT o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1",
    "update_conflicts": "SELECT n_nationkey FROM nation WHERE n_nationkey > (SELECT min(n_nationkey) FROM nation)",
    "analyze_prefix_stats": (
        "SELECT count(*) AS total, CAST(ceil(count(*) / count(DISTINCT l_returnflag)) AS BIGINT) AS a, CAST(ceil(count(*) / count(DISTINCT (l_returnflag, l_linestatus))) AS BIGINT) AS b,"
        " CAST(ceil(count(*) / count(DISTINCT (l_returnflag, l_linestatus, l_linenumber))) AS BIGINT) AS c FROM lineitem"
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _select(name) for name in SELECTS} | VIEWS


def oracle_sql() -> dict[str, str]:
    return {name: s[2] for name, s in SELECTS.items()} | VIEW_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["join_group_having_order"](spark, sf_dir)
