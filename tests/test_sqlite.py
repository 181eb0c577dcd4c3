"""The dialect against SQLite, where the two agree: expressions, NULLs, joins and groups."""

import itertools
import sqlite3

import pytest

from tessera import errors
from tessera.session import connect

INTS = [None, 0, 1, -1, 7, -7, 2, 3]
REALS = [None, 0.0, 7.5, -7.5, 2.0, 0.5]
TEXTS = [None, "", "abc", "ABC", "a_c", "é", "É", "a%c", ".*", "\\", "x\ny"]
LEFT = [(1, 1, 10), (2, 2, 20), (3, None, 30), (4, 4, None), (5, 5, 50)]
RIGHT = [(1, 1, 100), (2, 2, None), (3, None, 300), (4, 6, 400)]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    lite = sqlite3.connect(":memory:")
    pairs = [(k, *p) for k, p in enumerate(itertools.product(INTS, INTS))]
    reals = [(k, *p) for k, p in enumerate(itertools.product(REALS, REALS))]
    texts = [(k, *p) for k, p in enumerate(itertools.product(TEXTS, TEXTS))]
    made = {
        "ints": ("id bigint, a bigint, b bigint", pairs), "reals": ("id bigint, a double, b double", reals),
        "texts": ("id bigint, a string, b string", texts), "left_t": ("id bigint, key bigint, val bigint", LEFT),
        "right_t": ("id bigint, key bigint, val bigint", RIGHT),
    }
    frames = {}
    for name, (schema, rows) in made.items():
        frames[name] = spark.createDataFrame(rows, schema)
        kinds = schema.replace("bigint", "INTEGER").replace("double", "REAL").replace("string", "TEXT")
        lite.execute(f"CREATE TABLE {name} ({kinds})")
        lite.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", rows)
    con = connect(str(tmp_path_factory.mktemp("db")), spark, tables=frames)
    yield con, lite
    con.close()


CASES = [
    *(f"SELECT id, a {op} b FROM ints ORDER BY id" for op in "+ - * / % < <= > >= = != <>".split()),
    *(f"SELECT id, a {op} b FROM reals ORDER BY id" for op in "+ - * / < = !=".split()),
    "SELECT id, a LIKE b FROM texts ORDER BY id",
    "SELECT id, a AND b, a OR b, NOT a, -a, + b FROM ints ORDER BY id",
    "SELECT id FROM ints WHERE a ORDER BY id",
    "SELECT id FROM ints WHERE NOT a OR b IS NULL ORDER BY id",
    "SELECT id, a < b, a = b FROM texts ORDER BY id",
    "SELECT a, COUNT(*), COUNT(b), SUM(b), AVG(b), MIN(b), MAX(b) FROM ints GROUP BY a ORDER BY a",
    "SELECT COUNT(*), SUM(a), MIN(a) FROM ints WHERE id < 0",
    "SELECT DISTINCT a FROM ints ORDER BY a DESC",
    "SELECT a, b FROM ints ORDER BY b DESC, a LIMIT 5 OFFSET 3",
    "SELECT a FROM ints GROUP BY a HAVING COUNT(b) > 6 ORDER BY a",
    *(
        f"SELECT l.id, l.key, r.id, r.val FROM left_t l {kind} JOIN right_t r ON l.key {op} r.key{extra} ORDER BY l.id, r.id"
        for kind in ("INNER", "LEFT") for op in ("=", "<", "!=") for extra in ("", " AND r.val > 100", " WHERE r.val IS NULL", " WHERE l.val > 10 OR r.id = 1")
    ),
    "SELECT l.id, r.id FROM left_t l, right_t r WHERE l.key = r.key AND l.val < r.val ORDER BY l.id, r.id",
]


@pytest.mark.parametrize("sql", CASES)
def test_same_as_sqlite(both, sql):
    con, lite = both
    fold = lambda rows: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    assert fold(con.execute(sql).fetchall()) == fold(lite.execute(sql).fetchall())


@pytest.mark.parametrize(("sql", "error"), [
    ("SELECT a + 'x' FROM ints", errors.TypeMismatchError), ("SELECT id LIKE '3' FROM ints", errors.TypeMismatchError),
    ("SELECT SUM(a) FROM texts", errors.TypeMismatchError), ("SELECT zz FROM ints", errors.ColumnNotFoundError),
    ("SELECT a FROM nowhere", errors.TableNotFoundError), ("SELECT id FROM left_t l JOIN right_t r ON l.id = r.id", errors.AmbiguousColumnError),
    ("SELECT a, COUNT(*) FROM ints", errors.AggregateError), ("SELECT * FROM ints GROUP BY a", errors.AggregateError),
    ("SELECT SUM(*) FROM ints", errors.AggregateError), ("SELECT a FROM ints HAVING a > 1", errors.AggregateError),
    ("SELECT UPPER(a) FROM texts", errors.UnsupportedFeatureError), ("SELECT a FROM ints WHERE COUNT(*) > 1", errors.UnsupportedFeatureError),
    ("SELECT a FROM ints ORDER BY 3", errors.ColumnNotFoundError), ("SELECT DISTINCT a FROM ints ORDER BY b", errors.UnsupportedFeatureError),
    ("SELECT a FROM ints WHERE a < b < 3", errors.SQLSyntaxError), ("SELECT a FROM ints LIMIT -1", errors.SQLSyntaxError),
    ("SELECT a FROM", errors.SQLSyntaxError), ("SELECT TRUE FROM ints", errors.SQLSyntaxError), ("SELECT a FROM ints WHERE a = ?", errors.ParameterCountError),
    ("SELECT 9223372036854775807 + id FROM ints WHERE id = 5", errors.IntegerOverflowError),
])
def test_errors(both, sql, error):
    with pytest.raises(error):
        both[0].execute(sql).fetchall()


def test_remainder_of_reals_and_exact_overflow(both, spark):
    con = both[0]
    assert con.execute("SELECT 7.5 % 2, -7.5 % 2, 7.5 % 0.5 FROM ints LIMIT 1").fetchone() == (1.0, -1.0, None)
    exact = connect(":memory:", spark, exact=True, tables={"one": spark.range(1)})
    assert exact.execute("SELECT 9223372036854775807 + 1 FROM one").fetchone() == (9.223372036854775807e18,)
    exact.close()


def test_strict_refuses_grouped_joins(spark):
    con = connect(":memory:", spark, strict=True, tables={"a": spark.range(2), "b": spark.range(2)})
    with pytest.raises(errors.UnsupportedFeatureError):
        con.execute("SELECT COUNT(*) FROM a JOIN b ON a.id = b.id")
    con.close()
