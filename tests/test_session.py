"""Managed tables, transactions, recovery, locks."""

import subprocess
import sys
import threading
from pathlib import Path

import pytest

from tessera import cli, errors
from tessera.locks import EXCLUSIVE, SHARED, LockManager
from tessera.session import connect
from tessera.sources.store import Store


@pytest.fixture
def con(spark, tmp_path):
    made = connect(str(tmp_path / "db"), spark)
    made.execute("CREATE TABLE users (id INTEGER, name TEXT, score REAL, raw BLOB)")
    with made.transaction():
        for row in ((1, "ada", 36, b"\x00\xff"), (2, "bob", 41.5, None), (3, "amy", None, b"")):
            assert made.execute("INSERT INTO users VALUES (?, ?, ?, ?)", row).rowcount == 1
    yield made
    made.close()


def test_rows_and_description(con):
    cur = con.execute("SELECT ID, name, score + 1 FROM Users WHERE id < 3 ORDER BY id")
    assert [d[0] for d in cur.description] == ["id", "name", "score + 1"]
    assert cur.fetchmany(1) == [(1, "ada", 37.0)] and cur.fetchall() == [(2, "bob", 42.5)]
    assert con.execute("SELECT raw FROM users ORDER BY id").fetchall() == [(b"\x00\xff",), (None,), (b"",)]
    assert con.execute("SELECT name FROM users LIMIT 2").fetchall() == [("ada",), ("bob",)]
    assert con.rows_examined > 0


def test_update_delete_and_row_ids(con):
    assert con.execute("UPDATE users SET score = id, id = id + 10 WHERE name LIKE 'A%'").rowcount == 2
    assert con.execute("SELECT id, score FROM users ORDER BY id").fetchall() == [(2, 41.5), (11, 1.0), (13, 3.0)]
    assert con.execute("DELETE FROM users WHERE score IS NULL OR id > 12").rowcount == 1
    assert con.execute("DELETE FROM users").rowcount == 2
    assert con.execute("SELECT COUNT(*) FROM users").fetchone() == (0,)
    with pytest.raises(errors.TypeMismatchError):
        con.execute("UPDATE users SET id = 'x'")


def test_unique(con):
    con.execute("CREATE UNIQUE INDEX by_name ON users (name)")
    with pytest.raises(errors.UniqueViolationError):
        con.execute("INSERT INTO users VALUES (9, 'ada', 1, NULL)")
    for _ in range(2):
        con.execute("INSERT INTO users VALUES (9, NULL, 1, NULL)")
    con.execute("CREATE UNIQUE INDEX by_score ON users (id, name)")
    con.execute("DELETE FROM users WHERE name IS NULL")
    con.execute("CREATE UNIQUE INDEX by_id ON users (id)")
    with pytest.raises(errors.UniqueViolationError):  # 1 becomes 2 while 2 is still there
        con.execute("UPDATE users SET id = id + 1")
    assert con.execute("UPDATE users SET id = id - 1").rowcount == 3
    con.execute("UPDATE users SET name = 'ada' WHERE id = 9")
    with pytest.raises(errors.UniqueViolationError):
        con.execute("UPDATE users SET name = 'ada'")
    assert con.execute("SELECT id FROM users ORDER BY id").fetchall() == [(0,), (1,), (2,)]


@pytest.mark.parametrize(("sql", "error"), [
    ("CREATE TABLE USERS (a INTEGER)", errors.TableExistsError), ("CREATE TABLE sqlite_x (a INTEGER)", errors.CatalogError),
    ("CREATE TABLE t (a INTEGER, A TEXT)", errors.SQLSyntaxError), ("CREATE INDEX users ON users (id)", errors.IndexExistsError),
    ("CREATE INDEX i ON users (zz)", errors.ColumnNotFoundError), ("INSERT INTO users VALUES (1)", errors.ColumnCountError),
    ("INSERT INTO users VALUES ('1', 'x', 1, NULL)", errors.TypeMismatchError), ("INSERT INTO users VALUES (1 + 1, 'x', 1, NULL)", errors.UnsupportedFeatureError),
    ("UPDATE users SET zz = 1", errors.ColumnNotFoundError), ("DELETE FROM nowhere", errors.TableNotFoundError), ("COMMIT", errors.TransactionError),
])
def test_refusals_change_nothing(con, sql, error):
    with pytest.raises(error):
        con.execute(sql)
    assert con.execute("SELECT COUNT(*) FROM users").fetchone() == (3,)


def test_rollback_and_own_writes(con):
    con.execute("BEGIN IMMEDIATE")
    con.execute("INSERT INTO users VALUES (4, 'eve', -1, NULL)")
    con.execute("CREATE TABLE more (a INTEGER)")
    assert con.execute("SELECT COUNT(*) FROM users").fetchone() == (4,)
    con.execute("ROLLBACK")
    assert con.execute("SELECT COUNT(*) FROM users").fetchone() == (3,)
    with pytest.raises(errors.TableNotFoundError):
        con.execute("SELECT a FROM more")


def test_analyze_and_explain(con):
    con.execute("CREATE INDEX by_name ON users (name, id)")
    con.execute("ANALYZE")
    assert con.execute("SELECT tbl, idx, stat FROM engine_stat1").fetchall() == [("users", "by_name", "3 1 1")]
    plan = con.execute("EXPLAIN SELECT name, COUNT(*) FROM users WHERE id > 1 GROUP BY name HAVING COUNT(*) > 0 ORDER BY name LIMIT 1").fetchone()[0]
    assert "TakeOrderedAndProject" in plan and "HashAggregate" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in plan
    con.execute("ANALYZE users")
    told = con.execute("EXPLAIN ANALYZE SELECT id FROM users WHERE id > 1").fetchone()[0]
    assert "actual_rows=2" in told and "Scan parquet" in told
    with pytest.raises(errors.IntegerOverflowError):  # the statement itself runs
        con.execute("EXPLAIN ANALYZE SELECT id * 9223372036854775807 FROM users ORDER BY id")


def test_counters_tell_what_scans_read(con):
    con.reset_counters()
    assert con.execute("SELECT COUNT(*) FROM users").fetchall() == [(3,)]
    assert con.rows_examined == 3 and con.files_read == 1 and con.bytes_read > 0
    con.execute("SELECT a.id FROM users a JOIN users b ON a.id = b.id WHERE a.id + b.id > 99").fetchall()
    assert con.rows_examined == 6  # no row of one side is left, so the other isn't read
    con.execute("SELECT a.id FROM users a JOIN users b ON a.id = b.id").fetchall()
    assert con.rows_examined == 12
    con.reset_counters()
    assert (con.rows_examined, con.files_read, con.bytes_read) == (0, 0, 0)


def test_an_index_lets_lookups_and_ranges_pass_over_most_rows(spark, tmp_path):
    con = connect(str(tmp_path / "db"), spark)
    con.execute("CREATE TABLE t (k INTEGER, v TEXT)")
    store = con.database.store
    made = store.latest()
    rows = spark.range(200_000).selectExpr("id AS __rowid", "pmod(id * 7919, 200000) AS k", "uuid() AS v")
    made["tables"]["t"] |= {"parts": [store.write(rows.repartition(4))], "next": 200_001}
    store.publish(made)
    examined = []
    for _ in range(2):
        con.reset_counters()
        assert con.execute("SELECT k FROM t WHERE k = 123456").fetchall() == [(123456,)]
        assert con.execute("SELECT COUNT(*) FROM t WHERE k > 1000 AND k < 1100").fetchall() == [(99,)]
        examined.append(con.rows_examined)
        con.execute("CREATE INDEX by_k ON t (k)") if len(examined) == 1 else None
    assert examined[0] == 400_000 and examined[1] < 100_000
    con.execute("UPDATE t SET v = 'x' WHERE k < 10")
    con.reset_counters()
    assert con.execute("SELECT v FROM t WHERE k = 9").fetchall() == [("x",)] and con.rows_examined < 100_000
    con.close()


def test_small_parts_are_joined_and_large_ones_left_alone(spark, tmp_path, monkeypatch):
    con = connect(str(tmp_path / "db"), spark)
    con.execute("CREATE TABLE t (k INTEGER)")
    store = con.database.store
    made = store.latest()
    large = store.write(spark.range(50_000).selectExpr("id AS __rowid", "id AS k"))
    made["tables"]["t"] |= {"parts": [large], "next": 50_001}
    store.publish(made)
    monkeypatch.setattr("tessera.sources.store.MAX_PARTS", 3)
    monkeypatch.setattr("tessera.sources.store.SMALL", 10_000)
    for k in range(5):
        con.execute("INSERT INTO t VALUES (?)", (-k - 1,))
    parts = store.latest()["tables"]["t"]["parts"]
    assert large in parts and len(parts) <= 4
    assert con.execute("SELECT COUNT(*), MIN(k) FROM t").fetchall() == [(50_005, -5)]
    con.close()


def test_reopen_recovers(spark, con, tmp_path, capsys):
    root = tmp_path / "db"
    con.close()
    (root / "tables" / "part-lost").mkdir()
    (root / "_log" / ".tmp-x").write_text("{")
    assert cli.main(["inspect", str(root)]) == 0 and (root / "tables" / "part-lost").exists()
    again = connect(str(root), spark)
    assert again.execute("SELECT COUNT(*) FROM users").fetchone() == (3,)
    assert not (root / "tables" / "part-lost").exists() and not list((root / "_log").glob(".tmp*"))
    again.close()
    assert cli.main(["inspect", str(root)]) == 0 and "users" in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path)]) == 1


def test_a_damaged_newest_manifest_raises_and_deletes_nothing(spark, con, tmp_path, capsys):
    root = tmp_path / "db"
    con.close()
    newest = max((root / "_log").glob("*.json"), key=lambda p: int(p.stem))
    whole, before = newest.read_text(), sorted(root.rglob("*.parquet"))
    newest.write_text(whole[:40])
    for _ in range(2):
        with pytest.raises(errors.CorruptDatabaseError):
            connect(str(root), spark)
    assert cli.main(["inspect", str(root)]) == 1 and "can't be read" in capsys.readouterr().err
    assert sorted(root.rglob("*.parquet")) == before and before
    newest.write_text(whole)
    again = connect(str(root), spark)
    assert again.execute("SELECT COUNT(*) FROM users").fetchone() == (3,)
    again.execute("INSERT INTO users VALUES (4, 'eve', -1, NULL)")
    again.close()


def test_inspecting_leaves_an_open_transaction_able_to_commit(con, tmp_path, capsys):
    con.execute("BEGIN")
    con.execute("UPDATE users SET id = id + 100")
    assert cli.main(["inspect", str(tmp_path / "db")]) == 0 and "next row 4" in capsys.readouterr().out
    con.execute("COMMIT")
    assert con.execute("SELECT MIN(id) FROM users").fetchone() == (101,)


def test_one_process_at_a_time(con, tmp_path):
    script = f"import sys; sys.path.insert(0, {str(Path(cli.__file__).parent.parent)!r}); from tessera.sources.store import Store; Store({str(tmp_path / 'db')!r})"
    refused = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True)
    assert refused.returncode == 1 and "is open in another process" in refused.stderr
    con.execute("INSERT INTO users VALUES (4, 'eve', -1, NULL)")
    con.close()
    assert subprocess.run([sys.executable, "-c", script], capture_output=True).returncode == 0


def test_a_lost_part_stops_the_commit(con, tmp_path):
    con.execute("BEGIN")
    con.execute("INSERT INTO users VALUES (4, 'eve', -1, NULL)")
    part = con.database.store.latest()["tables"]["users"]["parts"][0]
    (tmp_path / "db" / "tables" / part).rename(tmp_path / "elsewhere")
    with pytest.raises(errors.CorruptDatabaseError):
        con.execute("COMMIT")
    (tmp_path / "elsewhere").rename(tmp_path / "db" / "tables" / part)
    assert con.execute("SELECT COUNT(*) FROM users").fetchone() == (3,)


@pytest.mark.parametrize(("sql", "want"), [("1e300 % 7", 1e300 % 7), ("-7.5 % 2", -1.0), ("7.5 % -2.9", 1.0), ("5.0 % 0.5", None), ("-4.0 % 2", 0.0), ("9e18 % 10", 0.0)])
def test_real_remainders_of_any_size(con, sql, want):
    assert con.execute(f"SELECT {sql} FROM users WHERE id = 1").fetchall() == [(want,)]


def test_an_update_to_one_value_is_found_without_pairing_rows(spark):
    from tessera.operators import dml

    old = spark.range(300_000).selectExpr("id AS __rowid", "id AS k")
    new = old.selectExpr("__rowid", "CAST(5 AS BIGINT) AS k")
    assert [tuple(r) for r in dml.update_conflicts(old, new, ["k"]).collect()] == [(5,)]


def test_errors_name_their_cause(con):
    from py4j.protocol import Py4JJavaError
    from tessera.session import translated

    with pytest.raises(Py4JJavaError) as e:
        con.spark._jvm.java.util.ArrayList().get(3)
    assert "Index 3 out of bounds" in str(translated(e.value))


def test_a_crash_before_the_link_changes_nothing(spark, con, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        con.execute("DELETE FROM users")
    monkeypatch.undo()
    assert con.execute("SELECT COUNT(*) FROM users").fetchone() == (3,)


def test_threads_and_writers(spark, con):
    other = con.database.connect(spark)
    seen = []

    def elsewhere():
        try:
            con.execute("SELECT id FROM users")
        except errors.ThreadingError as e:
            seen.append(e)

    t = threading.Thread(target=elsewhere)
    t.start()
    t.join()
    assert seen
    con.execute("BEGIN IMMEDIATE")
    con.execute("UPDATE users SET id = id + 100")
    other.busy_timeout = 0.2
    with pytest.raises(errors.LockTimeoutError):
        other.execute("SELECT id FROM users")
    con.execute("COMMIT")
    assert other.execute("SELECT MIN(id) FROM users").fetchone() == (101,)
    other.close()


def test_transfers_keep_the_sum(spark, tmp_path):
    con = connect(str(tmp_path / "bank"), spark)
    con.execute("CREATE TABLE accounts (id INTEGER, balance INTEGER)")
    with con.transaction():
        for k in range(4):
            con.execute("INSERT INTO accounts VALUES (?, 100)", (k,))

    def work(a, b):
        own = con.database.connect(spark)
        own.busy_timeout = 120
        for _ in range(2):
            own.execute("BEGIN IMMEDIATE")
            own.execute("UPDATE accounts SET balance = balance - 5 WHERE id = ?", (a,))
            own.execute("UPDATE accounts SET balance = balance + 5 WHERE id = ?", (b,))
            own.execute("COMMIT")
        own.close()

    threads = [threading.Thread(target=work, args=(k, (k + 1) % 4)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert con.execute("SELECT SUM(balance), MIN(balance) FROM accounts").fetchone() == (400, 90)
    con.close()


def test_locks_share_queue_upgrade_and_break_deadlocks():
    locks = LockManager()
    locks.acquire(1, "a", SHARED)
    locks.acquire(2, "a", SHARED)
    with pytest.raises(errors.LockTimeoutError):
        locks.acquire(3, "a", EXCLUSIVE, 0.05)
    locks.release_all(2)
    locks.acquire(1, "a", EXCLUSIVE)
    locks.acquire(2, "b", EXCLUSIVE)
    failed = []

    def wait(txn, resource):
        try:
            locks.acquire(txn, resource, EXCLUSIVE, 5)
        except errors.DeadlockError as e:
            failed.append((txn, e.victim, set(e.cycle)))
            locks.release_all(txn)

    threads = [threading.Thread(target=wait, args=a) for a in ((1, "b"), (2, "a"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == [(2, 2, {1, 2})] and locks.held["b"] == {1: EXCLUSIVE}
