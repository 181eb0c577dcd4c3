"""Typed scalar expressions as Spark columns, with the dialect's rules for NULL, types and division.

A Typed pairs a column with its static type: INTEGER, REAL, TEXT, BLOB, NULL, BOOL (comparisons, logic) or
OPAQUE (pass-through types of external tables). All columns are built-in expressions, so they are pushed
down and compiled like any others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import TypeMismatchError

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANK = {"INTEGER": 1, "REAL": 1, "BOOL": 1, "TEXT": 2, "BLOB": 3}
SPARK_TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str


def kind_of(data_type: T.DataType) -> str:
    """The dialect's type of a Spark type."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "REAL"
    if isinstance(data_type, T.StringType):
        return "TEXT"
    return "BLOB" if isinstance(data_type, T.BinaryType) else "OPAQUE"


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "NULL")
    if isinstance(value, bool):
        raise TypeMismatchError("booleans are not values")
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            return Typed(F.lit(float(value)), "REAL")
        return Typed(F.lit(value).cast("bigint"), "INTEGER")
    for kind, own in ((float, "REAL"), (str, "TEXT"), (bytes, "BLOB")):
        if isinstance(value, kind):
            return Typed(F.lit(value), own)
    raise TypeMismatchError(f"{type(value).__name__} is not a value")


def truth(e: Typed) -> Column:
    """``e`` as a condition: numbers other than 0 are true, text and blobs false."""
    if e.kind == "BOOL":
        return e.column
    if e.kind == "NULL":
        return F.lit(None).cast("boolean")
    if e.kind in ("INTEGER", "REAL"):
        return e.column != 0
    if e.kind == "OPAQUE":
        raise TypeMismatchError("this type is not a condition")
    return F.when(e.column.isNotNull(), F.lit(False))


def value(e: Typed) -> Typed:
    """``e`` as a value: conditions become 1 and 0."""
    return Typed(e.column.cast("bigint"), "INTEGER") if e.kind == "BOOL" else e


def _numeric(e: Typed) -> Typed:
    e = value(e)
    if e.kind not in ("INTEGER", "REAL", "NULL"):
        raise TypeMismatchError(f"{e.kind} in arithmetic")
    return e


def sign(op: str, arg: Typed) -> Typed:
    e = _numeric(arg)
    if e.kind == "INTEGER":
        return Typed(-e.column.cast("bigint") if op == "-" else e.column, e.kind)
    return Typed(-e.column if op == "-" and e.kind == "REAL" else e.column, e.kind)


def _no_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("bigint"))


def arithmetic(op: str, left: Typed, right: Typed, exact: bool = False) -> Typed:
    """``+ - * / %``; division and remainder by zero are NULL, integers divide toward zero.

    An integer result out of range raises; with ``exact`` such operations are REAL from the start.
    """
    a, b = _numeric(left), _numeric(right)
    if "NULL" in (a.kind, b.kind):
        return Typed(F.lit(None), "NULL")
    if a.kind == b.kind == "INTEGER":
        x, y = a.column.cast("bigint"), b.column.cast("bigint")
        if op == "%":
            return Typed(x % _no_zero(y), "INTEGER")
        if op == "/":
            return Typed(F.call_function("div", x, _no_zero(y)), "INTEGER")
        if exact:
            tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
            return Typed(F.coalesce(tried.cast("double"), _apply(op, x.cast("double"), y.cast("double"))), "REAL")
        return Typed(_apply(op, x, y), "INTEGER")
    x, y = a.column.cast("double"), b.column.cast("double")
    if op == "/":
        return Typed(F.try_divide(x, y), "REAL")
    if op == "%":
        whole = lambda c: c - c % F.lit(1.0)  # noqa: E731  toward zero, of any size
        return Typed(whole(x) % F.nullif(whole(y), F.lit(0.0)) + F.lit(0.0), "REAL")
    return Typed(_apply(op, x, y), "REAL")


def _apply(op: str, x: Column, y: Column) -> Column:
    return x + y if op == "+" else x - y if op == "-" else x * y


_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(op: str, left: Typed, right: Typed) -> Typed:
    """Comparison; values of different classes compare by class, numbers first, then text, then blobs."""
    a, b = value(left), value(right)
    if "NULL" in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), "BOOL")
    if "OPAQUE" in (a.kind, b.kind):
        if a.kind != b.kind:
            raise TypeMismatchError("a pass-through type compares only with its own")
        return Typed(_COMPARE[op](a.column, b.column), "BOOL")
    if RANK[a.kind] == RANK[b.kind]:
        return Typed(_COMPARE[op](a.column, b.column), "BOOL")
    known = bool(_COMPARE[op](RANK[a.kind], RANK[b.kind]))
    return Typed(F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(known)), "BOOL")


def like(left: Typed, right: Typed) -> Typed:
    """LIKE without an escape character; A-Z match a-z, other letters only themselves."""
    a, b = value(left), value(right)
    if "NULL" in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), "BOOL")
    if a.kind != "TEXT" or b.kind != "TEXT":
        raise TypeMismatchError("LIKE needs text on both sides")
    fold = lambda c: F.translate(c, UPPER, LOWER)
    return Typed(F.like(fold(a.column), fold(b.column), F.lit("\x01")), "BOOL")


def aggregate(name: str, arg: Typed | None) -> Typed:
    """COUNT, SUM, AVG, MIN and MAX; ``arg`` None is COUNT(*)."""
    if arg is None:
        return Typed(F.count(F.lit(1)), "INTEGER")
    e = value(arg)
    if name == "count":
        return Typed(F.count(e.column), "INTEGER")
    if name in ("min", "max"):
        if e.kind == "OPAQUE":
            raise TypeMismatchError("a pass-through type has no order here")
        return Typed((F.min if name == "min" else F.max)(e.column), e.kind)
    if e.kind == "NULL":
        return Typed(F.max(e.column), "NULL")
    if e.kind not in ("INTEGER", "REAL"):
        raise TypeMismatchError(f"{name.upper()} of {e.kind}")
    return Typed(F.sum(e.column), e.kind) if name == "sum" else Typed(F.avg(e.column.cast("double")), "REAL")
