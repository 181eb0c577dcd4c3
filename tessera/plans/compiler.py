"""Compiles a SELECT to a DataFrame: names and types are settled here, everything else is left to Catalyst.

Columns get unique internal names (``c0``, ``c1``, ...), so repeated labels and self joins are safe; labels
are carried beside the frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import (
    AggregateError,
    AmbiguousColumnError,
    ColumnNotFoundError,
    ParameterCountError,
    SQLSyntaxError,
    TypeMismatchError,
    UnsupportedFeatureError,
)
from tessera.functions import expressions as ex
from tessera.functions.expressions import Typed
from tessera.sql import nodes as n

ROWID = "__rowid"
AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass
class Scope:
    """A table in FROM: its name there, and its columns as (declared name, internal name, type)."""

    name: str
    columns: list[tuple[str, str, str]]


@dataclass
class Compiled:
    df: DataFrame
    labels: list[str]

    def renamed(self) -> DataFrame:
        return self.df.toDF(*self.labels)


def text_of(e) -> str:
    """An expression as a label."""
    match e:
        case n.Literal(v):
            return "NULL" if v is None else repr(v)
        case n.Param():
            return "?"
        case n.Name(t, c):
            return f"{t}.{c}" if t else c
        case n.Unary(op, a):
            return f"NOT {text_of(a)}" if op == "not" else f"{op}{text_of(a)}"
        case n.Binary(op, a, b):
            return f"{text_of(a)} {op.upper()} {text_of(b)}"
        case n.IsNull(a, negated):
            return f"{text_of(a)} IS {'NOT ' * negated}NULL"
        case n.Call(name, args, star):
            return f"{name.upper()}({'*' if star else ', '.join(map(text_of, args))})"
    raise TypeError(e)


def has_aggregate(e) -> bool:
    match e:
        case n.Call(name, args, _):
            return name.lower() in AGGREGATES or any(map(has_aggregate, args))
        case n.Unary(_, a) | n.IsNull(a, _):
            return has_aggregate(a)
        case n.Binary(_, a, b):
            return has_aggregate(a) or has_aggregate(b)
    return False


@dataclass
class Compiler:
    """``table(name)`` gives the declared name and the frame of a table; ``strict`` refuses what joins exclude."""

    table: Callable[[str], tuple[str, DataFrame]]
    params: tuple = ()
    strict: bool = False
    exact: bool = False
    _ids: object = field(default_factory=count)

    def _internal(self) -> str:
        return f"c{next(self._ids)}"

    def scan(self, ref: n.TableRef) -> tuple[Scope, DataFrame]:
        _, df = self.table(ref.name)
        named = [(f.name, self._internal(), ex.kind_of(f.dataType)) for f in df.schema.fields]
        out = df.select(*(F.col(f"`{old}`").alias(new) for old, new, _ in named))
        return Scope(ref.alias or ref.name, named), out

    def resolve(self, name: n.Name, scopes: list[Scope]) -> tuple[str, str, str]:
        column, found = name.column.casefold(), []
        single = len(scopes) == 1  # a qualifier is not checked when there is one table
        if name.table is not None and not single:
            named = [s for s in scopes if s.name.casefold() == name.table.casefold()]
            if len(named) > 1:
                raise AmbiguousColumnError(text_of(name))
            if not named:
                raise ColumnNotFoundError(text_of(name))
        else:
            named = scopes
        for s in named:
            found += [c for c in s.columns if c[0].casefold() == column and c[0] != ROWID]
        if not found:
            raise ColumnNotFoundError(text_of(name))
        if len(found) > 1:
            raise AmbiguousColumnError(text_of(name))
        return found[0]

    def constant(self, e):
        """The value of a literal, a parameter, or a signed one."""
        match e:
            case n.Literal(v):
                return v
            case n.Param(k):
                return self.params[k]
            case n.Unary("-" | "+", a):
                v = self.constant(a)
                if v is None:
                    return None
                if not isinstance(v, (int, float)) or isinstance(v, bool):
                    raise TypeMismatchError(f"a sign before {v!r}")
                return -v if e.op == "-" else v
        raise UnsupportedFeatureError("only literals and parameters can stand here")

    def expr(self, e, scopes: list[Scope], known: dict | None = None) -> Typed:
        """``e`` over ``scopes``; ``known`` maps expressions (keys, aggregates) to columns already there."""
        if known is not None and (k := self._key(e, scopes)) in known:
            return known[k]
        match e:
            case n.Literal(v):
                return ex.literal(v)
            case n.Param(k):
                return ex.literal(self.params[k])
            case n.Name():
                if known is not None:
                    self.resolve(e, scopes)
                    raise AggregateError(f"{text_of(e)} is neither grouped by nor aggregated")
                _, internal, kind = self.resolve(e, scopes)
                return Typed(F.col(internal), kind)
            case n.Unary("not", a):
                return Typed(~ex.truth(self.expr(a, scopes, known)), "BOOL")
            case n.Unary(op, a):
                return ex.sign(op, self.expr(a, scopes, known))
            case n.IsNull(a, negated):
                c = self.expr(a, scopes, known).column
                return Typed(c.isNotNull() if negated else c.isNull(), "BOOL")
            case n.Binary(op, a, b):
                x, y = self.expr(a, scopes, known), self.expr(b, scopes, known)
                if op in ("and", "or"):
                    p, q = ex.truth(x), ex.truth(y)
                    return Typed(p & q if op == "and" else p | q, "BOOL")
                if op == "like":
                    return ex.like(x, y)
                return ex.arithmetic(op, x, y, self.exact) if op in "+-*/%" else ex.compare(op, x, y)
            case n.Call(name, _, _):
                raise UnsupportedFeatureError(f"{name} can't be called here")
        raise TypeError(e)

    def _key(self, e, scopes: list[Scope]):
        """``e`` with its names resolved, so that equal expressions are recognised."""
        match e:
            case n.Name():
                try:
                    return n.Name("", self.resolve(e, scopes)[1])
                except (ColumnNotFoundError, AmbiguousColumnError):
                    return e
            case n.Literal(v):
                return ("literal", type(v), v)
            case n.Unary(op, a):
                return n.Unary(op, self._key(a, scopes))
            case n.IsNull(a, negated):
                return n.IsNull(self._key(a, scopes), negated)
            case n.Binary(op, a, b):
                return n.Binary(op, self._key(a, scopes), self._key(b, scopes))
            case n.Call(name, args, star):
                return n.Call(name.lower(), tuple(self._key(a, scopes) for a in args), star)
        return e

    def condition(self, e, scopes: list[Scope], known: dict | None = None) -> Column:
        return ex.truth(self.expr(e, scopes, known))

    def _calls(self, e, out: list) -> None:
        match e:
            case n.Call(name, args, _):
                if name.lower() not in AGGREGATES:
                    raise UnsupportedFeatureError(f"there is no function {name}")
                if any(map(has_aggregate, args)):
                    raise AggregateError("an aggregate inside an aggregate")
                out.append(e)
            case n.Unary(_, a) | n.IsNull(a, _):
                self._calls(a, out)
            case n.Binary(_, a, b):
                self._calls(a, out)
                self._calls(b, out)

    def _aggregate(self, call: n.Call, scopes: list[Scope]) -> Typed:
        name = call.name.lower()
        if (call.star and name != "count") or (not call.star and len(call.args) != 1):
            raise AggregateError(f"{text_of(call)} has the wrong arguments")
        return ex.aggregate(name, None if call.star else self.expr(call.args[0], scopes))

    def select(self, s: n.Select) -> Compiled:
        wanted = max((p.index for p in _params(s)), default=-1) + 1
        if wanted != len(self.params):
            raise ParameterCountError(f"{wanted} parameters wanted, {len(self.params)} given")
        scope, df = self.scan(s.tables[0])
        scopes = [scope]
        for ref in s.tables[1:]:
            scope, right = self.scan(ref)
            scopes.append(scope)
            if ref.kind == "comma":
                df = df.crossJoin(right)  # with WHERE, Catalyst makes an equi-join of it
            else:
                df = df.join(right, self.condition(ref.on, scopes), ref.kind)
        if s.where is not None:
            if has_aggregate(s.where):
                raise UnsupportedFeatureError("an aggregate in WHERE")
            df = df.filter(self.condition(s.where, scopes))
        outputs = [*(s.items or ()), *(e for e, _ in s.order)]
        grouped = bool(s.group) or any(map(has_aggregate, outputs))
        if s.having is not None and not grouped and not has_aggregate(s.having):
            raise AggregateError("HAVING without GROUP BY or an aggregate")
        grouped |= s.having is not None
        if self.strict and len(scopes) > 1 and (grouped or s.distinct):
            raise UnsupportedFeatureError("a join with DISTINCT, GROUP BY or aggregates")
        known = None
        if grouped:
            df, known = self._grouped(s, df, scopes)
            if s.having is not None:
                df = df.filter(self.condition(s.having, scopes, known))
        return self._output(s, df, scopes, known)

    def _grouped(self, s: n.Select, df: DataFrame, scopes: list[Scope]) -> tuple[DataFrame, dict]:
        if s.items is None:
            raise AggregateError("SELECT * with grouping")
        if s.distinct:
            raise UnsupportedFeatureError("DISTINCT with grouping")
        known: dict = {}
        keys, aggregates = [], []
        for e in s.group:
            if has_aggregate(e):
                raise AggregateError("an aggregate in GROUP BY")
            t, name = ex.value(self.expr(e, scopes)), self._internal()
            keys.append(t.column.alias(name))
            if not isinstance(e, (n.Literal, n.Param)):
                known[self._key(e, scopes)] = Typed(F.col(name), t.kind)
        calls: list = []
        for e in [*s.items, *([s.having] if s.having is not None else []), *(e for e, _ in s.order)]:
            self._calls(e, calls)
        for call in calls:
            if (k := self._key(call, scopes)) not in known:
                t, name = self._aggregate(call, scopes), self._internal()
                aggregates.append(t.column.alias(name))
                known[k] = Typed(F.col(name), t.kind)
        if not s.group:
            return df.agg(*aggregates), known
        return (df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()), known

    def _output(self, s: n.Select, df: DataFrame, scopes: list[Scope], known: dict | None) -> Compiled:
        if s.items is None:
            items = [(c[0], Typed(F.col(c[1]), c[2])) for t in scopes for c in t.columns if c[0] != ROWID]
            texts = [n.Name("", c[1]) for t in scopes for c in t.columns if c[0] != ROWID]
        else:
            texts = [self._key(e, scopes) for e in s.items]
            items = [(self._label(e, scopes, known), ex.value(self.expr(e, scopes, known))) for e in s.items]
        names = [self._internal() for _ in items]
        columns = [t.column.alias(c) for (_, t), c in zip(items, names, strict=True)]
        keys, hidden = [], []
        for e, descending in s.order:
            if isinstance(e, n.Literal) and isinstance(e.value, int):
                if not 1 <= e.value <= len(items):
                    raise ColumnNotFoundError(f"there is no output column {e.value}")
                name = names[e.value - 1]
            elif self._key(e, scopes) in texts:
                name = names[texts.index(self._key(e, scopes))]
            else:
                if s.distinct:
                    raise UnsupportedFeatureError("ORDER BY an expression that SELECT DISTINCT lacks")
                name = self._internal()
                hidden.append(ex.value(self.expr(e, scopes, known)).column.alias(name))
            keys.append(F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first())
        limit, offset = (self._amount(x) for x in (s.limit, s.offset))
        rowid = next((c[1] for c in scopes[0].columns if c[0] == ROWID), None)
        if rowid and len(scopes) == 1 and known is None and not s.distinct and (keys or limit is not None or offset):
            hidden.append(F.col(rowid).alias(name := self._internal()))
            keys.append(F.col(name).asc())
        df = df.select(*columns, *hidden)
        if s.distinct:
            df = df.distinct()
        if keys:
            df = df.orderBy(*keys)
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return Compiled(df.select(*names) if hidden else df, [label for label, _ in items])

    def _label(self, e, scopes: list[Scope], known: dict | None) -> str:
        if isinstance(e, n.Name):
            return text_of(e) if known is not None else self.resolve(e, scopes)[0]
        return text_of(e)

    def _amount(self, e) -> int | None:
        if e is None:
            return None
        v = self.constant(e)
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise SQLSyntaxError("LIMIT and OFFSET take whole numbers from 0")
        return v


def _params(x):
    if isinstance(x, n.Param):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _params(y)
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            yield from _params(getattr(x, f))
