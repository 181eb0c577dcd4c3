"""Syntax trees. Nodes compare by value, so equal expressions can be recognised."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    value: int | float | str | None


@dataclass(frozen=True)
class Param:
    index: int


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None
    kind: str = "from"  # from, inner, left, comma
    on: object = None


@dataclass(frozen=True)
class Select:
    items: tuple | None  # None: all columns
    tables: tuple[TableRef, ...]
    distinct: bool = False
    where: object = None
    group: tuple = ()
    having: object = None
    order: tuple = ()  # (expression, descending)
    limit: object = None
    offset: object = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, object], ...]
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Analyze:
    table: str | None


@dataclass(frozen=True)
class Explain:
    select: Select
    analyze: bool


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, begin immediate, commit, rollback
