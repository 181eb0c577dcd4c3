"""Typed errors; everything the engine raises on purpose derives from EngineError."""


class EngineError(Exception):
    pass


class DatabaseError(EngineError):
    pass


class CorruptDatabaseError(DatabaseError):
    pass


class SQLError(EngineError):
    pass


class SQLSyntaxError(SQLError):
    pass


class CatalogError(SQLError):
    pass


class TableNotFoundError(CatalogError):
    pass


class TableExistsError(CatalogError):
    pass


class IndexExistsError(CatalogError):
    pass


class ColumnNotFoundError(SQLError):
    pass


class AmbiguousColumnError(SQLError):
    pass


class AggregateError(SQLError):
    pass


class IntegerOverflowError(SQLError):
    pass


class SortLimitExceededError(SQLError):
    """Kept for compatibility; sorts spill, so nothing raises it."""


class ColumnCountError(SQLError):
    pass


class ParameterCountError(SQLError):
    pass


class TypeMismatchError(SQLError):
    pass


class UnsupportedFeatureError(EngineError):
    pass


class UniqueViolationError(EngineError):
    def __init__(self, index_name: str, key: tuple):
        super().__init__(f"index {index_name} already has the key {key!r}")
        self.index_name, self.key = index_name, key


class TransactionError(EngineError):
    pass


class DeadlockError(EngineError):
    def __init__(self, victim: int, cycle: tuple[int, ...]):
        super().__init__(f"transaction {victim} gives way in the cycle {cycle}")
        self.victim, self.cycle = victim, cycle


class LockTimeoutError(EngineError):
    pass


class ThreadingError(EngineError):
    pass
