"""Errors that name what is wrong with a declaration, a query or data."""

from __future__ import annotations


class GraphError(ValueError):
    """A declaration that makes no graph."""


class QueryError(ValueError):
    """A query that the graph can't answer."""


class DepthExceeded(QueryError):
    def __init__(self, depth: int, most: int, path: tuple[str, ...]):
        super().__init__(f"{'.'.join(path)} is {depth} relationships deep; the limit is {most}")
        self.depth, self.most, self.path = depth, most, path


class UnshapeableField(QueryError):
    """A field whose type has no canonical form in a response."""


class FunctionError(RuntimeError):
    """A registered function failed; ``code`` is its five-character state."""

    def __init__(self, message: str, code: str = "P0001"):
        super().__init__(f"{message} ({code})")
        self.code = code


class ConstraintViolation(ValueError):
    """Rows that break a declared constraint."""

    def __init__(self, code: str, table: str, constraint: str, rows: int):
        super().__init__(f"{table}: {rows} rows break {constraint} ({code})")
        self.code, self.table, self.constraint, self.rows = code, table, constraint, rows
