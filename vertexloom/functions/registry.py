"""Named functions that a caller may invoke beside queries, with declared arguments."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..errors import FunctionError, GraphError, QueryError

_OMITTED = object()


@dataclass(frozen=True)
class Argument:
    name: str
    required: bool = False  # may not be null
    default: Any = _OMITTED  # passed where the caller omits it; else the function's own default holds


@dataclass(frozen=True)
class Function:
    name: str
    run: Callable[..., Any]
    arguments: tuple[Argument, ...] = ()
    void: bool = False


@dataclass
class Functions:
    """Calls are refused where ``read_only`` is set."""

    spark: SparkSession
    read_only: bool = False
    known: dict[str, Function] = field(default_factory=dict)

    def register(self, function: Function) -> None:
        for a in function.arguments:
            if not (a.name.isidentifier() and a.name == a.name.lower()):
                raise GraphError(f"{function.name}: {a.name} is no plain lower-case name")
        self.known[function.name] = function

    def call(self, name: str, **values: Any) -> Any:
        """The single value of the function, or True of a void one. An omitted argument isn't a null
        one: it leaves the function its own default."""
        if self.read_only:
            raise FunctionError(f"{name} can't be called in a read-only session", "25006")
        if name not in self.known:
            raise QueryError(f"there is no function {name}")
        function = self.known[name]
        if unknown := set(values) - {a.name for a in function.arguments}:
            raise QueryError(f"{name} has no argument {min(unknown)}")
        passed: dict[str, Any] = {}
        for a in function.arguments:
            if a.name in values:
                if values[a.name] is None and a.required:
                    raise QueryError(f"{name}: {a.name} may not be null")
                passed[a.name] = values[a.name]
            elif a.default is not _OMITTED:
                passed[a.name] = a.default
        try:
            result = function.run(**passed)
        except FunctionError:
            raise
        except Exception as e:
            raise FunctionError(f"{name}: {e}") from e
        return True if function.void else result

    def sql_function(self, name: str, arguments: tuple[Argument, ...] = (), void: bool = False) -> None:
        """Register a function that the session knows in SQL; arguments are bound, never spelt out."""

        def run(**passed: Any) -> Any:
            given = ", ".join(f"{a} => :{a}" for a in passed)
            rows = self.spark.sql(f"SELECT {name}({given}) AS result", args=passed).collect()
            return rows[0]["result"]

        self.register(Function(name, run, arguments, void))


def rows(spark: SparkSession, statement: str, values: Mapping[str, Any] | None = None):
    """The rows of a statement with bound values."""
    return spark.sql(statement, args=dict(values or {}))
