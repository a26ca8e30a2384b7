"""Column expressions written down before there is a session.

Spark's functions need a running session; registered queries are described at import. ``E`` and
``EP`` stand for the function modules and give ``Expr`` objects; ``force`` makes Columns of them.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions

from .. import functions as own


class Expr:
    def __init__(self, make: Callable[[], object]):
        self._make = make

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *args, **kwargs: Expr(lambda: getattr(force(self), name)(*map(force, args), **kwargs))


def _binary(name: str) -> None:
    setattr(Expr, f"__{name}__", lambda self, other: Expr(lambda: getattr(operator, name if name not in ("and", "or") else f"{name}_")(force(self), force(other))))
    setattr(Expr, f"__r{name}__", lambda self, other: Expr(lambda: getattr(operator, name if name not in ("and", "or") else f"{name}_")(force(other), force(self))))


for _name in ("add", "sub", "mul", "truediv", "mod", "pow", "and", "or"):
    _binary(_name)
for _name in ("eq", "ne", "lt", "le", "gt", "ge", "getitem"):
    setattr(Expr, f"__{_name}__", lambda self, other, name=_name: Expr(lambda: getattr(operator, name)(force(self), force(other))))
for _name in ("neg", "invert"):
    setattr(Expr, f"__{_name}__", lambda self, name=_name: Expr(lambda: getattr(operator, name)(force(self))))


def force(value: object) -> object:
    """A Column of an expression; functions given to higher-order functions return Columns."""
    if isinstance(value, Expr):
        return value._make()
    if callable(value) and not isinstance(value, type):
        return wraps(value)(lambda *args: force(value(*args)))
    return value


class Module:
    def __init__(self, module):
        self._module = module

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        function = getattr(self._module, name)
        return lambda *args, **kwargs: Expr(lambda: function(*map(force, args), **{k: force(v) for k, v in kwargs.items()}))


E, EP = Module(functions), Module(own)
