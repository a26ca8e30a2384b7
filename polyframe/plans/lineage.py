"""Column lineage: which columns of which relations a result column is made from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Node:
    """A column of a plan node, and the columns that it is computed from."""

    name: str
    operator: str
    expression: str
    sources: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [self] if not self.sources else [leaf for s in self.sources for leaf in s.leaves()]

    def walk(self):
        yield self
        for s in self.sources:
            yield from s.walk()


def _sequence(scala) -> list:
    return [scala.apply(k) for k in range(scala.size())]


def _references(expression) -> set[int]:
    out = expression.references().toSeq()
    return {a.exprId().id() for a in _sequence(out)}


def _made(plan) -> dict[int, object]:
    """Expressions that a node computes, by the id of the column they make."""
    for field_name in ("projectList", "aggregateExpressions", "windowExpressions"):
        if hasattr(plan, field_name):
            try:
                named = _sequence(getattr(plan, field_name)())
            except Exception:  # noqa: BLE001  a field of that name that holds something else
                continue
            return {e.exprId().id(): e for e in named}
    return {}


def lineage(frame: DataFrame, column: str) -> Node:
    """The tree of a result column over the analyzed plan, down to the relations read."""
    plan = frame._jdf.queryExecution().analyzed()
    for attribute in _sequence(plan.output()):
        if attribute.name().lower() == column.lower():
            return _trace(plan, attribute.exprId().id(), attribute.name())
    raise ValueError(f"{column} is no column of {frame.columns}")


def _trace(plan, wanted: int, name: str) -> Node:
    children = _sequence(plan.children())
    kind = plan.nodeName()
    here = next((a for a in _sequence(plan.output()) if a.exprId().id() == wanted), None)
    made = _made(plan).get(wanted)
    if not children:
        return Node(name, kind, plan.simpleString(100))
    if made is None and kind in ("Union", "Except", "Intersect"):
        place = next(k for k, a in enumerate(_sequence(plan.output())) if a.exprId().id() == wanted)
        below = [_sequence(c.output())[place] for c in children]
        return Node(name, kind, kind.lower(), [_trace(c, a.exprId().id(), a.name()) for c, a in zip(children, below, strict=True)])
    ids = _references(made) if made is not None else {wanted}
    passes = made is None or (made.sql() == (here.sql() if here is not None else None))
    sources = []
    for child in children:
        for a in _sequence(child.output()):
            if a.exprId().id() in ids:
                sources.append(_trace(child, a.exprId().id(), a.name()))
    if passes and len(sources) == 1:
        return sources[0]
    text = made.sql() if made is not None else kind
    return Node(name, kind, text, sources)
