"""The plain meaning of a rule for one event, without Spark; tests compare everything else with it."""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping

from ..plans.expr import Const, Expr, Leaf, Not, Or, Xnor, Xor

_ORDER = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne}


def holds(own: Leaf, event: Mapping[str, object]) -> bool | None:
    """Whether a predicate holds; None: undefined.  Missing, None and NaN are undefined values."""
    value = event.get(own.attr)
    if isinstance(value, float) and math.isnan(value):
        value = None
    if own.kind in ("is_null", "is_not_null"):
        return (value is None) == (own.kind == "is_null")
    if value is None:
        return None
    if own.kind in ("var", "not_var"):
        return value == (own.kind == "var")
    if own.kind in _ORDER:
        return _ORDER[own.kind](value, own.operand)
    if own.kind in ("in", "not_in"):
        return (value in own.operand) == (own.kind == "in")
    if own.kind in ("is_empty", "is_not_empty"):
        return (len(value) == 0) == (own.kind == "is_empty")
    if own.kind in ("one_of", "none_of"):
        return bool(set(value) & set(own.operand)) == (own.kind == "one_of")
    return (set(own.operand) <= set(value)) == (own.kind == "all_of")


def evaluate(expr: Expr, event: Mapping[str, object]) -> bool | None:
    """Kleene's three values: True, False, None."""
    if isinstance(expr, Const):
        return expr.value
    if isinstance(expr, Leaf):
        return holds(expr, event)
    own = [evaluate(c, event) for c in expr.children]
    if isinstance(expr, Not):
        return None if own[0] is None else not own[0]
    if isinstance(expr, (Xor, Xnor)):
        return None if None in own else (own[0] != own[1]) == isinstance(expr, Xor)
    decides = isinstance(expr, Or)
    return decides if decides in own else None if None in own else not decides
