"""Rules as trees, and builders that check types."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from ..errors import RuleError, Status
from ..schema import AttrType, Schema

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
#: An int literal becomes a float one up to this magnitude.
FLOAT_INT_MAX = 1 << 53

NEGATION = {
    "var": "not_var", "lt": "ge", "le": "gt", "eq": "ne", "in": "not_in", "one_of": "none_of", "all_of": "not_all_of", "is_null": "is_not_null", "is_empty": "is_not_empty",
}
NEGATION |= {b: a for a, b in NEGATION.items()}
ORDER = ("lt", "le", "gt", "ge")
MIRROR = {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le", "eq": "eq", "ne": "ne"}


@dataclass(frozen=True)
class Expr:
    """Any node; depth counts connectives, 0 for leaves and constants."""

    def __getstate__(self) -> dict:
        """Without what normalising remembers."""
        return {k: v for k, v in self.__dict__.items() if k not in ("_key", "_normal", "_negated")}

    @property
    def depth(self) -> int:
        return 0


@dataclass(frozen=True)
class Const(Expr):
    value: bool


@dataclass(frozen=True)
class Leaf(Expr):
    attr: str
    kind: str
    operand: object = None

    def negated(self) -> Leaf:
        return Leaf(self.attr, NEGATION[self.kind], self.operand)


@dataclass(frozen=True)
class Connective(Expr):
    children: tuple[Expr, ...]

    def __post_init__(self):
        object.__setattr__(self, "_depth", 1 + max((c.depth for c in self.children), default=0))

    @property
    def depth(self) -> int:
        return self._depth


class And(Connective):
    pass


class Or(Connective):
    pass


class Not(Connective):
    pass


class Xor(Connective):
    pass


class Xnor(Connective):
    pass


def _mismatch(what: str) -> RuleError:
    return RuleError(Status.TYPE_MISMATCH, what)


def _number(name: str, kind: AttrType, value: object) -> int | float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise _mismatch(f"attribute '{name}' needs a number")
    if kind is AttrType.INT:
        if isinstance(value, float):
            raise _mismatch(f"int attribute '{name}' can't be compared with a float")
        if not INT_MIN <= value <= INT_MAX:
            raise RuleError(Status.INVALID_LITERAL, "the integer doesn't fit 64 bits")
        return value
    if isinstance(value, int):
        if abs(value) > FLOAT_INT_MAX:
            raise RuleError(Status.INVALID_LITERAL, "the integer is too large for a float attribute")
        return float(value)
    if not math.isfinite(value):
        raise RuleError(Status.INVALID_LITERAL, "the number is not finite")
    return value


def _elements(name: str, element: AttrType, values: Iterable) -> tuple:
    values = list(values)
    if not values:
        raise RuleError(Status.INVALID_LITERAL, "a list must not be empty")
    if element is AttrType.INT:
        if any(isinstance(v, bool) or not isinstance(v, int) for v in values):
            raise _mismatch(f"attribute '{name}' needs a list of integers")
        if not all(INT_MIN <= v <= INT_MAX for v in values):
            raise RuleError(Status.INVALID_LITERAL, "the integer doesn't fit 64 bits")
    elif not all(isinstance(v, str) for v in values):
        raise _mismatch(f"attribute '{name}' needs a list of strings")
    return tuple(sorted(set(values), key=lambda v: v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v))


def leaf(schema: Schema, attr: str, kind: str, operand: object = None) -> Leaf:
    """A checked leaf; lists are sorted and made unique, ints become floats where the attribute is one."""
    own = schema.type_of(attr)
    if kind in ("var", "not_var"):
        if own is not AttrType.BOOL:
            raise _mismatch(f"attribute '{attr}' is not a bool")
        return Leaf(attr, kind)
    if kind in ORDER:
        if own not in (AttrType.INT, AttrType.FLOAT):
            raise _mismatch(f"attribute '{attr}' has no order")
        return Leaf(attr, kind, _number(attr, own, operand))
    if kind in ("eq", "ne"):
        if own is AttrType.STRING:
            if not isinstance(operand, str):
                raise _mismatch(f"attribute '{attr}' needs a string")
            return Leaf(attr, kind, operand)
        if own not in (AttrType.INT, AttrType.FLOAT):
            raise _mismatch(f"attribute '{attr}' can't be compared with a value")
        value = _number(attr, own, operand)
        return Leaf(attr, kind, value + 0.0 if isinstance(value, float) and value == 0 else value)
    if kind in ("in", "not_in"):
        if own not in (AttrType.INT, AttrType.STRING):
            raise _mismatch(f"attribute '{attr}' can't be tested for membership")
        return Leaf(attr, kind, _elements(attr, own, operand))
    if kind in ("one_of", "none_of", "all_of", "not_all_of"):
        if not own.is_list:
            raise _mismatch(f"attribute '{attr}' is not a list")
        return Leaf(attr, kind, _elements(attr, AttrType.INT if own is AttrType.INT_LIST else AttrType.STRING, operand))
    if kind in ("is_null", "is_not_null"):
        if own.is_list:
            raise _mismatch(f"attribute '{attr}' is a list; test it with is empty")
        return Leaf(attr, kind)
    if kind in ("is_empty", "is_not_empty"):
        if not own.is_list:
            raise _mismatch(f"attribute '{attr}' is not a list; test it with is null")
        return Leaf(attr, kind)
    raise RuleError(Status.INVALID_ARG, f"unknown kind of predicate '{kind}'")


class Builder:
    """Makes rules in Python; max_depth bounds the nesting of connectives."""

    def __init__(self, schema: Schema, max_depth: int = 64):
        self.schema, self.max_depth = schema, max_depth

    def _made(self, kind: type[Connective], children: Iterable[Expr], least: int = 1) -> Expr:
        own = tuple(children)
        if len(own) < least or not all(isinstance(c, Expr) for c in own):
            raise RuleError(Status.INVALID_ARG, "a connective needs expressions")
        out = kind(own)
        if out.depth > self.max_depth:
            raise RuleError(Status.TOO_DEEP, f"more than {self.max_depth} levels")
        return out

    def true(self) -> Expr:
        return Const(True)

    def false(self) -> Expr:
        return Const(False)

    def var(self, attr: str) -> Expr:
        return leaf(self.schema, attr, "var")

    def compare(self, attr: str, op: str, value: object) -> Expr:
        kinds = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "=": "eq", "==": "eq", "<>": "ne", "!=": "ne"}
        if op not in kinds:
            raise RuleError(Status.INVALID_ARG, f"unknown comparison '{op}'")
        return leaf(self.schema, attr, kinds[op], value)

    def eq(self, attr: str, value: object) -> Expr:
        return leaf(self.schema, attr, "eq", value)

    def ne(self, attr: str, value: object) -> Expr:
        return leaf(self.schema, attr, "ne", value)

    def is_in(self, attr: str, values: Iterable) -> Expr:
        return leaf(self.schema, attr, "in", values)

    def not_in(self, attr: str, values: Iterable) -> Expr:
        return leaf(self.schema, attr, "not_in", values)

    def one_of(self, attr: str, values: Iterable) -> Expr:
        return leaf(self.schema, attr, "one_of", values)

    def none_of(self, attr: str, values: Iterable) -> Expr:
        return leaf(self.schema, attr, "none_of", values)

    def all_of(self, attr: str, values: Iterable) -> Expr:
        return leaf(self.schema, attr, "all_of", values)

    def is_null(self, attr: str, negated: bool = False) -> Expr:
        return leaf(self.schema, attr, "is_not_null" if negated else "is_null")

    def is_empty(self, attr: str, negated: bool = False) -> Expr:
        return leaf(self.schema, attr, "is_not_empty" if negated else "is_empty")

    def between(self, attr: str, low: object, high: object) -> Expr:
        return self.and_(leaf(self.schema, attr, "ge", low), leaf(self.schema, attr, "le", high))

    def and_(self, *children: Expr) -> Expr:
        return self._made(And, children)

    def or_(self, *children: Expr) -> Expr:
        return self._made(Or, children)

    def not_(self, child: Expr) -> Expr:
        return self._made(Not, (child,))

    def xor(self, left: Expr, right: Expr) -> Expr:
        return self._made(Xor, (left, right), 2)

    def xnor(self, left: Expr, right: Expr) -> Expr:
        return self._made(Xnor, (left, right), 2)
