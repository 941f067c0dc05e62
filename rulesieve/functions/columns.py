"""Rules as Catalyst expressions.

SQL's NULL logic is Kleene's, so connectives map one to one; xor and xnor are <> and = of booleans, which give NULL if a
side is NULL.  Literals are typed, so that nothing is cast at run time.  The columns must hold normal values (see
sources.events.normalized): NaN as NULL, lists without nulls.

A rule becomes one text that the JVM parses; making a column of many small ones costs a call to the JVM each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import And, Const, Expr, Leaf, Not, Xnor, Xor
from ..schema import AttrType, Schema

_SIGN = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def literal(value: object) -> str:
    """A typed literal; strings by their bytes, so that nothing needs escaping.  All are folded to constants."""
    if isinstance(value, str):
        return f"CAST(X'{value.encode('utf-8', 'surrogatepass').hex()}' AS STRING)"
    return f"CAST('{value!r}' AS {'DOUBLE' if isinstance(value, float) else 'BIGINT'})"


def _array(values: tuple) -> str:
    return f"array({', '.join(map(literal, values))})"


def leaf_sql(schema: Schema, own: Leaf) -> str:
    c = f"`{own.attr}`"
    match own.kind:
        case "var":
            return c
        case "not_var":
            return f"(NOT {c})"
        case "lt" | "le" | "gt" | "ge" | "eq" | "ne":
            value = float(own.operand) if schema.types[own.attr] is AttrType.FLOAT else own.operand
            return f"({c} {_SIGN[own.kind]} {literal(value)})"
        case "in" | "not_in":
            return f"({c} {'NOT ' if own.kind == 'not_in' else ''}IN ({', '.join(map(literal, own.operand))}))"
        case "is_null" | "is_not_null":
            return f"({c} IS {'NOT ' if own.kind == 'is_not_null' else ''}NULL)"
        case "is_empty" | "is_not_empty":
            return f"(array_size({c}) {'=' if own.kind == 'is_empty' else '>'} 0)"
        case "one_of" | "none_of":
            return f"({'NOT ' if own.kind == 'none_of' else ''}arrays_overlap({c}, {_array(own.operand)}))"
    found = balanced([f"array_contains({c}, {literal(v)})" for v in own.operand], "AND")
    return found if own.kind == "all_of" else f"(NOT {found})"


def balanced(parts: list[str], word: str) -> str:
    """Joins as a shallow tree; a long chain would go deep in the analyzer."""
    while len(parts) > 1:
        parts = [f"({parts[i]} {word} {parts[i + 1]})" if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def sql(schema: Schema, expr: Expr) -> str:
    if isinstance(expr, Const):
        return "true" if expr.value else "false"
    if isinstance(expr, Leaf):
        return leaf_sql(schema, expr)
    own = [sql(schema, c) for c in expr.children]
    if isinstance(expr, Not):
        return f"(NOT {own[0]})"
    if isinstance(expr, (Xor, Xnor)):
        return f"({own[0]} {'<>' if isinstance(expr, Xor) else '='} {own[1]})"
    return balanced(own, "AND" if isinstance(expr, And) else "OR")


def column(schema: Schema, expr: Expr) -> Column:
    """The rule's value: true, false or NULL for undefined."""
    return F.expr(sql(schema, expr))


def true_ones(rows: list[tuple[str, str]]) -> Column:
    """The array of the values, given as SQL, whose conditions are true."""
    return F.expr(f"array_compact(array({', '.join(f'CASE WHEN {condition} THEN {value} END' for condition, value in rows)}))")
