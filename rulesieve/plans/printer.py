"""From rules to text that parses to the same rule."""

from __future__ import annotations

from .expr import And, Const, Expr, Leaf, Not, Or, Xnor, Xor

_SIGN = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}
_JOIN = {And: " and ", Or: " or ", Xor: " xor ", Xnor: " xnor "}
_ESCAPE = str.maketrans({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\0": "\\0"})


def literal(value: object) -> str:
    if isinstance(value, tuple):
        return f"[{', '.join(map(literal, value))}]"
    if isinstance(value, str):
        return f'"{value.translate(_ESCAPE)}"'
    if isinstance(value, int):
        return str(value)
    text = f"{value:.15g}"
    if float(text) != value:
        text = f"{value:.17g}"
    if "." not in text:
        head, e, tail = text.partition("e")
        text = f"{head}.0{e}{tail}"
    return text


def leaf_text(own: Leaf) -> str:
    if own.kind == "var":
        return own.attr
    if own.kind == "not_var":
        return f"not {own.attr}"
    if own.kind == "not_all_of":
        return f"not ({own.attr} all of {literal(own.operand)})"
    if own.kind in _SIGN:
        return f"{own.attr} {_SIGN[own.kind]} {literal(own.operand)}"
    words = own.kind.replace("_", " ")
    return f"{own.attr} {words}" + ("" if own.operand is None else f" {literal(own.operand)}")


def text(expr: Expr) -> str:
    if isinstance(expr, Const):
        return "true" if expr.value else "false"
    if isinstance(expr, Leaf):
        return leaf_text(expr)
    if isinstance(expr, Not):
        child = expr.children[0]
        return f"not ({text(child)})" if type(child) in _JOIN else f"not {text(child)}"
    return _JOIN[type(expr)].join(f"({text(c)})" if type(c) in _JOIN else text(c) for c in expr.children)
