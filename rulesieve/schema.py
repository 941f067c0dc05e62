"""Attributes: their names, types and the Spark schema of events."""

from __future__ import annotations

import re
from collections.abc import Iterable
from enum import Enum

from pyspark.sql import types as T

from .errors import RuleError, Status

#: Words that rules use, in any case.
KEYWORDS = frozenset("true false and or not xor xnor in one none all of is null empty between".split())
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


class AttrType(Enum):
    BOOL = "bool"
    INT = "int"
    FLOAT = "float"
    STRING = "string"
    INT_LIST = "int_list"
    STRING_LIST = "string_list"

    @property
    def is_list(self) -> bool:
        return self in (AttrType.INT_LIST, AttrType.STRING_LIST)

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]


_SPARK = {
    AttrType.BOOL: T.BooleanType(),
    AttrType.INT: T.LongType(),
    AttrType.FLOAT: T.DoubleType(),
    AttrType.STRING: T.StringType(),
    AttrType.INT_LIST: T.ArrayType(T.LongType(), True),
    AttrType.STRING_LIST: T.ArrayType(T.StringType(), True),
}
#: Other names of types in text.
ALIASES = {"boolean": "bool", "integer": "int", "integer_list": "int_list"}


def attr_type(name: str) -> AttrType:
    try:
        return AttrType(ALIASES.get(name, name))
    except ValueError:
        raise RuleError(Status.INVALID_ARG, f"unknown type '{name}'") from None


class Schema:
    """Attributes in the order of their declaration; fixed once made.  None at all is allowed."""

    def __init__(self, attrs: Iterable[tuple[str, AttrType | str]] = ()):
        self.types: dict[str, AttrType] = {}
        for name, kind in attrs:
            if not isinstance(name, str) or not _NAME.fullmatch(name) or name.lower() in KEYWORDS:
                raise RuleError(Status.INVALID_ARG, f"'{name}' can't be an attribute's name")
            if name in self.types:
                raise RuleError(Status.DUPLICATE_ATTR, f"attribute '{name}' is defined twice")
            self.types[name] = kind if isinstance(kind, AttrType) else attr_type(kind)

    def __iter__(self):
        return iter(self.types.items())

    def __len__(self) -> int:
        return len(self.types)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and list(self) == list(other)

    def __hash__(self) -> int:
        return hash(tuple(self))

    def type_of(self, name: str) -> AttrType:
        if name not in self.types:
            raise RuleError(Status.UNKNOWN_ATTR, f"unknown attribute '{name}'")
        return self.types[name]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark, True) for n, t in self])

    @classmethod
    def from_lines(cls, lines: Iterable[str]) -> Schema:
        """From lines `name<white space>type`; empty ones and those that start with # are skipped."""
        attrs = []
        for line in lines:
            if line.strip() and not line.lstrip().startswith("#"):
                parts = line.split()
                if len(parts) != 2:
                    raise RuleError(Status.SYNTAX, f"expected a name and a type: '{line.strip()}'")
                attrs.append((parts[0], parts[1]))
        return cls(attrs)
