"""Statuses and the one exception that rules, registries and decoders raise."""

from __future__ import annotations

from enum import Enum

MESSAGE_MAX = 256


class Status(Enum):
    """The status texts."""

    OK = "success"
    INVALID_ARG = "invalid argument"
    SYNTAX = "syntax error"
    UNKNOWN_ATTR = "unknown attribute"
    TYPE_MISMATCH = "type mismatch"
    DUPLICATE_ATTR = "duplicate attribute"
    DUPLICATE_ID = "duplicate subscription id"
    NOT_FOUND = "not found"
    TOO_DEEP = "expression too deeply nested"
    LIMIT = "capacity limit reached"
    INVALID_LITERAL = "invalid literal"
    CORRUPT = "internal structure is inconsistent"
    CANCELLED = "cancelled by callback"


class RuleError(ValueError):
    """status, byte offset into the text (None: not about a text), length of the offending token, message."""

    def __init__(self, status: Status, message: str = "", offset: int | None = None, length: int = 0):
        self.status, self.offset, self.length, self.message = status, offset, length, message[:MESSAGE_MAX]
        super().__init__(self.describe())

    def describe(self) -> str:
        text = self.status.value + (f": {self.message}" if self.message else "")
        return text if self.offset is None else f"{text} (at offset {self.offset})"

    def __reduce__(self):
        return RuleError, (self.status, self.message, self.offset, self.length)
