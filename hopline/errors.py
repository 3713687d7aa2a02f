"""Errors of the language and of the store."""

from __future__ import annotations


class HoplineError(Exception):
    """Base of all errors raised by this package."""


class ParseError(HoplineError):
    """A text does not follow the grammar."""

    def __init__(self, message: str, text: str = "", at: int = 0):
        line = text.count("\n", 0, at) + 1
        column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} (line {line}, column {column})" if text else message)
        self.line, self.column = line, column


class SchemaError(HoplineError):
    """A schema contradicts itself."""


class CheckError(HoplineError):
    """A query breaks a type rule; ``code`` names it (T1 to T21), empty if it has none."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}" if code else message)
        self.code = code


class LoadError(HoplineError):
    """Input rows can't be loaded."""


class ConstraintError(LoadError):
    """Rows break a key or unique constraint."""


class StoreError(HoplineError):
    """A stored graph is missing, damaged or used wrongly."""


class MigrationError(HoplineError):
    """A schema change can't be applied."""
