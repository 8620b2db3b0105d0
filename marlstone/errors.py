"""Errors of the engine."""


class MarlstoneError(Exception):
    """Base of all errors of the engine."""


class ParseError(MarlstoneError):
    """The text is not a query of the dialect."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} (at {position})")
        self.position = position


class NameError_(ParseError):
    """A table or column is unknown or ambiguous."""


class TypeMismatch(ParseError):
    """Operands or casts do not fit."""


class CatalogError(MarlstoneError):
    """A catalog breaks its own rules."""


class LoadError(MarlstoneError):
    """Input files do not fit their declaration."""
