"""Errors of the table engine."""


class EngineError(Exception):
    """Any failure of the table engine."""


class SchemaError(EngineError):
    """Rows or a change of schema do not fit the table's schema."""


class UnsupportedError(EngineError):
    """A statement or combination of options that keyed tables do not support."""


class ConflictError(EngineError):
    """Another commit changed what this one had read; the operation must be run again."""


class NotFoundError(EngineError):
    """No such table, view, column or partition."""
