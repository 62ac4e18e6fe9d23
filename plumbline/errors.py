"""The errors that the engine raises by itself; Spark's own pass through."""

from __future__ import annotations


class EngineError(Exception):
    """Any of these."""


class NotFound(EngineError, LookupError):
    """A table, an index, a log or a procedure that is not there."""


class AlreadyExists(EngineError, ValueError):
    """A name that is taken."""


class InvalidArgument(EngineError, ValueError):
    """A command, a value or a procedure that makes no sense or failed."""


class Corruption(EngineError, ValueError):
    """Entries of a log whose checksum does not fit."""


class NotSupported(EngineError, RuntimeError):
    """Something that is switched off or that the engine does not do."""
