"""Errors of the engine; every one has a ``code`` and a message."""

from __future__ import annotations


class EngineError(Exception):
    code = "FATAL"

    @property
    def msg(self) -> str:
        return str(self)


class FatalError(EngineError):
    """Stored data that can't be what this version wrote."""


class EngineSystemError(EngineError):
    """A resource of the environment that is missing, such as a language."""

    code = "SYSTEM"


class InvalidError(EngineError):
    code = "INVALID"


class ExistsError(EngineError):
    code = "EXISTS"


class MissingError(EngineError):
    code = "MISSING"


class LimitError(EngineError):
    code = "LIMIT"
