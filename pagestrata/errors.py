"""Exceptions of the library, and a decorator that wraps unknown errors of one stage."""

from __future__ import annotations

import functools


class PageError(Exception):
    """Base of all errors here; carries free-form details."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def __str__(self) -> str:
        extra = ", ".join(f"{k}={v!r}" for k, v in self.details.items())
        return f"{self.message} ({extra})" if extra else self.message


class HtmlError(PageError):
    """Html could not be handled."""


class PruneError(HtmlError):
    """Cleaning failed."""


class ParseError(HtmlError):
    """Block extraction failed."""


class EmbedError(PageError):
    """A vector could not be computed."""


class CollectionError(PageError):
    """A collection could not be read or written."""


class SnapshotError(PageError):
    """A snapshot directory could not be read."""


class ValidationError(PageError):
    """Input breaks a rule."""


class ConfigError(PageError):
    """A setting is unknown or out of range."""


class ModelError(PageError):
    """A model could not be loaded."""


class SearchError(PageError):
    """A search could not be run."""


class ResourceError(PageError):
    """A resource is missing."""


BY_STAGE: dict[str, type[PageError]] = {
    "html": HtmlError, "prune": PruneError, "parse": ParseError, "embed": EmbedError, "collection": CollectionError, "snapshot": SnapshotError,
    "validate": ValidationError, "config": ConfigError, "model": ModelError, "search": SearchError, "resource": ResourceError,
}


def error_of(stage: str, message: str, **details) -> PageError:
    """The error of a stage by its name; the base class for an unknown stage."""
    return BY_STAGE.get(stage, PageError)(message, **details)


def guarded(stage: str):
    """Let errors of this library pass and wrap all others as the error of ``stage``."""

    def wrap(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            try:
                return f(*args, **kwargs)
            except PageError:
                raise
            except Exception as e:
                raise error_of(stage, f"{f.__name__} failed: {e}") from e

        return call

    return wrap
