"""Errors of this package."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType


class MissingDependencyError(ImportError):
    """An optional library that isn't installed, and what it is wanted for."""

    def __init__(self, library: str, purpose: str) -> None:
        super().__init__(f"{purpose} needs the library {library!r}, which is not installed", name=library)


def needed(library: str, purpose: str) -> ModuleType:
    """Import an optional library."""
    try:
        return import_module(library)
    except ModuleNotFoundError as e:
        if e.name != library.partition(".")[0]:
            raise
        raise MissingDependencyError(library, purpose) from e
