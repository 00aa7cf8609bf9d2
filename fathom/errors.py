"""Errors with numeric codes: 1000s syntax, 2000s binding, 3000s catalog, 4000s files, 5000s conversion, 6000s constraints."""

from __future__ import annotations


class EngineError(Exception):
    code = 9000


class SyntaxFailure(EngineError):
    code = 1000


class BindFailure(EngineError):
    code = 2000


class CatalogFailure(EngineError):
    code = 3000


class FileFailure(EngineError):
    code = 4000


class ConversionFailure(EngineError):
    code = 5000


class ConstraintFailure(EngineError):
    code = 6000


def translated(e: Exception) -> Exception:
    """The engine's error for one of Spark's; others as they are."""
    name = (getattr(e, "getCondition", lambda: "")() or "") if not isinstance(e, EngineError) else ""
    if isinstance(e, EngineError) or not name:
        return FileFailure(str(e)) if isinstance(e, OSError) else e
    for start, kind in (("PARSE", SyntaxFailure), ("TABLE_OR_VIEW", CatalogFailure), ("PATH_NOT", FileFailure), ("CAST_", ConversionFailure), ("UNRESOLVED", BindFailure), ("AMBIGUOUS", BindFailure), ("MISSING_", BindFailure), ("DATATYPE", BindFailure)):
        if name.startswith(start):
            return kind(str(e))
    return EngineError(str(e))
