"""Scalar rules as native Column expressions (no Python per row)."""

from . import documents, guard, privacy, scores, text

__all__ = ["documents", "guard", "privacy", "scores", "text"]
