"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from rolomill.operators.graph import components

__all__ = ["components"]
