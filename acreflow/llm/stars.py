"""Connected components of an edge table, as the rest of the library has them."""

from __future__ import annotations

from acreflow.operators.stars import components

__all__ = ["components"]
