"""Connected components of an edge table: the library's own, under the name this subpackage uses."""

from __future__ import annotations

from ..operators.components import connected_components

__all__ = ["connected_components"]
