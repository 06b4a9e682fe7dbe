"""Connected components, shared with the other operators."""

from ..operators.graph import components, tidy

__all__ = ["components", "tidy"]
