"""Connected components, shared with the rest of the library."""

from tidemark.operators.groups import components

__all__ = ["components"]
