"""Connected components of links between documents or vectors."""

from cairn.operators.graph import connected_components

__all__ = ["connected_components"]
