"""Connected components of links between documents."""

from panelloom.operators.components import connected_components

__all__ = ["connected_components"]
