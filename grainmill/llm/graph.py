"""Connected components, as the core has them."""

from ..operators.graph import connected_components, forest

__all__ = ["connected_components", "forest"]
