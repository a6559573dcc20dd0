"""Connected components, as the other operators find them."""

from tessella.operators.components import components

__all__ = ["components"]
