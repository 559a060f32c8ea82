"""Connected components: those of the operators, see operators/components.py."""

from ..operators.components import connected_components, forest  # noqa: F401
