"""loomtable: table analytics as Spark DataFrame jobs."""

from loomtable.registry import get_operator, list_operators, operator

__all__ = ["get_operator", "list_operators", "operator"]
