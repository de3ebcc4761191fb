"""A table analytics engine on Spark SQL: every operator is a plan of DataFrame operations."""

from sparkloom.session import Session
from sparkloom.table import Table

__all__ = ["Session", "Table"]
