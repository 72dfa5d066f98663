"""Every query by its name, and the SQL of those that SQL can express."""

from engram.plans import extended
from engram.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "extended"]
