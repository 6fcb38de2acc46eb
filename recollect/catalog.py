"""All queries of the library by name, with SQL that gives the same rows."""

from .plans import graphs, logs, mutations, recall, sessions, streams, transforms  # noqa: F401  each registers its queries
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "r1_keyword_recall"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
