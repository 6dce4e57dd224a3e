"""All registered queries."""

from . import record_queries, search_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
