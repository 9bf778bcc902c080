"""Tables of the driver and the registered queries."""

from . import extras, papers, records, retrieval, rules, scoring, searches, stores, walks, writes  # noqa: F401  each registers its queries
from .registry import oracle_sql, queries  # noqa: F401
