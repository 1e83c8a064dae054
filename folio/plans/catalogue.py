"""All queries of the engine by name, with the SQL that gives the same rows."""

from folio.plans import job_queries, layout_queries, text_queries, word_queries  # noqa: F401  they register themselves
from folio.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
