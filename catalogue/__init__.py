"""Every operator and analysis bound to the test tables, each with the SQL that must give the same rows."""

from catalogue import evaluation, ranking, relational, revenue, text  # noqa: F401  (registers the queries)
from catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
