"""The operators applied to the given tables, each with its SQL counterpart.

``QUERIES`` maps a name to a callable ``(spark, folder) -> DataFrame``; ``SQL`` maps the same name
to the query a SQL engine runs on the same tables.  A query without SQL has no such counterpart.
"""

from doctriage.queries import files, jobs, learning, outputs, texts
from doctriage.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "jobs", "learning", "outputs", "texts"]
