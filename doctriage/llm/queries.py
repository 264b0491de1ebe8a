"""One query per operator, applied to its whole table, each with its SQL where SQL can express it."""

from doctriage.llm import text_queries, web_queries
from doctriage.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "text_queries", "web_queries"]
