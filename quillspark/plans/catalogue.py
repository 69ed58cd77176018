"""Every registered query of the library's own operators, with the SQL it must agree with."""

from quillspark.plans import audit_queries, record_queries, relational_queries, search_queries, task_queries, text_queries  # noqa: F401
from quillspark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
