"""All queries of the library by name, with their SQL twins."""

from tarn.plans import analytics_queries, curation_queries, directory_queries, evaluation_queries, extra_queries, legal_queries, more_queries, page_queries, retrieval_queries, session_queries, text_queries  # noqa: F401
from tarn.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "retrieval_metrics"
