"""All named queries; importing this module registers them."""

from wayfarer.plans import aggregate_queries, claim_queries, form_queries, ingest_queries, itinerary_queries, join_queries, merge_queries, quality_queries, search_queries, source_queries, stream_queries, survey_queries, text_queries, window_queries  # noqa: F401
from wayfarer.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
