"""All registered queries of the library with their DuckDB counterparts."""

from . import artifact_queries, critique_queries, derived_queries, page_queries, proposal_queries, report_queries, store_queries, structure_queries

QUERIES = page_queries.Q | derived_queries.Q | artifact_queries.Q | report_queries.Q | structure_queries.Q | store_queries.Q | proposal_queries.Q | critique_queries.Q
ORACLES = page_queries.O | derived_queries.O | artifact_queries.O | report_queries.O | structure_queries.O | store_queries.O | proposal_queries.O | critique_queries.O
