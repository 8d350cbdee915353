"""Registered queries. Importing this package fills the registry."""

from folioflow.plans import (  # noqa: F401
    aggregate_queries,
    check_queries,
    evaluation_queries,
    join_queries,
    retrieval_queries,
    source_queries,
    splitting_queries,
    streaming_queries,
    table_queries,
    text_queries,
    training_queries,
    window_queries,
)
from folioflow.plans.registry import ORACLES, QUERIES  # noqa: F401
