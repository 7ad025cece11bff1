"""Whole evaluations and the registered queries."""

from themeforge.plans import (
    label_queries,
    model_queries,
    source_queries,
    text_queries,
    vector_queries,
)

QUERY_MODULES = (text_queries, model_queries, label_queries, vector_queries, source_queries)
