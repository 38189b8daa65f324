"""Schemas of all datasets by their standard names."""

from __future__ import annotations

SCHEMAS = {
    "concepts": "concept_id long, label string",
    "contexts": "context_id long, concept_id long",
    "context-counts": "concept_id long, context_id long, context_count long",
    "correlations": "src long, dst long, weight double",
    "similarities": "src long, dst long, weight double",
    "correlation-clusters": "concept_id long, cluster_id long",
    "similarity-clusters": "concept_id long, cluster_id long",
    "recurrent-concepts": "rec_id long, concept_id long, n long",
    "and-concepts": "child_id long, parent_id long",
    "and-concept-lengths": "parent_id long, size long",
    "or-concepts": "child_id long, parent_id long",
    "count": "n long",
}
RATING = "item long, rating int, day int, time string, user long"
