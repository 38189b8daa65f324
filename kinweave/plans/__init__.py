"""Composed jobs: pipelines, experiments and the registered queries."""
