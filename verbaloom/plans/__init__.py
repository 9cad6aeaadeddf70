"""Whole analyses: pipelines, experiments, reports, and the registered queries."""
