"""Registered queries: each module has QUERIES and, for those that SQL can express, SQL."""

from . import activation_queries, assurance_queries, catalogue_queries, drift_queries, evidence_queries, monitor_queries, profile_queries, system_queries, vector_queries

REGISTERED = [activation_queries, drift_queries, monitor_queries, evidence_queries, vector_queries, assurance_queries, system_queries, catalogue_queries, profile_queries]
