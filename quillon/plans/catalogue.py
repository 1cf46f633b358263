"""Imports every module that registers queries."""

from quillon.plans import agreement_queries, answer_queries, board_queries, curation_queries, ledger_queries, marks_queries, metric_queries, probe_queries, serving_queries  # noqa: F401
