"""Registered queries: every operator run over the driver tables, with its SQL oracle."""

from __future__ import annotations

from catalog import answers, html_queries, metrics, plans_queries, prompts, runs, sites, store, text_queries
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "html_queries", "metrics", "plans_queries", "prompts",
           "runs", "sites", "store", "text_queries"]
