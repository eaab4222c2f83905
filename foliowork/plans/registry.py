"""All registered queries and their SQL."""

from __future__ import annotations

from foliowork.plans import q_evidence, q_pages, q_runs, q_streams, q_structure, q_text

MODULES = (q_text, q_structure, q_evidence, q_runs, q_pages, q_streams)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
