"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from foliowork.llm import bpe, exact, lines, media, merkle, mixing, neardup, packing, quality, repeats, runs, secrets, urls

MODULES = (lines, exact, urls, secrets, neardup, quality, mixing, media, packing, repeats, bpe, merkle, runs)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
