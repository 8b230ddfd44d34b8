"""All registered queries and their oracles."""

from pactlens.plans import queries_lifecycle, queries_quality, queries_retrieval, queries_text

MODULES = [queries_text, queries_retrieval, queries_quality, queries_lifecycle]
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
