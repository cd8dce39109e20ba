"""The engine's own queries and their SQL twins, by name."""

from __future__ import annotations

from skarn.plans import corpus, documents, made, queries, records, templates  # the first three and records add their queries to those of `queries`
from skarn.sources.tables import sql

FLAGSHIP = "rrf_fused_topk"
assert corpus and documents and made and records  # imported for their queries
QUERIES: dict = {name: (lambda spark, sf_dir, text=text: sql(spark, sf_dir, text)) for name, text in templates.SHARED.items()} | queries.QUERIES
ORACLE: dict = {name: templates.for_duckdb(text) for name, text in templates.SHARED.items()} | queries.ORACLE
