"""The queries of the operators, and the SQL of those that DuckDB can run."""

from __future__ import annotations

from cinderlog.llm import bpe, decontamination, jaccard, pitman_yor, quality_classifier, quality_rules, secrets, sharding, suffix_dedup, toxicity

MODULES = (sharding, quality_classifier, bpe, secrets, suffix_dedup, pitman_yor, quality_rules, toxicity, jaccard, decontamination)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
