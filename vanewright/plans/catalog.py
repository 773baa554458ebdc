"""All queries of the monitoring engine with their oracle SQL."""

from __future__ import annotations

from . import queries_decisions, queries_frames, queries_fusion, queries_models, queries_more, queries_rules, queries_scale, queries_sources, queries_streaming, queries_tables, queries_values

_MODULES = (queries_values, queries_frames, queries_decisions, queries_fusion, queries_more, queries_models, queries_rules, queries_tables, queries_sources, queries_streaming, queries_scale)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = "d06_flag_segments"
