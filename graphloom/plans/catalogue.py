"""All queries of the graph operators."""

from __future__ import annotations

from graphloom.plans import analysis, patterns, pipeline

QUERIES = patterns.Q | analysis.Q | pipeline.Q
SQL = patterns.SQL | analysis.SQL | pipeline.SQL
