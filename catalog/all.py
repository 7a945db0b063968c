"""Importing this module registers every query."""

from catalog import aggregates, charts, checks, expressions, graphs, joins, marts, parcels, questions, scoring, selection, silver, sources, windows  # noqa: F401
