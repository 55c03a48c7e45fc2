"""Relational, windowed and per-record operators."""
