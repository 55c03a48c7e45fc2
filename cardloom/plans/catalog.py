"""All named queries of the card pipeline and the SQL that checks them."""

from __future__ import annotations

from . import cards, evaluation, frames, layouts, operations, records, streams, texts

_PARTS = (evaluation, cards, texts, frames, layouts, operations, records, streams)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
