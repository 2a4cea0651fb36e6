"""All queries and their SQL, outside the subpackage for language models."""

from __future__ import annotations

from lumenweave.plans import aggregates, entities, files, further, graphs, relational, texts, training

_PARTS = [relational.query, aggregates.query, texts.query, graphs.query, files.query, further.query, entities.query]

QUERIES = dict(training.QUERIES)
ORACLES = dict(training.ORACLES)
for _part in _PARTS:
    QUERIES |= _part.queries
    ORACLES |= _part.oracles
