"""All queries outside the subpackage for training data."""

from __future__ import annotations

from loomwork.plans import catalogue, ledger, media, scripts, text

_MODULES = (catalogue, ledger, media, text, scripts)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
