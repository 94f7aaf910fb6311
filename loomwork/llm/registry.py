"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audio, chat, collocation, fingerprint, html, jaccard, langid, mixing, negatives, packing, quality, sharding, tokens

_MODULES = (packing, jaccard, sharding, mixing, html, tokens, audio, fingerprint, quality, langid, collocation, negatives, chat)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
