"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from sessile.plans import acceptance, assembly, cleaning, curation, fitting, imports, modelling, predictions, protocols, robust, validation, versions

_PLANS = (predictions, cleaning, fitting, curation, validation, modelling, protocols, robust, imports, versions, assembly, acceptance)
QUERIES: dict = {k: q for p in _PLANS for k, q in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for p in _PLANS for k, q in p.ORACLES.items()}
