"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import audits, base, extras, factors, portfolio, relational

MODULES = [factors, relational, extras, audits, portfolio]
QUERIES, ORACLES = base.QUERIES, base.ORACLES
FLAGSHIP = "factor_reversal_ic"
