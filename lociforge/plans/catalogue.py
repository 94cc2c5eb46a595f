"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import annotation, genotyping, reporting

MODULES = [genotyping, annotation, reporting]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
