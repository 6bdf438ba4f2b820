"""All named queries over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import relational, versioned

QUERIES = {**relational.QUERIES, **versioned.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **versioned.ORACLE_SQL}
