"""All named queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from lexaudit.plans import audit, checking, expressions, keeping, matching, pieces, relational, scoring
from lexaudit.streaming import attempts, resume

QUERIES = {**audit.QUERIES, **relational.Q, **scoring.QUERIES, **expressions.QUERIES, **checking.QUERIES, **pieces.QUERIES, **keeping.QUERIES, **matching.QUERIES, **resume.QUERIES, **attempts.QUERIES}
ORACLE_SQL = {**audit.SQL, **relational.SQL, **scoring.SQL, **expressions.SQL, **checking.SQL, **pieces.SQL, **keeping.SQL, **matching.SQL, **resume.SQL, **attempts.SQL}
