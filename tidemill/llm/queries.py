"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemill.llm import alignment, decontaminate, filteraudit, jaccard, language, lm, pieces, quality, substring, suffixes, tokenfiles, toxicity, warc

MODULES = (substring, suffixes, decontaminate, tokenfiles, pieces, jaccard, quality, toxicity, language, lm, alignment, warc, filteraudit)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
