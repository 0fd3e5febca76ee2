"""All queries of this package."""

from __future__ import annotations

import importlib

_MODULES = [importlib.import_module(f"hushmark.llm.queries.{name}") for name in ("secrets", "contamination", "chat", "packing", "simhash", "quality", "langid", "ann", "html", "lm", "tokencount", "vectorcode", "collocations")]

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLE = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
