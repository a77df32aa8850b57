"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from meshframe.llm import fixity, hilbert, langid, neardup, phrases, pieces, pseudolik, quality, repair, separators, suffixes, syncmers

MODULES = [separators, pieces, hilbert, syncmers, suffixes, neardup, pseudolik, quality, fixity, repair, langid, phrases]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {k: s for m in MODULES for k, s in m.SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
