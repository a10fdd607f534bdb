"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

import functools

from panelrisk.llm import bpe, decontam, language, line_dedup, merge_bpe, merkle, packing, sharding, simhash, substring_dedup, topk, warc, whitening
from panelrisk.llm.common import ship

MODULES = (line_dedup, language, packing, decontam, substring_dedup, simhash, sharding, warc, topk, bpe, merkle, whitening, merge_bpe)


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
