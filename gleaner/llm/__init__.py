"""Training-data operators: the corpus operators and their registered queries.

``queries()`` maps a query name to ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` maps the names whose
result plain SQL can express to that SQL.  Nothing outside this subpackage (and ``corpus_pipeline.py``)
imports it.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("language", "exact", "minhash", "decontaminate", "bpe", "tokens", "pii", "urls", "lines", "secrets", "periodic", "divergence", "packing")


def queries():
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql():
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLE_SQL
    return found
