"""All registered queries and their SQL twins."""

from workload import files, model_answers, registry, reports, streams, texts

_MODULES = [texts, files, model_answers, registry, reports, streams]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
