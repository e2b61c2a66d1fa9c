"""Named queries over the given tables, with the SQL that must give the same rows."""

from wordtide.registry import annotation, clusters, corpus, hits, scalars, sampling, vectors

MODULES = [corpus, hits, scalars, sampling, vectors, clusters, annotation]


def queries() -> dict:
    found = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict:
    found = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
