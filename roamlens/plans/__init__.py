"""Registered queries."""


def load():
    """All query modules imported; returns (queries, check SQL)."""
    from roamlens.plans import registry
    from roamlens.plans import corpus, evidence, names, people, serving, storage, vectors  # noqa: F401

    return registry.QUERIES, registry.ORACLES
