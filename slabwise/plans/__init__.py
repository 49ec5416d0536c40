"""slabwise.plans: registered queries."""


def load_catalog():
    """Import the query modules, which register themselves, and return the registry."""
    from . import algebra, catalog, features, graphs, planted  # noqa: F401

    return catalog
