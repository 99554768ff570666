"""All registered queries and their SQL."""

from . import catalog, engine, evaluation  # noqa: F401

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
