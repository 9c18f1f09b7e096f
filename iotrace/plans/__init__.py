"""The given tables read as traces, and every registered query with its SQL."""

from iotrace.plans import queries, recordings  # noqa: F401
