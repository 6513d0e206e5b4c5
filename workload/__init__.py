"""Queries over the given tables and the SQL they are checked against."""

from workload.registry import ORACLES, QUERIES
from workload import tables, texts, numbers, learning  # noqa: F401,E402  (importing registers)
