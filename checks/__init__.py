"""Registered queries with the SQL that checks them."""

from checks import q_functions, q_inputs, q_joins_counts, q_modelling, q_windows_sorts  # noqa: F401
from checks.registry import ORACLE, QUERIES  # noqa: F401
