"""All registered queries."""
from . import q_base, q_events, q_features, q_ledger, q_mining, q_portfolio, q_rules, q_stats, q_stream  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
