"""Named queries (each a Spark plan built from the operators) and their oracle SQL."""

from tempest.plans import (  # noqa: F401  (registers queries)
    q_adapters, q_climate, q_drift, q_evaluate, q_model, q_portfolio, q_quality, q_scenarios, q_sinks,
    q_stream,
)
from tempest.plans.catalog import ORACLE, QUERIES, oracle_text  # noqa: F401
