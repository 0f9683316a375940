"""All registered queries. Importing the query modules fills the registry."""

from downfield.plans import feed_queries, flow_queries, model_queries, play_queries  # noqa: F401
from downfield.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
