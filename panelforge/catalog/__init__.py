"""Registered queries: one per inventory entry, with the SQL each must agree with."""

from panelforge.catalog import (  # noqa: F401
    eval_queries, feature_queries, ingest_queries, model_queries, xsec_queries,
)
from panelforge.catalog.base import ORACLES, QUERIES  # noqa: F401
from panelforge.catalog.eval_queries import flagship  # noqa: F401
