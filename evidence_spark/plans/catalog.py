"""All registered queries: importing a plan module registers its queries."""

from . import corpus_plans, graph_plans, job_plans, ledger_plans, match_plans, source_plans, text_plans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
