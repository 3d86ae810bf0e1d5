"""The registered queries, one module per operator family."""

from answerscope.plans.catalogue import (
    answers, features, hygiene, joins, metrics, outcomes, probes, selection, sources, trajectories, vectors,
)
from answerscope.plans.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "features", "hygiene", "joins", "metrics", "outcomes", "probes", "selection", "sources",
           "trajectories", "vectors"]
