"""Column operators without state; they run unchanged on a ``readStream`` table.

There is no stateful streaming operator: none is part of this library's scope.
"""

from tenderlens.operators.cleaning import clean, flag_amounts, flag_dates, normalize_nature
from tenderlens.operators.peers import add_division
from tenderlens.operators.query_log import parse_queries
from tenderlens.plans.prediction import valid_target
from tenderlens.sources.contracts import coerce_dates, current_only

__all__ = ["add_division", "clean", "coerce_dates", "current_only", "flag_amounts", "flag_dates",
           "normalize_nature", "parse_queries", "valid_target"]
