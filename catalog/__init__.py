"""Named queries over the given tables, by operator family."""

import sys
from importlib import import_module

from pyspark import cloudpickle

# functions of the queries travel to Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILIES = (
    "projections",
    "filters",
    "joins",
    "aggregates",
    "ordered",
    "text",
    "learning",
    "analysis",
    "streams",
    "storage",
)


def load() -> None:
    for family in FAMILIES:
        import_module(f"catalog.{family}")
