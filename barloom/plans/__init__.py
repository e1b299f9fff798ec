"""Named queries over the driver tables, each with an equivalent SQL statement where SQL can say it."""

from . import assets, feeds, live, loads, market, metrics, pairs, profiles, results, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
