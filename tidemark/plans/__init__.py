"""Named queries by family. Importing the package registers all of them."""

from tidemark.plans import books, kpi, loads, models, rows, timeline, watch  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
