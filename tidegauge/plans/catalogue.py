"""All queries of the engine, by name, with their SQL twins."""

from tidegauge.plans import market, models, views  # noqa: F401
from tidegauge.plans.base import QUERIES, SQL  # noqa: F401
