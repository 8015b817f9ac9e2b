"""All registered queries."""

from . import cleanup, flows, market, scoring  # noqa: F401
from .registry import JOBS, SQL  # noqa: F401
