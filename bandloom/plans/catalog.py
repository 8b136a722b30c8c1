"""All registered queries."""

from . import analysis, design, models, records, results, spectral  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
