"""Imports every query module and exposes the registry."""

from . import inputs  # noqa: F401  (inputs come first: twins refer to them)
from . import dashboards, dna, documents, evaluation, fusion, quality, receipts, sources, streaming, training, urls  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
