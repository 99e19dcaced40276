"""All registered queries of the engine's own operators."""

from __future__ import annotations

from . import build, catalog, classify, model, sources  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "k2_profile"
