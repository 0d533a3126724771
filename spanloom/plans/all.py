"""All queries of the library's own operators."""

from __future__ import annotations

import spanloom.plans.annotate  # noqa: F401
import spanloom.plans.files  # noqa: F401
import spanloom.plans.learn  # noqa: F401
import spanloom.plans.tokenize  # noqa: F401
from spanloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
