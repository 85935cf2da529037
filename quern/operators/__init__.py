"""Named queries of the reference's operators."""

from . import analytics, context, corpus, fuzzy, linking, matching, profiling, relational, retrieval, speech, storage, vectors  # noqa: F401
from .registry import ORACLES, QUERIES
from ..streaming import windows  # noqa: F401  # isort: skip

__all__ = ["ORACLES", "QUERIES"]
