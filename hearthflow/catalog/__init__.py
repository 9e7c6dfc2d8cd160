"""All registered queries; importing this package registers them."""

from . import intake, judged, learned, stored, streamed, timed  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
