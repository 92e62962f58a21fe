"""Activity-timeline analytics on Spark.

An append-only log of input events, a window dimension derived from it, and a
parameterised timeline API over both, in batch and in Structured Streaming.
"""

from tideglass.operators.timeline import EventQuery, WindowQuery
from tideglass.store import TimelineStore

__all__ = ["EventQuery", "TimelineStore", "WindowQuery"]
