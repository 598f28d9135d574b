"""All registered queries."""

from queryset import cleaning, compiled, grouped, joined, planned, resampled, tested, through_time  # noqa: F401
from queryset.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
