"""barloom: panel time-series features, walk-forward evaluation and drift on Spark."""

from barloom.session import get_session

__all__ = ["get_session"]
