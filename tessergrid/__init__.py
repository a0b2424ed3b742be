"""A Spark-first engine for evidence catalogues, retrieval and course/material analytics."""

from .session import get_session, tables

__all__ = ["get_session", "tables"]
