"""Churn and survival analytics as Spark DataFrame jobs."""

from tenurekit.config import StudyConfig

__all__ = ["StudyConfig"]
