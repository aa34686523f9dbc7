"""Leak-aware feature building and scoring on Spark DataFrames."""

from lagwise.session import build_session, materialize, shared_folder

__all__ = ["build_session", "materialize", "shared_folder"]
