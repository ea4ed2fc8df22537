"""Flood-risk analytics on Spark DataFrames and streams."""

from hydrolens.session import build_session, ensure_checkpoint_dir, materialize

__all__ = ["build_session", "ensure_checkpoint_dir", "materialize"]
