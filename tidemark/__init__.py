"""Change-data-capture tables, audits and replays as Spark jobs."""

from tidemark.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
