"""Code-review analytics on Spark: diffs in, findings and dashboards out."""

from revlake.session import build_session

__all__ = ["build_session"]
