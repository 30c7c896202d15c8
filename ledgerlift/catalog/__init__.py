"""The registered queries: each is a Spark callable with, where SQL can say it, the same result as plain SQL."""

from ledgerlift.catalog.registry import COVERS, ORACLES, QUERIES
from ledgerlift.catalog import detection, extraction, quality, streams, text, usage  # noqa: F401  (registration)

__all__ = ["COVERS", "ORACLES", "QUERIES"]
