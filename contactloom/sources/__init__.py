"""Sources and sinks: CSV, JSON, JSON lines, quarantine, saved reports."""

from .readers import read_rows
from .writers import write_results

__all__ = ["read_rows", "write_results"]
