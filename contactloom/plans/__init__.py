"""Column plans: header verdicts, saved and replayed."""

from .mapping import MappingPlan

__all__ = ["MappingPlan"]
