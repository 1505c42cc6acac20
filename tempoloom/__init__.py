"""Temporal knowledge graphs on Spark."""

from tempoloom.plans.engine import Engine, Result
from tempoloom.plans.params import CentralityParams, ChunkParams, QueryParams

__all__ = ["CentralityParams", "ChunkParams", "Engine", "QueryParams", "Result"]
