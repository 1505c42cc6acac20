"""Parameters; frozen, so that a query never changes another's."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tempoloom.functions.timefn import expand, validate

MODES = ("strict", "with_temporal", "expanded")
SCOPES = ("all", "cross_time", "within_range")


@dataclass(frozen=True)
class QueryParams:
    top_k: int = 10
    similarity_threshold: float = 0.3
    max_hops: int = 2
    max_neighbors: int = 3
    enable_multi_hop: bool = True
    time_range: tuple[str, ...] = ()
    enable_time_filtering: bool = False
    temporal_expansion_mode: str = "with_temporal"
    temporal_evolution_scope: str = "cross_time"
    semantic_weight: float = 0.6
    temporal_weight: float = 0.4
    entity_max_tokens: int = 30_000
    relation_max_tokens: int = 30_000
    final_max_tokens: int = 120_000

    def normal(self) -> QueryParams:
        """A time range switches time filtering on; a bad range, mode or scope is an error."""
        ok, why = validate(list(self.time_range))
        if not ok:
            raise ValueError(why)
        if self.temporal_expansion_mode not in MODES or self.temporal_evolution_scope not in SCOPES:
            raise ValueError("no such expansion mode or evolution scope")
        return replace(self, enable_time_filtering=self.enable_time_filtering or bool(self.time_range))

    @property
    def months(self) -> list[str]:
        """The months that count, expanded once for filters, hops and scores; none without time filtering."""
        if not (self.enable_time_filtering and self.time_range):
            return []
        return expand(self.time_range, "adjacent" if self.temporal_expansion_mode == "expanded" else "strict")


@dataclass(frozen=True)
class ChunkParams:
    max_tokens: int = 500
    overlap_tokens: int = 50
    min_tokens: int = 100
    sentence_boundary: bool = True


@dataclass(frozen=True)
class ModelParams:
    embedding_dim: int = 64
    extraction_temperature: float = 0.0
    model: str = "offline"


@dataclass(frozen=True)
class CentralityParams:
    node_pivots: int = 100
    edge_pivots: int = 50
    pagerank_iterations: int = 50
