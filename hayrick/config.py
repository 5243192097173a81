"""Settings of the retrieval engine. Defaults are the published ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    k1: float = 1.5
    b: float = 0.5
    max_words: int = 120
    overlap_words: int = 40
    dense_alpha: float = 0.0
    dense_topn: int = 100
    sparse_alpha: float = 0.25
    sparse_topn: int = 30
    rrf_k: int = 28
    dense_depth: int = 100
    sparse_depth: int = 60
    top_k: int = 10
    number_filter: bool = True
    filter_mode: str = "post"  # "pre": restrict before ranking; "post": prune the fused list
    include_dense: bool = True
    include_sparse: bool = True


DEFAULT = Settings()
