"""Settings of the engine: one frozen object, checked when made, passed by the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Inclusive ranges of the numeric settings.
RANGES: dict[str, tuple[float, float]] = {
    "num_workers": (1, 32),
    "worker_service_quantum": (1, 3600),
    "batch_size": (1, 100),
    "max_retries": (0, 10),
    "worker_poll_interval": (100, 60_000),
    "default_chunk_size": (50, 2000),
    "default_chunk_overlap": (0, 500),
    "auto_cleanup_hours": (0, 8760),
    "bm25_k1": (0, 3),
    "bm25_b": (0, 1),
    "corpus_stats_cache_ttl": (0, 3600),
    "corpus_stats_cache_max_uses_pct": (0, 100),
}


@dataclass(frozen=True)
class EngineConfig:
    """All 21 settings. Keys and addresses stay on the driver and never enter a plan's columns."""

    provider: str = "openai"
    api_key_file: str = "~/.loomtext-api-key"
    api_url: str = ""
    model: str = "text-embedding-3-small"
    extra_headers: str = ""
    databases: str = ""
    num_workers: int = 2
    worker_service_quantum: int = 60
    batch_size: int = 10
    max_retries: int = 3
    worker_poll_interval: int = 1000
    default_chunk_strategy: str = "token_based"
    default_chunk_size: int = 400
    default_chunk_overlap: int = 50
    strip_non_ascii: bool = True
    auto_cleanup_hours: int = 24
    enable_hybrid: bool = False
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    corpus_stats_cache_ttl: int = 60
    corpus_stats_cache_max_uses_pct: int = 5

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}, not {getattr(self, name)}")

    def items(self) -> list[tuple[str, str]]:
        """(setting, value) sorted by name, flags as on and off."""
        spelled = {f.name: getattr(self, f.name) for f in fields(self)}
        return sorted((f"loomtext.{k}", ("on" if v else "off") if isinstance(v, bool) else str(v)) for k, v in spelled.items())


def show_config(spark: SparkSession, config: EngineConfig | None = None) -> DataFrame:
    """(setting, value) of all settings, by name."""
    return spark.createDataFrame((config or EngineConfig()).items(), "setting string, value string").orderBy("setting")
