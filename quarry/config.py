"""Settings, as frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RetrievalConfig:
    semantic_top_k: int = 20
    lexical_top_k: int = 20
    final_top_k: int = 5
    semantic_weight: float = 0.55
    lexical_weight: float = 0.25
    metadata_weight: float = 0.20

    def __post_init__(self):
        total = self.semantic_weight + self.lexical_weight + self.metadata_weight
        if not 0.99 <= total <= 1.01:
            raise ValueError(f"the weights sum to {total}, not 1")

    @property
    def recall_top_k(self) -> int:
        return max(50, 10 * self.final_top_k)


@dataclass(frozen=True)
class LexicalConfig:
    text_weight: float = 1.0
    context_weight: float = 1.0
    hints_weight: float = 1.0
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class GeneratorConfig:
    base_url: str = "http://localhost:11434"
    model: str = "llama3-chatqa:latest"
    timeout_s: float = 120.0
    attempts: int = 3
    keep_alive: str = "5m"
    options: dict = field(default_factory=lambda: {"temperature": 0, "top_p": 1, "num_predict": 512})


@dataclass(frozen=True)
class EnrichConfig:
    skip_first_pages: int = 5
    max_retries: int = 2
    retry_sleep_s: float = 0.5
    reset_interval: int = 50
    passes: int = 1


@dataclass(frozen=True)
class EngineConfig:
    retrieval: RetrievalConfig = RetrievalConfig()
    lexical: LexicalConfig = LexicalConfig()
    generator: GeneratorConfig = GeneratorConfig()
    enrich: EnrichConfig = EnrichConfig()
    profile: str = "cyrillic"
    dimension: int = 256
    embed_batch: int = 32
    custom_words: tuple[str, ...] = ()

    def __post_init__(self):
        if self.dimension <= 0:
            raise ValueError("dimension must be positive")
        if self.profile not in ("cyrillic", "unicode"):
            raise ValueError(f"no token profile {self.profile}")
