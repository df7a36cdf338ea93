"""Column layouts, chunking configurations and the strategy registry."""

from __future__ import annotations

from dataclasses import dataclass

PAGES = "document_id string, file_name string, file_path string, document_type string, page_number int, text string"
BLOCKS = "document_id string, page_number int, block_seq int, block_id string, type string, text string, level int, items array<string>, columns array<string>, rows array<array<string>>, is_noise boolean, start_char int, end_char int"
CHUNKS = "document_id string, chunk_id string, chunk_index int, start_char int, end_char int, text string, page_numbers array<int>, word_count int, char_count int, context_prefix string, contextualized_text string"
ISSUES = "document_id string, invariant string, chunk_index int, message string"


@dataclass(frozen=True)
class ChunkingConfig:
    """How to chunk: ``characters`` windows or ``structural`` packing, with or without context."""

    max_chunk_size: int = 1000
    overlap_size: int = 100
    chunking_strategy: str = "characters"
    propagate_context: bool = False

    def __post_init__(self) -> None:
        if self.max_chunk_size < 1 or self.overlap_size < 0:
            raise ValueError("max_chunk_size must be 1 or more and overlap_size 0 or more")
        if self.chunking_strategy not in ("characters", "structural"):
            raise ValueError(f"unknown chunking strategy {self.chunking_strategy!r}")

    @property
    def is_structural(self) -> bool:
        return self.chunking_strategy == "structural"


STRATEGIES = {
    "v1.0": ("V1", ChunkingConfig(1000, 100, "characters")),
    "v2.1": ("V2.1", ChunkingConfig(1000, 0, "structural")),
    "v2.2": ("V2.2", ChunkingConfig(1000, 0, "structural", True)),
}


def get_chunking_strategy(name: str) -> tuple[str, ChunkingConfig]:
    """(label, configuration) of a registered strategy."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; choices: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def describe_chunking(config: ChunkingConfig) -> str:
    if not config.is_structural:
        return "character windows"
    return "structural packing with context" if config.propagate_context else "structural packing"
