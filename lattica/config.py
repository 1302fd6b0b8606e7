"""Engine settings and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Suffixes that are indexed by default.
ALLOWED_EXTENSIONS = (".md", ".txt", ".py", ".json", ".yaml", ".yml", ".toml", ".ts", ".tsx", ".js", ".jsx")


@dataclass(frozen=True)
class EngineConfig:
    # The defaults.
    vector_size: int = 768
    max_embed_chars: int = 6000
    chunk_size: int = 500
    chunk_overlap: int = 100
    max_chunk_chars: int = 2000
    max_file_bytes: int = 5 * 1024 * 1024
    batch_tokens: int = 4000
    retrieval_k: int = 5
    hops: int = 2
    communities_n: int = 5
    max_entities: int = 20
    max_relationships: int = 40
    max_identifiers: int = 5
    max_pieces_per_def: int = 10
    max_chunk_block_chars: int = 10_000
    min_entity_name_chars: int = 3
    max_chat_messages: int = 200
    max_content_items: int = 32
    max_message_chars: int = 8000
    max_total_chars: int = 120_000
    max_question_chars: int = 12_000
    max_model_name_chars: int = 128
    rate_window_seconds: int = 60
    rate_max_requests: int = 30
    session_hours: int = 8
    allowed_extensions: tuple[str, ...] = field(default=ALLOWED_EXTENSIONS)

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (value < 0 if f.name == "chunk_overlap" else value <= 0):
                raise ValueError(f"{f.name} must be {'non-negative' if f.name == 'chunk_overlap' else 'positive'}")
        for low, high in (("max_question_chars", "max_total_chars"), ("max_message_chars", "max_total_chars"), ("chunk_size", "max_chunk_chars")):
            if getattr(self, low) > getattr(self, high):
                raise ValueError(f"{low} must not exceed {high}")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")


DEFAULT = EngineConfig()
