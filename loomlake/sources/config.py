"""Settings of a library, kept as JSON beside its tables."""

from __future__ import annotations

import dataclasses
import json

from ..functions.paths import EXTENSIONS

BACKENDS = ("hash", "embedding", "hybrid")


@dataclasses.dataclass
class Config:
    library_roots: list[str] = dataclasses.field(default_factory=list)
    extensions: list[str] = dataclasses.field(default_factory=lambda: list(EXTENSIONS))
    backend: str = "hash"
    hash_algo: str = "phash"
    hash_size: int = 8
    hash_max_distance: int = 12
    tta: bool = True
    color_alpha: float = 0.2
    rerank_candidates: int = 200
    thumb_size: int = 256
    max_results: int = 100
    duplicate_hamming: int = 8
    score_threshold: float = 0.0
    rescan_interval_sec: int = 0
    model_path: str = ""

    def uses_embedding(self) -> bool:
        return self.backend in ("embedding", "hybrid")

    @classmethod
    def from_json(cls, text: str | None) -> Config:
        """Unknown names are dropped; text that isn't an object gives the defaults."""
        try:
            held = json.loads(text or "{}")
            return cls(**{f.name: held[f.name] for f in dataclasses.fields(cls) if f.name in held})
        except (ValueError, TypeError):
            return cls()

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))
