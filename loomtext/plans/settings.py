"""Settings, passed explicitly; importing this has no side effects."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from ..functions import text


@dataclass(frozen=True)
class Settings:
    """Folders, vocabularies and defaults of a project."""

    root: str = "."
    seed: int = 42
    sample_rows: int = 1000
    recommendations: int = 5
    encode_batch: int = 64
    vocabulary_size: int = 5000
    min_df: int = 2
    test_share: float = 0.2
    skills: tuple[str, ...] = text.SKILLS
    domains: tuple[str, ...] = text.DOMAINS
    categories: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(text.CATEGORIES))

    def folder(self, name: str) -> str:
        """Where ``raw``, ``interim``, ``processed``, ``models``, ``reports`` or a corpus (``corpus/<name>``) is."""
        return f"{self.root.rstrip('/')}/{name}"

    def init_dirs(self) -> list[Path]:
        """Makes the local folders and gives them."""
        made = [Path(self.folder(n)) for n in ("raw", "interim", "processed", "models", "reports", "figures", "corpus/jobs", "corpus/resumes")]
        for p in made:
            p.mkdir(parents=True, exist_ok=True)
        return made
