"""Run configuration: two vocabularies, cue families, sections and parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from citemill import fixed


@dataclass(frozen=True)
class Term:
    """One dictionary entry; ``slot`` is ``"a"`` or ``"b"``."""

    slot: str
    entity_id: str
    patterns: tuple[str, ...]
    label_es: str = ""
    label_en: str = ""
    category: str = ""
    generic: bool = False


@dataclass(frozen=True)
class Limits:
    """How far the reference rules look into a text: characters, or lines for titles. None lifts a limit."""

    kind_chars: int | None = 1800
    year_chars: int | None = 4000
    doi_chars: int | None = 10_000
    metadata_chars: int | None = 12_000
    title_lines: int | None = 90
    context_kind_chars: int | None = 1200
    context_title_lines: int | None = 80


@dataclass(frozen=True)
class Protocol:
    terms: tuple[Term, ...]
    cues: dict[str, list[str]] = field(default_factory=dict)
    headers: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.SECTION_HEADERS))
    weights: dict[str, int] = field(default_factory=lambda: dict(fixed.SECTION_WEIGHTS))
    name: str = ""
    name_a: str = "A"
    name_b: str = "B"
    active_profile: str = "baseline_current"
    context_radius: int = 260
    kwic_radius: int = 160
    relation_distance: int = 900
    kmeans_k: int = 4
    validation_sample_size: int = 200
    limits: Limits = Limits()

    @property
    def sections(self) -> list[str]:
        """Every section name a mention can carry."""
        return list(dict.fromkeys([*self.weights, *self.headers, "title", "other"]))
