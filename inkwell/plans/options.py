"""Options with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass

from inkwell.functions.text import FORMS


@dataclass(frozen=True)
class NormalizeOptions:
    """``bloom_false_positive_rate`` and ``threads`` are accepted and checked; deduplication is exact and Spark schedules."""

    form: str = "NFKC"
    bloom_false_positive_rate: float = 1e-6
    threads: int = 0
    min_length: int = 0
    max_length: int = 0
    progress_step: float = 0.05
    batch_scoped_dedup: bool = False

    def __post_init__(self) -> None:
        if self.form.upper() not in FORMS:
            raise ValueError(f"form must be one of {', '.join(FORMS)}")
        if 0 < self.max_length < self.min_length:
            raise ValueError("min_length must not exceed max_length")
        if not 0 < self.bloom_false_positive_rate < 1:
            raise ValueError("bloom_false_positive_rate must be between 0 and 1")
        if not 0 < self.progress_step <= 1:
            raise ValueError("progress_step must be above 0 and at most 1")


@dataclass(frozen=True)
class PmiOptions:
    n: int = 2
    top_k: int = 2500
    min_freq: int = 3
    threads: int = 0
    progress_step: float = 0.05
    verbose: bool = False

    def __post_init__(self) -> None:
        if self.n not in (1, 2, 3):
            raise ValueError("n must be 1, 2 or 3")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if self.min_freq < 1:
            raise ValueError("min_freq must be at least 1")
        if not 0 < self.progress_step <= 1:
            raise ValueError("progress_step must be above 0 and at most 1")


@dataclass(frozen=True)
class WordOptions:
    """Lengths are in bytes. ``language_code`` is accepted and selects nothing."""

    min_pmi: float = 1.0
    max_candidate_length: int = 20
    max_candidates: int = 100_000
    verify_in_text: bool = True
    use_context: bool = True
    use_statistics: bool = True
    dictionary: str = ""
    min_length: int = 2
    max_length: int = 20
    min_score: float = 0.5
    remove_substrings: bool = True
    remove_overlaps: bool = True
    language_rules: bool = True
    language_code: str = ""
    top_k: int = 1000
    ranking_model: str = "combined"
    pmi_weight: float = 0.4
    length_weight: float = 0.2
    context_weight: float = 0.2
    statistical_weight: float = 0.2

    def __post_init__(self) -> None:
        if self.min_pmi < 0:
            raise ValueError("min_pmi must not be negative")
        for name in ("max_candidate_length", "max_candidates", "min_length", "top_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.max_length < self.min_length:
            raise ValueError("max_length must not be below min_length")

    @property
    def weights(self) -> tuple[float, float, float, float]:
        return self.pmi_weight, self.length_weight, self.context_weight, self.statistical_weight
