"""Engine configuration: thresholds and paths, with the defaults of the documented workflow."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    # cleaning
    min_fraction: float = 0.10
    min_value: float = 1.0
    min_samples_case: int = 50
    min_samples_control: int = 50
    variance_quantile: float = 0.10
    # differential analysis
    log2fc: float = 1.0
    fdr: float = 0.05
    # network
    cutoff: float = 0.70
    nan_policy: str = "propagate"  # a missing value removes all edges of its row; 'pairwise' drops it from each pair
    # learning
    seed: int = 42
    test_fraction: float = 0.20
    folds: int = 5
    primary_metric: str = "auprc"
    undersample: bool = True
    smote: bool = False
    importance_repeats: int = 10
    legacy_scaler: bool = False  # score with a scaler fitted on all rows instead of the training rows
    # evaluation and ranking
    threshold_strategy: str = "f1"
    target_recall: float = 0.80
    target_precision: float = 0.50
    threshold_top_k: int = 200
    prob_threshold: float = 0.50
    high_confidence: float = 0.80
    min_overlap: int = 3
    pathway_names: tuple[str, ...] = ()  # after adjusting, keep pathways whose name holds one of these; all if empty
    # storage
    output: str = "output"
    formats: tuple[str, ...] = field(default=("csv",))
    use_cache: bool = True

    def key(self) -> str:
        """A text that tells two configurations apart, for cached stages."""
        import hashlib

        skip = {"output", "formats", "use_cache"}
        text = repr([(f.name, getattr(self, f.name)) for f in fields(self) if f.name not in skip])
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def validate_inputs(paths: dict[str, str]) -> None:
    """Raise FileNotFoundError naming every missing local input; paths of other stores are left to Spark."""
    missing = [f"{name}: {p}" for name, p in paths.items() if "://" not in p and not Path(p).exists()]
    if missing:
        raise FileNotFoundError("missing inputs: " + "; ".join(missing))
