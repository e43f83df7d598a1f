"""Settings of one data preparation and one experiment."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from rarelane.functions.rowwise import ROW_AGGREGATES

LOG = logging.getLogger("rarelane")


@dataclass(frozen=True)
class DataConfig:
    """How to prepare a table.  Fixed values: setting names and defaults."""

    train_file: str | None = None
    test_file: str | None = None
    model_file: str | None = None
    model_name_override: str | None = None
    test_size: float = 0.3
    random_state: int = 42
    class_name: str = "Class"
    should_over_sample: bool = True
    enforce_equal_samples: bool = False
    over_sample_percentage: float = 1.0
    non_fraud_sample_size: int | None = None
    max_fraud_samples: int | None = None
    max_non_fraud_samples: int | None = None
    class_balance_ratio: float | None = None
    max_total_samples: int | None = None
    oversample_method: str = "smote"
    oversample_ratio: float | None = None
    enable_engineered_features: bool = True
    v_feature_names: tuple[str, ...] = ()
    engineered_feature_names: tuple[str, ...] = tuple(ROW_AGGREGATES)
    additional_feature_names: tuple[str, ...] = ()
    index_column: str = "id"
    preserve_natural_test_distribution: bool = False
    split_method: str = "random"
    time_column: str = "Time"
    feature_scaling: str = "none"
    drop_duplicates: bool = False
    log_transform_amount: bool = False
    amount_column: str = "Amount"
    sample_random_state: int | None = None
    split_random_state: int | None = None
    oversample_random_state: int | None = None
    #: Rows that category values are learnt from: all, or the train fold only.
    encoding_fold: str = "all"

    def __post_init__(self) -> None:
        positive = (
            "max_fraud_samples", "max_non_fraud_samples", "non_fraud_sample_size",
            "max_total_samples", "class_balance_ratio", "oversample_ratio",
            "over_sample_percentage",
        )
        for name in positive:
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive, got {value}")
        choices = {
            "split_method": ("random", "chronological"),
            "feature_scaling": ("none", "minmax", "standard"),
            "oversample_method": ("smote", "random", "adasyn"),
            "encoding_fold": ("all", "train"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}: expected {allowed}")

    @staticmethod
    def from_dict(raw: Mapping[str, Any]) -> DataConfig:
        """Build from a mapping; unknown keys only warn."""
        known = {f.name for f in fields(DataConfig)}
        for name in raw:
            if name not in known:
                LOG.warning("data setting %r is not known and is ignored", name)
        given = {
            k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known
        }
        return DataConfig(**given)

    @property
    def negatives_wanted(self) -> int | None:
        limit = self.max_non_fraud_samples
        return self.non_fraud_sample_size if limit is None else limit

    @property
    def minority_ratio(self) -> float:
        ratio = self.oversample_ratio
        return self.over_sample_percentage if ratio is None else ratio

    @property
    def balances_classes(self) -> bool:
        """A limit on negatives alone does not switch balancing on."""
        switches = (self.max_fraud_samples, self.class_balance_ratio, self.max_total_samples)
        return self.enforce_equal_samples or any(s is not None for s in switches)

    def seed(self, stage: str) -> int:
        """Seed of stage ``sample``, ``split`` or ``oversample``."""
        own = getattr(self, f"{stage}_random_state")
        return self.random_state if own is None else own


@dataclass(frozen=True)
class Experiment:
    """One run: a name (its key), an algorithm, its settings and the data settings."""

    name: str
    algorithm: str
    classifier: Mapping[str, Any]
    data: DataConfig

    @staticmethod
    def from_dict(name: str, raw: Mapping[str, Any]) -> Experiment:
        for part in ("algorithm", "data"):
            if not raw.get(part):
                raise ValueError(f"experiment {name!r} lacks {part!r}")
        if raw.get("classifier") is None:
            raise ValueError(f"experiment {name!r} lacks 'classifier'")
        return Experiment(
            name, raw["algorithm"], dict(raw["classifier"]), DataConfig.from_dict(raw["data"])
        )


def read_experiments(folder: str) -> list[Experiment]:
    """Every ``*.yaml`` below a local folder, keyed by its path inside it."""
    from pathlib import Path

    import yaml

    root = Path(folder)
    return [
        Experiment.from_dict(
            p.relative_to(root).with_suffix("").as_posix(),
            yaml.safe_load(p.read_text(encoding="utf-8")),
        )
        for p in sorted(root.rglob("*.yaml"))
    ]
