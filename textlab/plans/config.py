"""Settings of a training session."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    """Settings read by the plans. Upper-case keys of a stored record map to these names.

    With ``opt`` LBFGS MLlib's solvers fit a ``linear`` or ``mlp`` head; ``lr`` and
    ``drop_rate`` do not apply. With AdamW or SGD a ``linear`` or ``relu`` head is trained
    step by step, ``steps`` distributed batches per epoch (``plans.train``).
    """

    multi: bool = False
    head: str = "linear"
    emb_model: str = "hashing"
    opt: str = "LBFGS"
    seed: int = 42
    split: float = 0.8
    k: int = 5
    samples: int = 10
    max_epochs: int = 20
    batch_size: int = 32
    steps: int = 1
    h_dim: int = 64
    redux: int | None = None
    lr: float = 1e-3
    l1: float = 0.0
    weight_decay: float = 0.0
    drop_rate: float = 0.2
    patience: int = 3

    @staticmethod
    def of(values: Mapping[str, Any]) -> Config:
        known = {f.name for f in fields(Config)}
        return Config(**{k.lower(): v for k, v in values.items() if k.lower() in known})

    def with_(self, **values: Any) -> Config:
        return replace(self, **values)

    @property
    def classes(self) -> int:
        return 4 if self.multi else 2

    @property
    def first_order(self) -> bool:
        """Whether heads are trained step by step instead of by a solver of MLlib."""
        return self.head == "relu" or (self.head == "linear" and self.opt in ("AdamW", "SGD"))

    def record(self) -> dict[str, Any]:
        return {k.upper(): v for k, v in asdict(self).items()}
