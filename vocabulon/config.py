"""Settings of a run; immutable, and written out in full, overrides included."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    embed_dim: int = 300
    window_size: int = 10
    neg_samples: int = 5
    min_count: int = 5
    subsample_t: float = 1e-5
    lr_start: float = 0.025
    lr_min: float = 1e-4
    epochs: int = 20
    batch_size: int = 4096
    chunk_size: int = 500_000
    neg_table_size: int = 10_000_000
    seed: int = 1
    use_position_weights: bool = False
    position_weight_power: float = 1.0
    use_afws: bool = False
    afws_min_window: int = 3
    afws_max_window: int = 15
    afws_alpha: float = 0.5

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)
