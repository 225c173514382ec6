"""Expected learning rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_lr(step: Column, max_lr: float, min_lr: float, warmup_steps: int, max_steps: int) -> Column:
    """Linear rise over the warm-up, cosine fall to ``min_lr``, flat from ``max_steps`` on."""
    done = (step - warmup_steps) / F.lit(float(max(max_steps - warmup_steps, 1)))
    cosine = F.lit(min_lr) + 0.5 * (max_lr - min_lr) * (1.0 + F.cos(F.lit(math.pi) * done))
    rate = F.when(step >= max_steps, F.lit(min_lr)).otherwise(cosine)
    if warmup_steps <= 0:
        return rate
    return F.when(step < warmup_steps, F.lit(max_lr) * (step + 1) / warmup_steps).otherwise(rate)
