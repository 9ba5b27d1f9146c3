"""Assignment of rows to splits by hashes of their key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction_units(key: Column, seed: int = 0) -> Column:
    """The first 60 bits of SHA-256 of ``seed:key`` as a long."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def split_label(key: Column, validation: float = 0.02, test: float = 0.02, seed: int = 0) -> Column:
    """Test, validation or train, by where the key's hash falls; a key is never in two."""
    units = hash_fraction_units(key, seed)
    return F.when(units < int(test * 2**60), "test").when(units < int((test + validation) * 2**60), "validation").otherwise("train")


def shard_split(shards: list[str], fraction: float, seed: int) -> tuple[list[str], list[str]]:
    """Whole shards to train and validation, by a seeded permutation (rows of one position can fall in both)."""
    if fraction <= 0 or len(shards) < 2:
        return list(shards), []
    held = min(len(shards) - 1, max(1, int(np.ceil(len(shards) * fraction))))
    picked = set(np.random.default_rng(seed).permutation(len(shards))[:held].tolist())
    return [s for i, s in enumerate(shards) if i not in picked], [s for i, s in enumerate(shards) if i in picked]


def seeded_rank_key(key: Column, seed: int, epoch: int = 0) -> Column:
    """A sort key that permutes rows the same way for the same seed and epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), key.cast("string")))
