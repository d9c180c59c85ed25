"""Incremental state: a table keyed by asset, content hash, phase and configuration fingerprint."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(config: object) -> str:
    """16 hex digits of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()[:16]


def pending(assets: DataFrame, state: DataFrame, phases: tuple[str, ...], mark: str, key: str = "asset_id") -> DataFrame:
    """(key, hash, phase) not yet done with this content and configuration.

    Each phase has its own hash, so a changed file never looks done for a phase that ran on the old one.
    """
    wanted = assets.select(key, "hash", F.explode(F.array(*[F.lit(p) for p in phases])).alias("phase"))
    done = state.where(F.col("fingerprint") == mark).select(key, "hash", "phase")
    return wanted.join(done, [key, "hash", "phase"], "left_anti")


def completed(done: DataFrame, mark: str, key: str = "asset_id") -> DataFrame:
    """State rows of results that succeeded."""
    return done.where(~F.col("failed")).select(key, "hash", "phase", F.lit(mark).alias("fingerprint"))


def pruned(state: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """State of assets that still exist."""
    return state.join(assets.select(key), key, "left_semi")


def healed(state: DataFrame, outputs: DataFrame, files: DataFrame, key: str = "asset_id") -> DataFrame:
    """State rows whose recorded outputs (key, phase, path) are all among the listed files (path)."""
    lost = outputs.join(files, "path", "left_anti").select(key, "phase").distinct()
    return state.join(lost, [key, "phase"], "left_anti")
