"""Content-hash run ids, manifests and the chain of inputs."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from firnline import __version__
from firnline.session import cut_lineage


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def run_id(input_ids: list[str], cfg_hash: str) -> str:
    """Twelve hex characters that do not depend on the order of the inputs."""
    return hashlib.sha256(("".join(sorted(input_ids)) + cfg_hash).encode()).hexdigest()[:12]


def run_id_column(ids: Column, cfg_hash: Column) -> Column:
    """The same as an aggregate over a run's (few) input ids."""
    return F.substring(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(ids)), ""), F.first(cfg_hash)), 256), 1, 12)


def manifest(stage: str, section: dict, input_ids: list[str], **extra) -> dict:
    h = config_hash(section)
    return {
        "run_id": run_id(input_ids, h), "stage": stage, "tool_version": __version__,
        "created_at": datetime.now(timezone.utc).isoformat(), "config_hash": h, "inputs": sorted(input_ids), **extra,
    }


def ancestry(lineage: DataFrame) -> DataFrame:
    """All (run_id, ancestor, depth) of a (run_id, input_id) table, shortest depth per pair, however deep the chains are.

    A round extends the pairs found in the one before; pairs that are known already
    are left out, so chains that run in a circle end too.
    """
    edges = cut_lineage(lineage.select("run_id", "input_id").distinct())
    latest = edges.select("run_id", F.col("input_id").alias("ancestor"), F.lit(1).alias("depth"))
    found = latest
    while not latest.isEmpty():
        further = latest.join(edges.withColumnRenamed("run_id", "ancestor"), "ancestor").select(
            "run_id", F.col("input_id").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        latest = cut_lineage(further.join(found, ["run_id", "ancestor"], "left_anti"))
        found = cut_lineage(found.unionByName(latest))
    return found
