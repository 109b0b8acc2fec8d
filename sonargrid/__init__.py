"""Sonargrid: conversational-audio timelines and training-data pipelines as Spark DataFrame operators."""

from __future__ import annotations

import os
from pathlib import Path


def on_workers(spark) -> None:
    """Let Python workers import this package from where the driver has it, for functions defined after the call.

    A cluster whose nodes don't share that folder installs the package or ships it with --py-files; then this changes nothing.
    """
    home = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in (spark.sparkContext.environment.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])
