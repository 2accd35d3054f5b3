"""Registered queries: each one applies library operators to the driver tables."""

from importlib import import_module

from solea.plans.registry import ORACLES, QUERIES

for _name in ("runs", "cases", "forms", "thermal", "splits", "pixels", "shapes", "saliency", "files", "learning", "streams"):
    try:
        import_module(f"solea.plans.{_name}")
    except ModuleNotFoundError as missing:
        if missing.name != f"solea.plans.{_name}":
            raise

# the survey's names of two queries
for _name, _known in (("pipeline_progress", "run_progress"), ("preprocess_pipeline", "preprocess_steps")):
    QUERIES[_name] = QUERIES[_known]
    if _known in ORACLES:
        ORACLES[_name] = ORACLES[_known]

__all__ = ["ORACLES", "QUERIES"]
