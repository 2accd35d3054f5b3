"""Operators for preparing language-model training data, and their registered queries."""

from solea.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
