"""Weighted, systematics-aware histogram analysis on Spark DataFrames."""

from binloom.config import (
    Alias, Cut, Edges, Nuisance, Sample, Uniform, Variable,
)
from binloom.operators.fill import fill
from binloom.operators.analysis import Analysis

__all__ = [
    "Alias", "Analysis", "Cut", "Edges", "Nuisance", "Sample", "Uniform", "Variable", "fill",
]
