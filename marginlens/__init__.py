"""Margin analytics as Spark DataFrame operators."""

from marginlens.params import Params

__all__ = ["Params"]
