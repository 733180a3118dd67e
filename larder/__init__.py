"""Retail inventory analytics as plain PySpark DataFrame functions."""

from larder.params import Params

__all__ = ["Params"]
