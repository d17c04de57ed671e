"""Change-review analytics over tables of diffs, built on Spark DataFrames."""

from patchwell.settings import DEFAULTS, ReviewSettings

__all__ = ["DEFAULTS", "ReviewSettings"]
