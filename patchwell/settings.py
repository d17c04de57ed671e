"""Review parameters, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from patchwell.functions.rules import Rule


@dataclass(frozen=True)
class ReviewSettings:
    """Rule switches and thresholds of one review job."""

    console_log: bool = True
    debugger: bool = True
    secrets: bool = True
    todos: bool = True
    large_functions: bool = True
    type_any: bool = True
    ts_directive: bool = True
    #: added lines in one hunk from which the large-block rule fires
    large_hunk: int = 50
    #: score from which a review counts as clean (streaks, bands)
    good_score: int = 80
    #: score from which a review is a warning rather than bad
    warn_score: int = 50
    #: reviews kept per repository in the recent-history view
    keep_reviews: int = 50
    #: findings at most this many lines apart share a proximity group
    group_gap: int = 5
    #: changed lines in one file above which the file is at least medium risk
    large_change: int = 100
    #: line rules a job adds to the built-in ones
    added_rules: tuple[Rule, ...] = ()


DEFAULTS = ReviewSettings()
