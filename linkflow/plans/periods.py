"""The periods of a forecast study: what is trained on, what is tested, what is scored.

The registered queries use ``PERIODS``; every function that splits by date takes others.
"""

from __future__ import annotations

from typing import NamedTuple


class Periods(NamedTuple):
    """Dates; ends are exclusive but for ``eval_to``, the last moment scored."""

    train_before: str
    test_from: str
    test_before: str
    eval_from: str
    eval_to: str


PERIODS = Periods("2024-01-22", "2024-01-23", "2024-01-27", "2024-01-23", "2024-01-26")
