"""Column names of an activity log.

The operators never hard-code a column name: they take a ``LogColumns``.  The
defaults are the names of the product-trial export the library was designed for,
so such a log works without configuration.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LogColumns:
    org: str = "ORGANIZATION_ID"
    activity: str = "ACTIVITY_NAME"
    ts: str = "TIMESTAMP"
    converted: str = "CONVERTED"
    converted_at: str = "CONVERTED_AT"
    trial_start: str = "TRIAL_START"
    trial_end: str = "TRIAL_END"
    # Input order of the log.  Every "first row" rule (keep-first dedup, the
    # org's first trial duration) orders by it; None means "no order given",
    # in which case per-org constants are read with max().
    order: str | None = "EVENT_ID"

    @property
    def timestamps(self) -> list[str]:
        return [self.ts, self.converted_at, self.trial_start, self.trial_end]

    @property
    def dedup_key(self) -> list[str]:
        return [self.org, self.activity, self.ts]


DEFAULT_COLUMNS = LogColumns()
