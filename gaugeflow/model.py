"""Plain Python descriptions that the operators turn into plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status words stored in rule, document and job tables.
SENSOR_STATUSES = ("no_sensors", "sensors_not_found", "ok")
TIME_STATUSES = ("ok", "parse_error", "invalid_statistic")
VERIFICATION_STATUSES = ("ok", "syntax_error", "invalid_sensor", "invalid_time", "invalid_statistic")
LIFECYCLE_STATUSES = ("extracted", "consolidated", "superseded")
JOB_STATUSES = ("pending", "running", "completed", "failed")
SYNC_STATUSES = ("not_uploaded", "uploading", "uploaded", "failed")
ACTION_TYPES = ("remove", "merge", "simplify")
VERIFIED_STATISTICS = ("mean", "max", "min", "std", "variance")

# Configured bounds.
MAX_RULES_PER_BATCH = 50
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
PREVIEW_LENGTH = 500
RETRIEVAL_DEPTH = 5


@dataclass(frozen=True)
class Requirement:
    """One feature a rule reads: a sensor, a time expression and, for intervals, a statistic."""

    sensor_id: str
    time_expression: str
    statistic: str | None = None

    @property
    def name(self) -> str:
        """Column that holds this feature once sensors are side by side."""
        return "|".join([self.sensor_id, self.series])

    @property
    def series(self) -> str:
        """Column that holds this feature while sensors are still rows."""
        return self.time_expression + ("" if self.statistic is None else "@" + self.statistic)


class Status:
    """Hands rules the column of a feature and remembers which ones were asked for."""

    def __init__(self) -> None:
        self.requirements: dict[Requirement, None] = {}

    def get(self, sensor_id: str, time_expression: str, statistic: str | None = None) -> Column:
        req = Requirement(sensor_id, time_expression, statistic)
        self.requirements[req] = None
        return F.col(f"`{req.name}`")


@dataclass(frozen=True)
class Rule:
    """A rule as a predicate: ``when(status)`` returns a boolean column."""

    name: str
    when: Callable[[Status], Column]
    result: str
    description: str = ""

    def compile(self) -> tuple[Column, list[Requirement]]:
        status = Status()
        predicate = self.when(status)
        return predicate, list(status.requirements)


@dataclass(frozen=True)
class RuleFunction:
    """A rule as ordinary Python: ``fn(status)`` returns a text or None, run on Arrow batches."""

    name: str
    fn: Callable
    requirements: tuple[Requirement, ...]
    description: str = ""


@dataclass(frozen=True)
class CheckerConfig:
    """How readings turn into features.

    max_history_buffer_size  lookbacks of so many samples or more are null; None: no bound
    mode            "samples" counts non-null samples, "time" uses the clock
    end_offset      "honour" ends ``1h:5m`` five minutes ago, "ignore" ends it now
    warmup          "null" or "zero": value of mean, sum, std, variance before enough samples
    layout          "auto" looks at the row count of each sensor, "plain" keeps a sensor in
                    one task, "split" cuts every sensor into ranges
    max_task_rows   rows of one sensor that may stay in one task under "auto"
    wide_window     window length from which block aggregation replaces sliding frames
    """

    granularity: str = "1m"
    skip_on_missing_data: bool = True
    max_history_buffer_size: int | None = None
    mode: str = "samples"
    end_offset: str = "honour"
    warmup: str = "null"
    min_samples: int = 1
    layout: str = "auto"
    max_task_rows: int = 4_000_000
    wide_window: int = 64
    quantile: float = 0.5
    options: dict = field(default_factory=dict, hash=False)
