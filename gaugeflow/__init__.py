"""gaugeflow: rule monitoring over sensor readings, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

from gaugeflow.model import CheckerConfig, Requirement, Rule, RuleFunction

__all__ = ["CheckerConfig", "Requirement", "Rule", "RuleFunction"]

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
