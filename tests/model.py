"""A plain evaluator of features, one reading at a time, to hold the operators against."""

import numpy as np

from gaugeflow.functions.timeexpr import Interval

STATISTICS = {
    "mean": np.mean,
    "sum": np.sum,
    "max": np.max,
    "min": np.min,
    "abs_max": lambda a: np.abs(a).max(),
    "variance": lambda a: a.var(ddof=1) if len(a) > 1 else None,
    "std": lambda a: a.std(ddof=1) if len(a) > 1 else None,
    "quantile": np.median,
    "iqr": lambda a: np.quantile(a, 0.75) - np.quantile(a, 0.25),
    "mode": lambda a: (lambda u, c: u[c.argmax()])(*np.unique(a, return_counts=True)),
}


def feature(samples, current, requirement, step_us=60_000_000, cap=1440):
    try:
        when = Interval.parse(requirement.time_expression)
    except ValueError:
        return None
    if not when.is_interval:
        if not when.start:
            return current
        back = when.start.us // step_us
        return samples[-1 - back] if len(samples) > back and back < cap else None
    size, end = when.length.us // step_us, when.end.us // step_us
    if size <= 0 or not requirement.statistic:
        return None
    window = samples[max(0, len(samples) - size - end) : len(samples) - end] if len(samples) > end else []
    if requirement.statistic == "count":
        return float(len(window))
    if requirement.statistic not in STATISTICS or not window:
        return None
    return STATISTICS[requirement.statistic](np.array(window))


def features(rows, requirements):
    """{(asset, sensor_id, ts_us, seq): [feature, ...]} of canonical rows given as dicts."""
    out, samples = {}, {}
    for row in sorted(rows, key=lambda r: (r["ts_us"], r["seq"])):
        own = samples.setdefault((row["asset"], row["sensor_id"]), [])
        if row["value"] is not None:
            own.append(row["value"])
        out[row["asset"], row["sensor_id"], row["ts_us"], row["seq"]] = [feature(own, row["value"], r) for r in requirements]
    return out


def alike(got, want):
    """Equal up to rounding, with None only where None is due."""
    return len(got) == len(want) and all((g is None) == (w is None) and (g is None or np.isclose(g, w)) for g, w in zip(got, want))
