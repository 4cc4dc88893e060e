import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import timeexpr as te

S = 1_000_000
# text, start, end, is it an interval; None: does not parse
CASES = [
    ("0", 0, None, False),
    ("5m", 300 * S, None, False),
    ("1h30m", 5400 * S, None, False),
    ("250ms", S // 4, None, False),
    ("2y1d", 731 * 86400 * S, None, False),
    ("10m:", 600 * S, 0, True),
    ("1h:5m", 3600 * S, 300 * S, True),
    ("2h:1h", 7200 * S, 3600 * S, True),
    ("5m:10m", 300 * S, 600 * S, True),
    (" 5m ", 300 * S, None, False),
    ("1.5s:", 1_500_000, 0, True),
    ("", None, None, None),
    (":5m", None, None, None),
    ("abc", None, None, None),
    ("x5m!", None, None, None),
    ("-5m", None, None, None),
    ("5m:abc", None, None, None),
    ("999999999999y", None, None, None),
]


def parsed(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    rows = df.select("i", te.interval(F.col("t"), **options).alias("p")).orderBy("i").collect()
    return [r.p for r in rows]


def test_columns(spark):
    for (text, start, end, kind), got in zip(CASES, parsed(spark, [c[0] for c in CASES])):
        want = None if kind is None else (start, end, kind)
        assert (None if got is None else tuple(got)) == want, text


@pytest.mark.parametrize("text,start,end,kind", CASES)
def test_driver(text, start, end, kind):
    if kind is None:
        with pytest.raises(ValueError):
            te.Interval.parse(text)
        return
    got = te.Interval.parse(text)
    assert (got.start.us, got.end.us if got.end is not None else None, got.is_interval) == (start, end, kind)


def test_lenient_and_negative(spark):
    assert parsed(spark, ["x5m!"], strict=False)[0].start_us == 300 * S
    assert parsed(spark, ["-5m"], allow_negative=True)[0].start_us == -300 * S
    assert te.Duration.parse("x5m!", strict=False) == te.Duration(300 * S)
    assert te.Duration.parse("- 5m", allow_negative=True) == te.Duration(-300 * S)


def test_text(spark):
    texts = ["1h30m", "0", "90m", "400d", "1500us", "1h:5m", "10m:"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", te.interval_text(te.interval(F.col("t"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["1h30m", "0", "1h30m", "1y35d", "1ms500us", "1h:5m", "10m:0"]


def test_duration_arithmetic():
    a, b = te.Duration.parse("1h"), te.Duration.parse("90m")
    assert (a + b).us == 9000 * S and (a - b) == -te.Duration(1800 * S) and abs(a - b) < a < b
    assert float(a) == 3600.0 and int(te.Duration(1_999_999)) == 1 and not te.Duration(0)


def test_window_samples(spark):
    df = spark.range(1).select(*[te.window_samples(F.lit(v), te.UNIT_US["m"]).alias(str(v)) for v in (-1, 0, 59 * S, 60 * S, 601 * S)])
    assert list(df.first()) == [None, None, None, 1, 10]
