"""Small tables with every kind of odd row."""

import random

# Columns that operators use inside or give out: input columns of these names must not get in the way.
CLASHING = ["row", "key", "code", "size", "label", "block", "payload", "score", "root", "component", "n_bytes", "kept", "target", "repeats", "trusted", "_text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    full = [(k, t, lang, s, len(t) if t else 0, *("x" for _ in CLASHING)) for k, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and copies."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(30)]
    passage = sentence(rng, 30)
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s0") for i in range(6)]  # copies
    rows += [(200 + i, base[i] + " " + passage + " " + base[-i - 1], None, None) for i in range(5)]
    rows += [(300, None, "en", "s1"), (301, "", "en", "s1"), (302, " \t\n ", None, "s2"), (303, "é", "fr", None), (304, "日本語 テスト " * 30, "ja", "s9")]
    rows += [(305, sentence(rng, 20_000), "en", "s0"), (306, "a" * 70, "en", "s3"), (307, "a" * 90, "en", "s3")]
    rows += [(None, base[3], "en", "s1"), (None, None, None, None), (310, base[4], "en", "s2"), (310, base[4], "en", "s2"), (310, base[5], "en", "s2")]
    return rows
