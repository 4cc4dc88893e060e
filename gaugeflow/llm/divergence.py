"""How the sources of a language differ in their words, with late materialization of the words.

Counting shuffles fixed-width digests of terms only. The strings of a digest come as the least and the greatest one that
any task saw; where the two differ, the digest stands for several terms and is counted anew by string. Text is joined
back just for the terms that the report names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm import arrays, terms
from gaugeflow.llm.shared import stored
from gaugeflow.operators.layout import small

FLUSH_ROWS = 1_000_000
CELL_ENTRIES = 1 << 17
STRIP = 1024
CELLS_TOGETHER = 256
SCALE = 10**9
KEPT_BROADCAST = 1_000_000  # digests of 8 bytes


def _digests(words: pa.Array, bits: int) -> np.ndarray:
    """A digest of each of some distinct strings, `bits` wide."""
    data, offsets = arrays.flat(words)
    out, some = np.zeros(len(words), np.uint64), np.diff(offsets) > 0  # the separator between two terms may be empty
    out[some] = arrays.hashes(data, arrays.Spans(offsets[:-1][some], offsets[1:][some], np.zeros(int(some.sum()), np.int64)))
    return (out >> np.uint64(64 - bits)).view(np.int64)


def _numbers(column: pa.Array, known: dict) -> np.ndarray:
    coded = column.dictionary_encode()
    own = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int64)
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)


def _per_row(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, code, count, the strings of the codes) of the distinct terms of each row; a row comes once."""
    held: list[tuple[np.ndarray, pa.Array]] = []

    def close():
        row = np.concatenate([r for r, _ in held])
        words = pa.concat_arrays([w.dictionary_decode() if pa.types.is_dictionary(w.type) else w for _, w in held])
        coded = words.dictionary_encode()
        (code, of), (count,) = terms.distinct(coded.indices.to_numpy().astype(np.int64), row, weights=[np.ones(len(row), np.int64)])
        return of, code, count, coded.dictionary

    for words, row in terms.pieces(batch.column(at), terms.LETTERS):
        if not len(row):
            continue
        if held and held[-1][0][-1] != row[0]:
            yield close()
            held = []
        held.append((row, words.take(pa.array(np.arange(0, len(words), 2)))))
    if held:
        yield close()


def _frequencies(bits: int):
    """Rows (lang, digest, docs): in how many of the task's documents of a language a digest occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held, size = [], 0

        def merged():
            (digest, lang), (docs,) = terms.distinct(*(np.concatenate(x) for x in list(zip(*held))[:2]), weights=[np.concatenate([h[2] for h in held])])
            return digest, lang, docs

        def out():
            digest, lang, docs = merged()
            return pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(lang)), pa.array(digest), pa.array(docs)], ["lang", "digest", "docs"])

        for batch in batches:
            of_row = _numbers(batch.column(0), langs)
            for row, code, _, words in _per_row(batch, 2):
                digest = _digests(words, bits)[code]
                (digest, row), _ = terms.distinct(digest, row, weights=[])  # a document with two terms of a digest counts once
                (digest, lang), (docs,) = terms.distinct(digest, of_row[row], weights=[np.ones(len(row), np.int64)])
                held.append((digest, lang, docs))
                size += len(digest)
            if size > FLUSH_ROWS:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH_ROWS // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _counts(bits: int):
    """Rows (lang, source, digest, count, low, high): counts by group; one row per language and digest has its least and greatest string."""
    names = ["lang", "source", "digest", "count", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        sources: dict[str, int] = {}
        held, words_held, size = [], [], 0

        def merged():
            (digest, source, lang), (count,) = terms.distinct(*(np.concatenate(x) for x in list(zip(*held))[:3]), weights=[np.concatenate([h[3] for h in held])])
            return digest, source, lang, count

        def out():
            digest, source, lang, count = merged()
            words = pa.chunked_array(words_held).unique()
            own = _digests(words, bits)
            order = np.argsort(own, kind="stable")
            own, words = own[order], words.take(pa.array(order))
            low = high = words
            if len(own) > 1 and (own[1:] == own[:-1]).any():  # rare: several strings of a digest
                table = pa.table({"digest": own, "word": words.cast(pa.binary())}).sort_by([("digest", "ascending"), ("word", "ascending")])
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                last = np.concatenate((first[1:], [len(own)])) - 1
                own, low, high = own[first], table.column("word").take(pa.array(first)).combine_chunks(), table.column("word").take(pa.array(last)).combine_chunks()
            by_lang = np.lexsort((source, digest, lang))
            digest, source, lang, count = digest[by_lang], source[by_lang], lang[by_lang], count[by_lang]
            first = np.ones(len(digest), bool)
            first[1:] = (digest[1:] != digest[:-1]) | (lang[1:] != lang[:-1])
            at = pa.array(np.searchsorted(own, digest), mask=~first)
            text = lambda x: x.take(at).cast(pa.binary()).cast(pa.string())
            columns = [pa.array(list(langs), pa.string()).take(pa.array(lang)), pa.array(list(sources), pa.string()).take(pa.array(source)), pa.array(digest), pa.array(count), text(low), text(high)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            lang_of, source_of = _numbers(batch.column(0), langs), _numbers(batch.column(1), sources)
            for row, code, count, words in _per_row(batch, 2):
                (digest, source, lang), (count,) = terms.distinct(_digests(words, bits)[code], source_of[row], lang_of[row], weights=[count])
                held.append((digest, source, lang, count))
                words_held.append(words)
                size += len(digest)
            if size > FLUSH_ROWS:
                held, words_held = [merged()], [pa.chunked_array(words_held).unique()]
                pa.default_memory_pool().release_unused()
                size = len(held[0][0])
                if size > FLUSH_ROWS // 2:
                    yield out()
                    held, words_held, size = [], [], 0
        if held:
            yield out()

    return run


def _strings(bits: int):
    """Rows (lang, source, digest, split, count, docs) by string, for digests that stand for several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: dict[str, int] = {}
            sources: dict[str, int] = {}
            lang_of, source_of = _numbers(batch.column(0), langs), _numbers(batch.column(1), sources)
            for row, code, count, words in _per_row(batch, 2):
                (code, source, lang), (count, docs) = terms.distinct(code, source_of[row], lang_of[row], weights=[count, np.ones(len(row), np.int64)])
                columns = [pa.array(list(langs), pa.string()).take(pa.array(lang)), pa.array(list(sources), pa.string()).take(pa.array(source)), pa.array(_digests(words, bits)[code])]
                yield pa.RecordBatch.from_arrays([*columns, words.take(pa.array(code)).cast(pa.binary()).cast(pa.string()), pa.array(count), pa.array(docs)], ["lang", "source", "digest", "split", "count", "docs"])

    return run


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total), exact in 64 bits for totals below 2^53: nine digits, three at a time."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def _cell(smoothing: int, most: int):
    """Parts of the sums over pairs of groups, and candidates of the term report, from some terms of a language in all its groups."""
    schema = pa.schema([("gid", pa.int64()), ("other", pa.int64()), ("digest", pa.int64()), ("split", pa.string()), ("value", pa.int64())])

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        if not counts.num_rows or not groups.num_rows:
            return schema.empty_table()
        groups = groups.sort_by("gid")
        gid, total = (groups.column(c).to_numpy() for c in ("gid", "total"))
        strip, v = groups.column("strip")[0].as_py(), groups.column("terms")[0].as_py()
        column = np.searchsorted(gid, counts.column("gid").to_numpy())
        split = counts.column("split").combine_chunks().dictionary_encode()
        key = counts.column("digest").to_numpy(), split.indices.to_numpy().astype(np.int64)
        order = np.lexsort(key)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in key])
        term = np.empty(len(order), np.int64)
        term[order] = np.cumsum(new) - 1
        sample = order[np.flatnonzero(new)]
        own = np.zeros((len(gid), len(sample)), np.int64)
        own[column, term] = counts.column("count").to_numpy()
        p = shares(own + smoothing, (total + smoothing * v)[:, None])
        first = strip * STRIP
        a, b, value = [], [], []
        for g in range(first, min(first + STRIP, len(gid))):
            a.append(np.full(len(gid) - g - 1, gid[g]))
            b.append(gid[g + 1 :])
            value.append(np.abs(p[g + 1 :] - p[g]).sum(axis=1))
        parts = [pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.nulls(sum(map(len, a)), pa.int64()), pa.nulls(sum(map(len, a)), pa.string()), pa.array(np.concatenate(value))], schema=schema)]
        if strip == 0:
            whole = own.sum(axis=0)
            q = shares(whole + smoothing, int(total.sum()) + smoothing * v)
            names = split.dictionary.take(pa.array(key[1][sample]))
            for g in range(len(gid)):
                more = np.flatnonzero((own[g] > 0) & (p[g] > q))
                f = p[g][more] - q[more]
                if len(f) > most:
                    keep = f >= np.partition(f, -most)[-most]  # with all ties of the last place
                    more, f = more[keep], f[keep]
                parts.append(pa.table([pa.array(np.full(len(f), gid[g])), pa.nulls(len(f), pa.int64()), pa.array(key[0][sample[more]]), names.take(pa.array(more)), pa.array(f)], schema=schema))
        return pa.concat_tables(parts)

    return run


def audit(docs: DataFrame, *, least_docs: int = 30, smoothing: int = 5, most: int = 50, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows (text, lang, source) of docs; nulls count as ''.

    A language keeps the terms in at least least_docs of its documents. Every group (lang, source) and every language
    gives each kept term the share p = 1 + floor(10^9 (count + smoothing) / (N + smoothing V)). Part `pair`: the sum of
    |p - q| over the kept terms for every other source of the language, all ranks. Part `term`: the kept terms that
    occur in the group and have more share there than in the language, by p - q, ranks to `most`. Ranks go by value,
    greatest first, then by the UTF-8 bytes of the item. Every row is a document, repeated ones too. Empty and very long
    texts are read whole, a few MB at a time. A group without terms has its pairs; a language without kept terms has
    pairs of value 0; empty input gives no rows; other columns are not read.

    A task counts its documents before anything is shuffled, so a frequent term or a large group is a few rows per task.
    Terms of a language are dealt into cells of about CELL_ENTRIES counts, which hold those of all its groups.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    bits = digest_bits

    found = stored(docs.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()))  # written: numbers stay
    langs = found.groupBy("lang").agg(F.min("gid").alias("lid"), F.count(F.lit(1)).alias("groups"))
    groups = stored(found.join(langs, "lang"))
    langs = groups.select("lang", "lid", "groups").distinct()

    frequent = docs.mapInArrow(_frequencies(bits), "lang string, digest long, docs long").join(small(langs), "lang")
    kept = stored(frequent.groupBy("lid", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lid", "digest"))
    counted = docs.mapInArrow(_counts(bits), "lang string, source string, digest long, count long, low string, high string")
    ids = small(groups.select("lang", "source", "lid", "gid"))
    seen = stored(counted.join(ids, ["lang", "source"]).select("lid", "gid", "digest", "count", "low", "high").join(small(kept, KEPT_BROADCAST), ["lid", "digest"], "left_semi"))
    names = stored(seen.where("low IS NOT NULL").groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")))

    counts = seen.groupBy("lid", "gid", "digest").agg(F.sum("count").alias("count")).withColumn("split", F.lit(""))
    several = names.where("low <> high").select("digest")
    if not several.isEmpty():
        by_string = docs.mapInArrow(_strings(bits), "lang string, source string, digest long, split string, count long, docs long")
        by_string = by_string.join(small(several, KEPT_BROADCAST), "digest", "left_semi").join(ids, ["lang", "source"])
        by_string = stored(by_string.groupBy("lid", "gid", "digest", "split").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
        enough = by_string.groupBy("lid", "digest", "split").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        alone = counts.join(small(several, KEPT_BROADCAST), "digest", "left_anti")
        counts = alone.unionByName(by_string.drop("docs").join(enough.drop("docs"), ["lid", "digest", "split"], "left_semi"))
    counts = stored(counts)

    size = counts.select("lid", "digest", "split").distinct().groupBy("lid").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("gid").agg(F.sum("count").alias("total"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = stored(groups.join(totals, "gid", "left").join(size, "lid", "left").select("lang", "source", "lid", "gid", "groups", none("total"), none("terms")))

    cells = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("groups") / CELL_ENTRIES)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    strips = F.ceil(F.col("groups") / STRIP).cast("long")
    dealing = small(groups.select("lid", cells.alias("cells"), strips.alias("strips")).distinct())
    left = counts.join(dealing, "lid").select("lid", "gid", "digest", "split", "count", F.pmod(F.xxhash64("digest", "split"), F.col("cells")).alias("cell"), every(F.col("strips")).alias("strip"))
    right = groups.select("lid", "gid", "total", "terms", "groups", every(cells).alias("cell")).select("*", every(strips).alias("strip"))
    told = stored(left.groupBy("lid", "cell", "strip").cogroup(right.groupBy("lid", "cell", "strip")).applyInArrow(_cell(smoothing, most), "gid long, other long, digest long, split string, value long"))

    named = groups.select("lid", "gid", "lang", "source")
    other = named.select("lid", F.col("gid").alias("other"), F.col("source").alias("item"))
    sums = told.where("other IS NOT NULL").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
    pairs = named.join(other, "lid").where("gid <> other").join(both, ["gid", "other"], "left")
    order = [F.desc("value"), F.asc("item")]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", none("value")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    # two levels, so that no task ranks the candidates of all cells of a group
    best = told.where("other IS NULL").withColumn("some", F.pmod(F.xxhash64("digest"), F.lit(CELLS_TOGETHER)))
    for by in (["gid", "some"], ["gid"]):
        best = best.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("value")))).where(F.col("rank") <= most)
    item = F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split"))
    best = best.join(names, "digest").join(small(named), "gid").select("lang", "source", F.lit("term").alias("part"), item.alias("item"), "value")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= most)
    return pairs.unionByName(best)
