"""Terms of texts: how often each occurs, and which mark out a group of texts."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.ids import hot_keys, valid_id
from oremill.functions.shared import written

#: Characters that are no part of a term (fixed values).
DROPPED = "([,.!?:;])01\"23456789-\\&\u200b\ufeff\u00ad"
_TABLE = {ord(c): None for c in DROPPED}


def terms_of(text: str | None) -> list[str]:
    """The terms of one text, in order: lower case, NFC, without DROPPED, split at white space. None for null and wordless texts."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFC", low)
    return low.translate(_TABLE).split()


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null key. Rows of a key are redeliveries of the same record, so any of them will do."""
    return df.select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key])


def _emit(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _heavy_terms(records: DataFrame, key: str, text: str, most: int, sample_rows: int) -> list[str]:
    """Terms in at least 1 of 200 records of a bounded sample. It decides by which way a term is counted, never its counts."""
    step = max(1, records.count() // sample_rows)
    sample = records.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(text)
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for value in batch.column(0).to_pylist():
                seen.update(set(terms_of(value)))
        yield _emit(schema, [*seen, None], [*seen.values(), rows])

    counts = sample.mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = counts.where("term is null or (length(term) <= 200 and n > 1)").orderBy(F.col("term").isNotNull(), F.desc("n"), "term").limit(most + 1).collect()
    rows = next((r.n for r in found if r.term is None), 0)
    return [r.term for r in found if r.term is not None and r.n * 200 >= rows]


def term_counts(records: DataFrame, key: str = "review_id", text: str = "text", most_heavy: int = 4096, sample_rows: int = 20_000, flush: int = 300_000) -> DataFrame:
    """Occurrences of every term, and the records that hold it: (term, occurrences, records).

    A record is one key, however often it was delivered; rows without a key are left out. The row whose term is null has the
    number of records with at least one term. Null and wordless texts count nothing; an empty table gives only that row, or none.

    Heavy-light: terms found heavy in a bounded sample are broadcast, and every task counts them exactly in local arrays, of which
    it sends one row a term; other terms are pre-aggregated in a table that is emptied at `flush` entries, and only they
    go through the shuffle in number. Both tables then meet in one sum. `most_heavy` bounds the broadcast.
    """
    heavy = _heavy_terms(records, key, text, most_heavy, sample_rows)
    place = records.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(heavy)})
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        heavy_n, heavy_r = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        light_n: Counter = Counter()
        light_r: Counter = Counter()
        holding = 0
        for batch in batches:
            batch_n: Counter = Counter()
            batch_r: Counter = Counter()
            for value in batch.column(0).to_pylist():
                terms = terms_of(value)
                if terms:
                    holding += 1
                    batch_n.update(terms)
                    batch_r.update(set(terms))
            for term in at.keys() & batch_n.keys():
                heavy_n[at[term]] += batch_n.pop(term)
                heavy_r[at[term]] += batch_r.pop(term)
            light_n.update(batch_n)
            light_r.update(batch_r)
            if len(light_n) > flush:
                yield _emit(schema, list(light_n), list(light_n.values()), [light_r[t] for t in light_n])
                light_n.clear()
                light_r.clear()
        if light_n:
            yield _emit(schema, list(light_n), list(light_n.values()), [light_r[t] for t in light_n])
        seen = [t for t, i in at.items() if heavy_n[i]]
        yield _emit(schema, [*seen, None], [*(int(heavy_n[at[t]]) for t in seen), 0], [*(int(heavy_r[at[t]]) for t in seen), holding])

    local = one_per_key(records, key, text).select(text).mapInArrow(count, "term string, occurrences bigint, records bigint")
    return local.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(records: DataFrame, key: str = "review_id", text: str = "text", rare: int = 3, common: float = 0.3) -> DataFrame:
    """term_counts with a mark: `rare` below `rare` records, `common` above the share `common` of records with a term, else null.

    Columns term, occurrences, records, mark. A term that is both is `rare`.
    """
    counts = written(term_counts(records, key, text), "terms")
    total = next((r[0] for r in counts.where("term is null").select("records").collect()), 0)
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.lit(common) * total, "common")
    return counts.where("term is not null").withColumn("mark", mark)


# Terms by group -------------------------------------------------------------------------------------------------------

_ROWS = "kind string, grp string, term string, n bigint, top bigint, total bigint, texts bigint"


def group_terms(records: DataFrame, group: Column, stopwords: DataFrame, key: str = "review_id", text: str = "text", least_texts: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """Term counts of every group of records: (counts, frequencies, number of groups with a term).

    counts (grp, term, n, top, total): of groups with at least `least_texts` records that hold a term, stopwords counted there;
    n the term's count, top the highest count and total the sum of counts in the group, all without stopwords.
    frequencies (term, groups, n): groups that hold the term, and its count, over all groups.
    Rows with a null group or key are left out; a key delivered again counts once. Stopwords are trimmed, lower case, few (they
    are broadcast; a list over 100,000 is refused).

    The texts are shuffled once, by group; groups with more than a thousandth of the rows are spread by key and summed up later.
    """
    words = {w for (w,) in stopwords.select(F.lower(F.trim(stopwords.columns[0]))).distinct().limit(100_001).collect() if w}
    if len(words) > 100_000:
        raise ValueError("too many stopwords")
    words |= {t for w in words for t in terms_of(w)[:1] if t == w}
    rows = records.select(group.alias("grp"), F.col(key).alias("_key"), F.col(text).alias("_text")).where("grp is not null and _key is not null")
    hot = F.broadcast(hot_keys(rows, "grp"))
    salted = rows.join(hot, "grp", "left").withColumn("salt", F.when(F.col("pieces").isNull(), -1).otherwise(F.pmod(F.xxhash64("_key"), F.col("pieces")).cast("int")))
    once = salted.repartition("grp", "salt").dropDuplicates(["grp", "salt", "_key"]).select("grp", "salt", "_text").sortWithinPartitions("grp", "salt")
    schema = pa.schema([("kind", pa.string()), ("grp", pa.string()), ("term", pa.string()), *((c, pa.int64()) for c in ("n", "top", "total", "texts"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        groups_of: Counter = Counter()
        sum_of: Counter = Counter()
        groups = 0

        def put(kind: str, grp: str | None, terms: list, n: list, top: int | list, total: int, texts: int) -> None:
            m = len(terms)
            for column, values in zip(out, ([kind] * m, [grp] * m, terms, n, top if isinstance(top, list) else [top] * m, [total] * m, [texts] * m), strict=True):
                column.extend(values)

        def close(at: tuple[str, int], terms: Counter, texts: int) -> None:
            nonlocal groups
            for w in words & terms.keys():
                del terms[w]
            if at[1] >= 0:
                put("part", at[0], [*terms, None], [*terms.values(), 0], 0, 0, texts)
                return
            if not terms:
                return
            groups += 1
            groups_of.update(terms.keys())
            sum_of.update(terms)
            if texts >= least_texts:
                put("count", at[0], list(terms), list(terms.values()), max(terms.values()), sum(terms.values()), texts)

        def ready(all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out, groups
            if all_ or len(groups_of) > 300_000:
                put("term", None, [*groups_of, None], [*groups_of.values(), groups], [*(sum_of[t] for t in groups_of), 0], 0, 0)
                groups_of.clear()
                sum_of.clear()
                groups = 0
            if all_ or len(out[0]) > 50_000:
                if out[0]:
                    yield _emit(schema, *out)
                out = [[] for _ in schema]

        at: tuple[str, int] | None = None
        terms: Counter = Counter()
        texts = 0
        for batch in batches:
            for grp, salt, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != (grp, salt):
                    if at is not None:
                        close(at, terms, texts)
                        yield from ready(False)
                    at, terms, texts = (grp, salt), Counter(), 0
                found = terms_of(value)
                if found:
                    terms.update(found)
                    texts += 1
        if at is not None:
            close(at, terms, texts)
        yield from ready(True)

    table = written(once.mapInArrow(count, _ROWS), "groupterms", ["kind"])
    # Of spread groups: sums over their parts. A part's row without a term has its number of texts.
    parts = written(table.where("kind = 'part'").groupBy("grp", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "groupparts")
    sums = parts.groupBy("grp").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.max(F.when(F.col("term").isNull(), F.col("texts"))).alias("texts"))
    big = parts.where("term is not null").select("grp", "term", "n").join(F.broadcast(sums.where(F.col("texts") >= least_texts).drop("texts")), "grp")
    counts = table.where("kind = 'count'").select("grp", "term", "n", "top", "total").unionByName(big)
    of_parts = parts.where("term is not null").groupBy("term").agg(F.count("*").alias("n"), F.sum("n").alias("top"))
    frequencies = written(table.where("kind = 'term' and term is not null").select("term", "n", "top").unionByName(of_parts).groupBy("term").agg(F.sum("n").alias("groups"), F.sum("top").alias("n")), "groupfrequencies")
    number = table.where("kind = 'term' and term is null").agg(F.sum("n")).first()[0] or 0
    number += parts.where("term is not null").agg(F.count_distinct("grp")).first()[0]
    return counts, frequencies, number


def with_frequency(counts: DataFrame, frequencies: DataFrame, most_heavy: int = 65_536) -> DataFrame:
    """Join group counts with the terms' frequencies. Terms with over 1/most_heavy of all group entries are broadcast - there are
    fewer than most_heavy of them - so that only the rows of the others are shuffled."""
    frequencies = frequencies.select("term", "groups", F.col("n").alias("overall"))
    entries = frequencies.agg(F.sum("groups")).first()[0] or 0
    heavy = F.broadcast(frequencies.where((F.col("groups") * most_heavy > entries) & (F.length("term") <= 200)))
    light = frequencies.where(~((F.col("groups") * most_heavy > entries) & (F.length("term") <= 200)))
    return counts.join(heavy, "term").unionByName(counts.join(heavy.select("term"), "term", "left_anti").join(light, "term"))


def distinctive_terms(records: DataFrame, stopwords: DataFrame, group: str = "business_id", k: int = 3, least_texts: int = 5) -> DataFrame:
    """The k most distinctive terms of every group, by (count / highest count) * log2(groups / groups holding the term).

    Columns grp, term, score (6 places), place. Ties go to the smaller term. The group must be a valid id. See group_terms.
    """
    counts, frequencies, number = group_terms(records, valid_id(group), stopwords, least_texts=least_texts)
    score = F.round(F.col("n") / F.col("top") * F.log2(F.lit(float(max(number, 1))) / F.col("groups")), 6)
    best = Window.partitionBy("grp").orderBy(F.desc("score"), "term")
    scored = with_frequency(counts, frequencies).select("grp", "term", score.alias("score"))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


# Hypergeometric enrichment --------------------------------------------------------------------------------------------

#: Errors of Stirling's formula for log(n!), n = 0 to 15.
_STIRLING = np.array([0.0, *(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16))])


def stirling_error(n: np.ndarray) -> np.ndarray:
    """log(gamma(n + 1)) less Stirling's (n + 1/2) log n - n + log(2 pi) / 2, for whole n; 0 for n = 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = 1 / n
        q = r * r
        series = r * (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188))))
    return np.where(n < 16, _STIRLING[np.minimum(n, 15).astype(np.int64)], series)


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (x - mean) / (x + mean)
        near = (x - mean) * v
        term = 2 * x * v
        for j in range(1, 13):
            term = term * v * v
            near = near + term / (2 * j + 1)
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where((np.abs(v) < 0.1) & (x > 0), near, far)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log of the probability of x out of n, p + q = 1, by the errors of the log gammas and the deviances: what is large has no part in it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
        middle = middle - 0.5 * (np.log(2 * np.pi) + np.log(x) + np.log1p(-x / n))
        none = np.where(p < 0.1, n * np.log1p(-p), n * np.log(q))
        every = np.where(q < 0.1, n * np.log1p(-q), n * np.log(p))
    return np.where(n == 0, 0.0, np.where(x == 0, none, np.where(x == n, every, middle)))


def log_hypergeometric(x: np.ndarray, draws: np.ndarray, marked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log of P(X = x), x within the support: three binomials with p = draws / size, in place of differences of log gammas of the size, which lose all
    digits behind the point when the size is large."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = draws / size, (size - draws) / size
        sure = _log_binomial(x, marked, p, q) + _log_binomial(draws - x, size - marked, p, q) - _log_binomial(draws, size, p, q)
    return np.where((draws == 0) | (draws == size) | (marked == 0) | (marked == size), 0.0, sure)


def _sum_from(x: np.ndarray, step: int, draws: np.ndarray, marked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of P(X = x + i * step) / P(X = x) over i = 0, 1, .. until the terms are negligible or the support ends. One vector step each."""
    total, term, at = np.ones(len(x)), np.ones(len(x)), x.copy()
    least, most = np.maximum(0, draws + marked - size), np.minimum(marked, draws)
    live = np.flatnonzero(at < most if step > 0 else at > least)
    while len(live):
        k, m, d, s = at[live], marked[live], draws[live], size[live]
        ratio = (m - k) * (d - k) / ((k + 1) * (s - m - d + k + 1)) if step > 0 else k * (s - m - d + k) / ((m - k + 1) * (d - k + 1))
        term[live] *= ratio
        total[live] += term[live]
        at[live] += step
        going = (term[live] > total[live] * 1e-17) & ((at[live] < most[live]) if step > 0 else (at[live] > least[live]))
        live = live[going]
    return total


def log_upper_tail(k: np.ndarray, draws: np.ndarray, marked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Natural log of P(X >= k) for X hypergeometric: `draws` out of `size`, of which `marked` are marked. All vectors of whole numbers.

    Above the mean the terms are added from k upward, else from k - 1 downward and taken from 1; so a sum has no more than some standard deviations
    of terms.
    """
    k, draws, marked, size = (np.asarray(a, np.float64) for a in (k, draws, marked, size))
    least, most = np.maximum(0, draws + marked - size), np.minimum(marked, draws)
    out = np.zeros(len(k))
    upper = np.flatnonzero((k > least) & (k <= most) & (k * size > draws * marked))
    x, d, m, s = k[upper], draws[upper], marked[upper], size[upper]
    out[upper] = np.minimum(log_hypergeometric(x, d, m, s) + np.log(_sum_from(x, 1, d, m, s)), 0.0)
    lower = np.flatnonzero((k > least) & (k <= most) & (k * size <= draws * marked))
    x, d, m, s = k[lower] - 1, draws[lower], marked[lower], size[lower]
    below = np.exp(log_hypergeometric(x, d, m, s)) * _sum_from(x, -1, d, m, s)
    out[lower] = np.log1p(-np.minimum(below, 1 - 1e-16))
    out[k > most] = -np.inf
    return out


def enriched_terms(records: DataFrame, stopwords: DataFrame, group: str = "business_id", k: int = 3, least_texts: int = 5) -> DataFrame:
    """The k most enriched terms of every group: the exact hypergeometric probability of a count at least as high as the term has
    in the group, when the group's terms are drawn from all terms; adjusted for the false discovery rate over the group's terms
    (Benjamini and Hochberg). Columns grp, term, n, score (negative log10 of the adjusted probability, 6 places), place.

    Groups and terms as in group_terms; ties go to the larger count and then to the smaller term.

    A term's probability depends on its two counts only, so that a group's many rare terms have few different ones: the adjustment runs over these
    with their numbers of terms, and the places are cut at k before terms are shuffled.
    """
    counts, frequencies, _ = group_terms(records, valid_id(group), stopwords, least_texts=least_texts)
    size = frequencies.agg(F.sum("n")).first()[0] or 0
    schema = pa.schema([("grp", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("log_p", pa.float64())])

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total, overall = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            # Rare terms of a group have the same counts: each combination is worked out once.
            combos, at = np.unique(np.stack([n, total, overall]), axis=1, return_inverse=True)
            logs = log_upper_tail(*combos, np.full(combos.shape[1], size))[at.ravel()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(logs)], schema=schema)

    logs = with_frequency(counts, frequencies).select("grp", "term", "n", "total", "overall").mapInArrow(tail, "grp string, term string, n bigint, log_p double")
    logs = written(logs, "tails")
    values = logs.groupBy("grp", "log_p").agg(F.count("*").alias("ties"))
    whole = Window.partitionBy("grp")
    up_to = values.withColumn("upto", F.sum("ties").over(whole.orderBy("log_p"))).withColumn("m", F.sum("ties").over(whole))
    # The adjusted value is the least of this and all later ones; of equal ones the last place has the least.
    log_q = F.min(F.col("log_p") + F.log(F.col("m") / F.col("upto"))).over(whole.orderBy("log_p").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    adjusted = up_to.withColumn("log_q", F.least(F.lit(0.0), log_q)).select("grp", "log_p", "log_q")
    best = logs.withColumn("place", F.row_number().over(whole.orderBy("log_p", F.desc("n"), "term"))).where(F.col("place") <= k)
    score = F.round(-F.col("log_q") / F.lit(math.log(10)), 6) + F.lit(0.0)
    return best.join(adjusted, ["grp", "log_p"]).select("grp", "term", "n", score.alias("score"), "place")
