"""Passages of evaluation items inside texts, whole or in part, also with single words changed."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of characters that count one by one, as their scripts have no spaces: Thai, Hiragana, Katakana, Han (fixed values).
SINGLE = ((0x0E01, 0x0E2E), (0x0E2F, 0x0E5B), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))


class _Plain(dict):
    """Translation of decomposed lower case characters, filled as they come: marks and invisible ones vanish, letters and digits stay,
    characters of SINGLE stand alone, all others separate words."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf") or code in (0x034F, 0x115F, 0x1160, 0x3164):
            to = None
        elif not (c.isalnum() or kind == "Mc"):
            to = " "
        elif any(a <= code <= b for a, b in SINGLE):
            to = f" {c} "
        else:
            to = c
        self[code] = to
        return to


_PLAIN = _Plain()


def words_of(text: str | None) -> list[str]:
    """Words for comparison: without case, accents, punctuation and invisible characters; single characters where SINGLE says so."""
    if not text:
        return []
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()).translate(_PLAIN).split()


def _alone(word: str) -> bool:
    return len(word) == 1 and any(a <= ord(word) <= b for a, b in SINGLE)


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of every window of `size` words. Shingles are words, of weight 1, and neighbouring pairs, of weight 2."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)

    def signs(h: np.ndarray) -> np.ndarray:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8) * 2 - 1

    with np.errstate(over="ignore"):
        pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] + (hashes[1:] >> np.uint64(29)))
        pairs ^= pairs >> np.uint64(31)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
        pairs ^= pairs >> np.uint64(27)
    words, two = signs(hashes), signs(pairs) * 2
    total = np.zeros((n, 64), np.int8 if 3 * size < 128 else np.int16)
    for i in range(size):
        total += words[i : i + n]
        if i < size - 1:
            total += two[i : i + n]
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class HammingIndex:
    """Finds all fingerprints within a radius: of radius + 1 blocks of the 64 bits at least one is equal, so each block has a table."""

    def __init__(self, prints: np.ndarray, radius: int = 3) -> None:
        self.prints, self.radius = prints, radius
        blocks = radius + 1
        width = 64 // blocks
        self.shifts = [np.uint64(i * width) for i in range(blocks)]
        self.mask = np.uint64((1 << width) - 1)
        self.tables = []
        for s in self.shifts:
            keys = ((prints >> s) & self.mask).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            first = np.searchsorted(keys[order], np.arange((1 << width) + 1))
            self.tables.append((order, first))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, print number) of all that differ in at most `radius` bits; a pair may come out more than once."""
        found_q, found_p = [], []
        for s, (order, first) in zip(self.shifts, self.tables, strict=True):
            keys = ((queries >> s) & self.mask).astype(np.int64)
            n = first[keys + 1] - first[keys]
            q = np.repeat(np.arange(len(queries)), n)
            within = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            p = order[np.repeat(first[keys], n) + within]
            fits = np.bitwise_count(queries[q] ^ self.prints[p]) <= self.radius
            found_q.append(q[fits])
            found_p.append(p[fits])
        return np.concatenate(found_q), np.concatenate(found_p)


def _reach(item: list, text: list, most: int) -> list[int]:
    """For 0, 1, .. `most` edits: how many of the item's first words the text's first words match, ending with an equal word.
    An edit is a word replaced, added or missing. Furthest reaching points by diagonal."""

    def slide(p: int, d: int) -> int:
        while p < len(item) and d < len(text) and item[p] == text[d]:
            p += 1
            d += 1
        return p

    at = {0: slide(0, 0)}
    best = [at[0]]
    for _ in range(most):
        to: dict[int, int] = {}
        top = best[-1]
        for shift, p in at.items():
            for new, q in ((shift, p + 1), (shift - 1, p + 1), (shift + 1, p)):
                if q <= len(item) and 0 <= q + new <= len(text):
                    r = slide(q, q + new)
                    if r > q and r > top:
                        top = r
                    if r > to.get(new, -1):
                        to[new] = r
        best.append(top)
        at = to
    return best


class Passages:
    """The items' passages, indexed by the fingerprints of their windows."""

    def __init__(self, items: list[tuple[int, str]], words: int = 12, singles: int = 30, one_in: int = 8, window: int = 5, single_window: int = 6, radius: int = 3) -> None:
        self.one_in = one_in
        self.ids = [i for i, _ in items]
        self.texts = [words_of(t) for _, t in items]
        alone = [2 * sum(map(_alone, t)) > len(t) for t in self.texts]
        self.need = [singles if a else words for a in alone]
        self.shingles = [(frozenset(t), frozenset(zip(t, t[1:], strict=False))) for t in self.texts]
        self.indexes = []
        for size, of_singles in ((window, False), (single_window, True)):
            prints, item, place = [], [], []
            for k, t in enumerate(self.texts):
                if alone[k] == of_singles and len(t) >= self.need[k] - 1:
                    f = fingerprints(hashed(t), size)
                    prints.append(f)
                    item += [k] * len(f)
                    place += range(len(f))
            if item:
                self.indexes.append((size, HammingIndex(np.concatenate(prints), radius), np.array(item), np.array(place)))

    def seeds(self, texts: list[list[str]]) -> dict[tuple[int, int], set[tuple[int, int]]]:
        """(text, item) -> places (in the text, in the item) whose windows have near fingerprints."""
        flat = [w for t in texts for w in t]
        found: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        if not flat:
            return found
        lengths = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
        start = np.cumsum(lengths) - lengths
        hashes = hashed(flat)
        for size, index, item, place in self.indexes:
            for a in range(0, len(hashes), 100_000):
                part = hashes[a : a + 100_000 + size - 1]
                q, p = index.near(fingerprints(part, size))
                q = q + a
                inside = owner[q] == owner[np.minimum(q + size - 1, len(owner) - 1)]
                for t, d, k, at in zip(owner[q][inside], q[inside], item[p][inside], place[p][inside], strict=True):
                    found[int(t), int(k)].add((int(d - start[t]), int(at)))
        return found

    def similar(self, text: list[str], k: int, d: int) -> bool:
        """Whether the words around place d have the weight that a case has in common with the item: words count 1, neighbouring pairs 2. A case's
        `need` words with e = need // one_in edits keep need - e words and need - 1 - 2 e pairs; longer ones keep more."""
        need = self.need[k]
        edits = need // self.one_in
        wanted = need - edits + 2 * (need - 1 - 2 * edits)
        words, pairs = self.shingles[k]
        part = text[max(0, d - 2 * need) : d + 2 * need + 2 * need // self.one_in]
        weight = sum(w in words for w in part)
        if weight * 3 < wanted:
            return False
        return weight + 2 * sum(x in pairs for x in zip(part, part[1:], strict=False)) >= wanted

    def carried(self, text: list[str], k: int, seeds: set[tuple[int, int]]) -> bool:
        """Whether the text carries at least `need` successive words of item k, with at most one edit in `one_in` of them, around one of the seeds.

        A longer run can be cut into pieces of need to 2 need - 1 words, and one of them has no more than its share of the edits: so it is enough
        to look for such a piece, that is less than 2 need words to either side of a seed, with less than 2 need / one_in edits.
        """
        item, need, one_in = self.texts[k], self.need[k], self.one_in
        far = 2 * need - 1
        most = far // one_in
        done: set[tuple[int, int]] = set()
        for d, p in sorted(seeds):
            if (d - p, p) in done or item[p] != text[d]:
                continue
            a, b = p, p
            while a > 0 and d - (p - a) > 0 and item[a - 1] == text[d - (p - a) - 1]:
                a -= 1
            while b < len(item) and d + b - p < len(text) and item[b] == text[d + b - p]:
                b += 1
            done.update((d - p, x) for x in range(a, b))
            if b - a >= need:
                return True
            if not self.similar(text, k, d):
                continue
            at, to = d - (p - a), d + b - p
            ahead = _reach(item[b : b + far], text[to : to + far + most], most)
            back = _reach(item[max(0, a - far) : a][::-1], text[max(0, at - far - most) : at][::-1], most)
            for i, x in enumerate(back):
                for j, y in enumerate(ahead):
                    n = x + b - a + y
                    if n >= need and (i + j) * one_in <= n:
                        return True
        return False

    def found(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(text, item) of all texts that carry enough of an item."""
        return [(t, k) for (t, k), seeds in self.seeds(texts).items() if self.carried(texts[t], k, seeds)]


_known: dict[str, int] = {}


def hashed(words: list[str]) -> np.ndarray:
    if len(_known) > 500_000:
        _known.clear()
    for w in set(words) - _known.keys():
        _known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((_known[w] for w in words), np.uint64, len(words))


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", most_items: int = 20_000, **rules: int) -> DataFrame:
    """(key, item) of every document that carries enough successive words of an item's passage; see Passages for the rules.

    Null, empty and short texts and passages carry nothing; rows with a null key are left out; repeated rows give their pairs once.
    Items are few and do not grow with the documents (more than `most_items` are refused): they are indexed on the driver and
    broadcast. Documents are spread evenly and checked where they are, whole texts, so that no text or candidate is shuffled after.

    Windows of the texts get SimHash fingerprints; an index over blocks of their bits finds all item windows within the
    radius; candidates are verified by the weight of the shingles that they share with the item, and those that have it by the rule, word by word.
    The window is as long as the stretch that must remain unchanged between edits and not as long as the item's passage: one changed word in a window
    of 12 moves a fingerprint by about 10 of 64 bits, and a radius that guarantees it leaves blocks of 3 bits, which select nothing.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item).cast("bigint"), F.col(passage).cast("string")).where(F.col(item).isNotNull() & F.col(passage).isNotNull()).distinct().orderBy(item, passage).limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError("too many items to broadcast")
    passages = spark.sparkContext.broadcast(Passages([tuple(r) for r in rows], **rules))
    kind = documents.schema[key].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = passages.value
        for b in batches:
            at = 0
            values = b.column(1)
            while at < b.num_rows:
                texts: list[list[str]] = []
                words = 0
                while at + len(texts) < b.num_rows and words < 200_000 and len(texts) < 2000:
                    texts.append(words_of(values[at + len(texts)].as_py()))
                    words += len(texts[-1])
                pairs = known.found(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)).take(pa.array([t for t, _ in pairs], pa.int64())), pa.array([known.ids[k] for _, k in pairs], pa.int64())], names=[key, item])
                at += len(texts)

    docs = documents.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    width = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(width, F.xxhash64(key, F.length(text))).mapInArrow(check, f"{key} {kind}, {item} bigint").distinct()
