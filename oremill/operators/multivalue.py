"""Fields that hold several values: one row per value, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.shared import written

#: Characters that separate values unless quoted, escaped or inside a known name (fixed values).
SEPARATORS = ",;|/\n\r\t·•、，；｜／"
#: Opening quotes and the marks that close them (fixed values).
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“”", "＂": "＂"}
#: Other characters that a splitting rule looks at.
OTHERS = "[]\\"
SPECIAL = "".join(dict.fromkeys(SEPARATORS + "".join(QUOTES) + "".join(QUOTES.values()) + OTHERS))


def _java(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _part(c: str) -> str:
    """Java pattern of one character of a known name; separators and quotes may be escaped."""
    if c == '"':
        return r'(?:\\"|""|")'
    if c in SPECIAL:
        return r"\\?" + _java(c)
    return r"\s+" if c.isspace() else _java(c)


def _any_of(names: list[list[str]]) -> str:
    """Java pattern of any of the names, each a list of parts, the longest that fits first. Names with a common beginning share it, so that a place of the
    text is compared with the different first parts only, and not with every name."""
    tree: dict = {}
    for parts in names:
        at = tree
        for part in parts:
            at = at.setdefault(part, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        alone = ""
        while len(at) == 1 and "" not in at:
            (part, at) = next(iter(at.items()))
            alone += part
        ways = [part + pattern(then) for part, then in sorted(at.items()) if part]
        return alone + (f"(?:{'|'.join(ways)})" + ("?" if "" in at else "") if ways else "")

    return pattern(tree)


def _token_pattern(names: list[str]) -> str:
    """Java pattern of one token: a known name as a whole, in any letter case (its separators and quotes may be escaped), a run of ordinary words, a run of
    blanks, or a single special character."""
    known = {n.strip().lower() for n in names if n and any(c in SPECIAL for c in n)}
    name = rf"(?<![\p{{L}}\p{{N}}]){_any_of([[_part(c) for c in n] for n in sorted(known) if n])}(?![\p{{L}}\p{{N}}])" if known else r"(?!)"
    word = rf"[^\s{_java(SPECIAL)}]"
    return rf"(?iu){name}|(?:(?!{name}){word})+(?:[ ]+(?!{name}){word}+)*|[ \x{{a0}}]+|[\s\S]"


def skeleton_of(tokens: Column) -> Column:
    """Delimiter skeleton: x for a known name or a run of ordinary words, one blank for blanks, special characters as they are."""
    kind = lambda t: (
        F.when(t.rlike(rf"\A[{_java(SPECIAL)}]\z"), t).when(t.rlike(r"\A[\s\x{a0}]+\z"), F.lit(" ")).otherwise(F.lit("x"))
    )
    return F.array_join(F.transform(tokens, kind), "")


def splitting_rule(skeleton: str) -> list[list[int]]:
    """Which tokens make up each value of a field with this skeleton, in order. Empty slots are left out.

    A quote opens at the start of a value and closes where blanks and a separator, or the end, follow; a doubled or escaped quote inside
    stands for itself. A backslash is dropped and takes its meaning from the character behind it. Brackets around the whole field are
    dropped. A quote that nothing closes is an ordinary character.
    """
    n = len(skeleton)
    first, last = 0, n
    while first < last and skeleton[first] == " ":
        first += 1
    while last > first and skeleton[last - 1] == " ":
        last -= 1
    if last - first >= 2 and skeleton[first] == "[" and skeleton[last - 1] == "]":
        first, last = first + 1, last - 1

    def ends(i: int) -> bool:
        while i < last and skeleton[i] == " ":
            i += 1
        return i >= last or skeleton[i] in SEPARATORS

    def quoted(i: int) -> tuple[list[int], int] | None:
        close, kept, j = QUOTES[skeleton[i]], [], i + 1
        while j < last:
            c = skeleton[j]
            if c == "\\" and j + 1 < last:
                kept.append(j + 1)
                j += 2
            elif c in close and j + 1 < last and skeleton[j + 1] == c and not (ends(j + 1) and not kept):
                kept.append(j)
                j += 2
            elif c in close and ends(j + 1):
                return kept, j + 1
            else:
                kept.append(j)
                j += 1
        return None

    values: list[list[int]] = []
    value: list[int] = []
    i, fresh = first, True
    while i < last:
        c = skeleton[i]
        if c in SEPARATORS:
            values.append(value)
            value, fresh = [], True
            i += 1
            continue
        if fresh and c in QUOTES and (found := quoted(i)):
            value, i = found
            fresh = False
            continue
        if c == "\\" and i + 1 < last:
            value.append(i + 1)
            fresh = False
            i += 2
            continue
        if not (fresh and c == " "):
            value.append(i)
            fresh = False
        i += 1
    values.append(value)
    for v in values:
        while v and skeleton[v[-1]] == " ":
            v.pop()
    return [v for v in values if v]


def _rules(skeletons: DataFrame) -> DataFrame:
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules = pa.array([splitting_rule(s) for s in b.column(0).to_pylist()], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), rules, b.column(1)], names=["skeleton", "rule", "n"])

    return skeletons.mapInArrow(resolve, "skeleton string, rule array<array<int>>, n bigint")


def split_values(rows: DataFrame, field: str, names: list[str], value: str = "value", position: str = "pos", most_broadcast: int = 50_000, longest: int = 2000) -> DataFrame:
    """One row per value of a field that holds several, in place of the field: all other columns, `position` (from 1) and `value`.

    Outer white space, enclosing quotes, brackets around the list and escapes are removed, letter case is kept. A separator inside quotes,
    escaped, or inside one of `names` (in any letter case) belongs to the value. Empty slots are dropped and do not count. Null, empty and blank
    fields have no rows. Repeated rows stay repeated. `names` is a list of known values (bounded: over 100,000 is refused).

    Ordinary characters are masked, which leaves a delimiter skeleton; rules are resolved once per distinct skeleton. Those of skeletons with
    over 1/most_broadcast of the rows, fewer than most_broadcast, are broadcast; rows with a rarer or very long skeleton are joined
    with theirs by a shuffle. A rule says which tokens make up each value, so the extraction only looks tokens up.
    """
    if len(names) > 100_000:
        raise ValueError("too many names")
    if clash := {position, value} & (set(rows.columns) - {field}):
        raise ValueError(f"columns {sorted(clash)} are in the rows already")
    keep = [c for c in rows.columns if c != field]
    text = F.col(f"`{field}`")
    tokens = F.regexp_extract_all(text, F.lit(_token_pattern(names)), F.lit(0))
    # Columns of the rows travel in one struct, so that their names can't clash with those used here.
    cut = rows.where(text.isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), tokens.alias("_tokens"))
    # Read for the skeletons and to put the values together: cutting the fields is most of the work, so it is done once.
    cut = written(cut.withColumn("skeleton", skeleton_of(F.col("_tokens"))), "tokens")
    counts = cut.groupBy("skeleton").agg(F.count("*").alias("n"))
    rules = written(_rules(counts), "rules")
    total = rules.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") * most_broadcast > total) & (F.length("skeleton") <= longest)
    heavy = F.broadcast(rules.where(often).drop("n"))
    light = rules.where(~often).drop("n")
    ruled = cut.join(heavy, "skeleton").unionByName(cut.join(heavy.select("skeleton"), "skeleton", "left_anti").join(light, "skeleton"))
    plain = lambda t: F.when(F.length(t) == 1, t).otherwise(F.regexp_replace(F.regexp_replace(t, r"\\(.)", "$1"), '""', '"'))
    values = F.transform("rule", lambda v: F.trim(F.array_join(F.transform(v, lambda i: plain(F.element_at("_tokens", i + 1))), "")))
    out = ruled.select("_row", F.posexplode(values).alias(position, value))
    return out.select(*(F.col(f"_row.`{c}`") for c in keep), (F.col(position) + 1).alias(position), F.col(value))


def known_names(table: DataFrame, column: str) -> list[str]:
    """Distinct non-null names of a small reference table."""
    return sorted(r[0] for r in table.select(column).where(F.col(column).isNotNull()).distinct().limit(100_001).collect())

