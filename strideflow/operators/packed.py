"""Several values packed in one field.

Dictionary-guided segmentation: an automaton over the known whole values finds
every place where one of them stands between separators; dynamic programming
then picks the cheapest cover of the field by known values, quoted values and,
where nothing is known, stretches up to the next delimiter.  A delimiter inside
a known value is covered together with that value and so does not split it.

The dictionary holds every known value.  Up to ``BROADCAST_WORDS`` (counted) it
is broadcast and the operator is a map without a shuffle of the rows; a larger
one is dealt out in shards of that size, each with an automaton of its own,
whose finds are put together for each distinct field before the cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.plans.lineage import cut

#: Known values that one automaton holds (some 100 bytes each).
BROADCAST_WORDS = 1_000_000
#: What may separate values. Blanks alone never do.
DELIMITERS = ";,|/+&·\t\n\r；，、"
QUOTES = "\"'"
_QUOTED = r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'"

#: Costs of the cover: a known or quoted value, an unknown stretch, a stray quote inside one.
KNOWN, UNKNOWN = 1, 3


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "|+&[]^-\\" else c for c in chars) + "]"


def is_packed(col: Column, delimiters: str = DELIMITERS) -> Column:
    """Whether a field needs the segmentation at all: it has a delimiter or a quote."""
    return F.coalesce(col.rlike(_class(delimiters + QUOTES)), F.lit(False))


def known_values(df: DataFrame, columns: list[str], delimiters: str = DELIMITERS) -> DataFrame:
    """``(value, n)``: the known whole values, in lower case, with their occurrences.

    A value is known when it stands alone in a field without any delimiter, or
    when it was written in quotes.  One aggregation with map-side combine.
    """
    raw = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("raw")).where("raw is not null")
    quoted = F.transform(
        F.regexp_extract_all("raw", F.lit("(" + _QUOTED + ")"), F.lit(1)),
        lambda q: F.replace(F.substring(q, F.lit(2), F.length(q) - 2), F.concat(F.substring(q, F.lit(1), F.lit(1)), F.substring(q, F.lit(1), F.lit(1))), F.substring(q, F.lit(1), F.lit(1))),
    )
    values = F.when(is_packed(F.col("raw"), delimiters), quoted).otherwise(F.array("raw"))
    return (
        raw.groupBy("raw").count()
        .select(F.explode(values).alias("value"), "count")
        .select(F.lower(F.trim("value")).alias("value"), "count")
        .where("value <> ''")
        .groupBy("value").agg(F.sum("count").alias("n"))
    )


def learn_dictionary(df: DataFrame, columns: list[str], delimiters: str = DELIMITERS, min_count: int = 1, max_entries: int | None = None) -> list[str]:
    """The known values as a list, most frequent first.

    On request only those without a delimiter that were seen ``min_count``
    times, and at most ``max_entries`` of them; by default all.
    """
    counted = known_values(df, columns, delimiters)
    holds = F.col("value").rlike(_class(delimiters))
    plain = counted.where(~holds & (F.col("n") >= min_count))
    if max_entries is not None:
        plain = plain.orderBy(F.desc("n"), "value").limit(max_entries)
    return [r.value for r in sorted(counted.where(holds).unionByName(plain).collect(), key=lambda r: (-r.n, r.value))]


def build_automaton(dictionary: list[str]) -> ahocorasick.Automaton | None:
    """The multi-pattern automaton; None for an empty dictionary."""
    words = [w for w in dict.fromkeys(dictionary) if w]
    if not words:
        return None
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def occurrences(raw: str, automaton: ahocorasick.Automaton | None, delimiters: str = DELIMITERS) -> list[tuple[int, int]]:
    """(start, end) of every known value in ``raw`` that stands between separators."""
    if automaton is None:
        return []
    low, at, seps = raw.lower(), None, set(delimiters)
    if len(low) != len(raw):  # a letter whose lower case has several: each of these is at that letter's place
        at = [i for i, c in enumerate(raw) for _ in c.lower()] + [len(raw)]
        low = "".join(c.lower() for c in raw)
    out = []
    for last, length in automaton.iter(low):
        i, j = last - length + 1, last + 1
        if at is not None:
            if (i and at[i - 1] == at[i]) or (j < len(low) and at[j - 1] == at[j]):
                continue
            i, j = at[i], at[j]
        before, after = raw[:i].rstrip(" ")[-1:], raw[j:].lstrip(" ")[:1]
        if (not before or before in seps) and (not after or after in seps):
            out.append((i, j))
    return out


def segment(raw: str | None, automaton: ahocorasick.Automaton | None, delimiters: str = DELIMITERS, found: list[tuple[int, int]] | None = None) -> list[str]:
    """The values in ``raw`` in order, without outer blanks and with quoting undone.

    The known values' places come from the automaton, or are given as
    ``found``.  NULL and blank fields hold no values; empty pieces are left out;
    an opening quote without its end is an ordinary character.
    """
    if raw is None or not raw.strip():
        return []
    n, seps = len(raw), set(delimiters)
    known: dict[int, list[int]] = {}
    for i, j in occurrences(raw, automaton, delimiters) if found is None else found:
        known.setdefault(i, []).append(j)
    best: list[tuple[int, int] | None] = [None] * (n + 1)  # cost of the rest, end of the first step
    step: list[str | None] = [None] * (n + 1)
    best[n] = (0, n)
    after = [n] * (n + 1)  # the next delimiter
    for i in range(n - 1, -1, -1):
        after[i] = i if raw[i] in seps else after[i + 1]
    closing: dict[int, int] = {}
    i = 0
    while i < n:  # quoted spans: they open after a separator and end before one
        q = raw[i]
        if q in QUOTES and (not raw[:i].rstrip(" ") or raw[:i].rstrip(" ")[-1] in seps):
            j = i + 1
            while j < n:
                if raw[j] == q:
                    if j + 1 < n and raw[j + 1] == q:
                        j += 2
                        continue
                    break
                j += 1
            rest = raw[j + 1 :].lstrip(" ")[:1]
            if j < n and (not rest or rest in seps):
                closing[i] = j + 1
                i = j + 1
                continue
        i += 1
    for i in range(n - 1, -1, -1):
        c = raw[i]
        if c in seps or c == " ":
            best[i], step[i] = (best[i + 1][0], i + 1), None
            continue
        if i in closing:
            j = closing[i]
            q = raw[i]
            value = raw[i + 1 : j - 1].replace(q * 2, q).strip()
            best[i], step[i] = (best[j][0] + (KNOWN if value else 0), j), value or None
            continue
        j = after[i]
        choice = (best[j][0] + UNKNOWN, -j)
        for k in known.get(i, ()):
            choice = min(choice, (best[k][0] + KNOWN, -k))
        best[i], step[i] = (choice[0], -choice[1]), raw[i : -choice[1]].strip()
    out, i = [], 0
    while i < n:
        if step[i]:
            out.append(step[i])
        i = best[i][1]
    return out


def unpack(df: DataFrame, key: str, columns: list[str], dictionary: list[str] | DataFrame | None = None, multi_only: bool = True) -> DataFrame:
    """One row per value: ``(key, tag_field, pos, item)``; with ``multi_only`` only of fields with several.

    The packed rows alone are sent to Python, as map work; positions count from 1.
    """
    if dictionary is None:
        dictionary = known_values(df, columns)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("tag_field"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("f")
    rows = df.select(F.col(key).alias("key"), fields).select("key", "f.tag_field", "f.raw")
    if multi_only:
        rows = rows.where(is_packed(F.col("raw")))
    done = cut_fields(rows, dictionary)
    if multi_only:
        done = done.where(F.size("items") > 1)
    return done.select("key", "tag_field", F.posexplode("items").alias("p", "item")).select(F.col("key").alias(key), "tag_field", (F.col("p") + 1).cast("int").alias("pos"), "item")


def _items(batches: Iterator[pa.RecordBatch], automaton: ahocorasick.Automaton | None) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[str]] = {}
    for b in batches:
        raws = b.column(2).to_pylist()
        for v in raws:
            if v not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[v] = segment(v, automaton)
        items = pa.array([seen[v] if v in seen else segment(v, automaton) for v in raws], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), items], ["key", "tag_field", "items"])


def cut_fields(rows: DataFrame, dictionary: list[str] | DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``(key, tag_field, raw)`` with the array ``items`` of the values instead of ``raw``; NULL and blank fields give an empty one.

    ``dictionary`` is a list, or a table with the column ``value``.
    """
    context, key = rows.sparkSession.sparkContext, rows.schema["key"].dataType.simpleString()
    if isinstance(dictionary, DataFrame):
        held = cut(dictionary.select("value"))
        shards = -(-held.count() // broadcast_words)
        if shards > 1:
            return _cut_by_shards(rows, held, shards)
        dictionary = [r.value for r in held.collect()]
    words = context.broadcast(dictionary)
    return rows.select("key", "tag_field", "raw").mapInArrow(lambda it: _items(it, build_automaton(words.value)), f"key {key}, tag_field string, items array<string>")


def _cut_by_shards(rows: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """Each distinct field is looked at with every shard's automaton, then covered once."""
    fields, parts = cut(rows.where("raw is not null").select("raw").distinct()), None
    pairs = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
    for k in range(shards):
        words = rows.sparkSession.sparkContext.broadcast([r.value for r in held.where(F.pmod(F.xxhash64("value"), F.lit(shards)) == k).collect()])

        def find(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(words.value)
            for b in batches:
                got = [[{"i": i, "j": j} for i, j in occurrences(v, automaton)] for v in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pairs)], ["raw", "found"])

        part = fields.mapInArrow(find, "raw string, found array<struct<i:int,j:int>>")
        parts = part if parts is None else parts.unionByName(part)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [segment(v, None, found=[(f["i"], f["j"]) for f in found]) for v, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.string()))], ["covered", "items"])

    done = parts.groupBy("raw").agg(F.flatten(F.collect_list("found")).alias("found")).mapInArrow(cover, "covered string, items array<string>")
    return rows.join(done, F.col("raw") == F.col("covered"), "left").select("key", "tag_field", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
