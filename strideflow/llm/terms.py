"""Frequency of every distinct value or n-gram over a suffix array with common-prefix intervals.

Each record's own suffix array gives, for every suffix, the length of the prefix that it shares with its predecessor: an
n-gram no longer than that was counted in this record before.  Equal suffixes
are added up where they are, then the distinct ones are range-partitioned and
sorted: the corpus' suffix array.  One pass over each partition closes the
common-prefix intervals and gives each n-gram its occurrences and, without the
within-record duplicates, its records.  Intervals that cross a partition
boundary are added up at the end.  A value that fills a third of all rows is a
handful of distinct suffixes by the time anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_suffixes(terms: list[str], max_n: int | None = None) -> list[tuple[list[str], int]]:
    """The record's suffix array, each suffix with the prefix length shared with the one before it; on request cut to ``max_n`` terms."""
    s = sorted(terms[i : i + (max_n or len(terms))] for i in range(len(terms)))
    out, last = [], []
    for x in s:
        k = 0
        while k < len(x) and k < len(last) and x[k] == last[k]:
            k += 1
        out.append((x, k))
        last = x
    return out


def _suffixes(batches: Iterator[pa.RecordBatch], max_n: int | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grp, suf, dup, wgt = [], [], [], []
        for g, terms, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for x, k in record_suffixes([t for t in terms or [] if t is not None], max_n):
                grp.append(g), suf.append(x), dup.append(k), wgt.append(w)
            if len(grp) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(suf, pa.list_(pa.string())), pa.array(dup, pa.int32()), pa.array(wgt, pa.int64())], ["grp", "suffix", "dup", "w"])
                grp, suf, dup, wgt = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(suf, pa.list_(pa.string())), pa.array(dup, pa.int32()), pa.array(wgt, pa.int64())], ["grp", "suffix", "dup", "w"])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["grp", "term", "tf", "df"]
    last, grp, tf, df = [], None, [0], [0]
    out: list[tuple] = []

    def close(down_to: int) -> None:
        for k in range(len(last), down_to, -1):
            out.append((grp, last[:k], tf[k], df[k]))
            tf[k] = df[k] = 0

    def made() -> pa.RecordBatch:
        cols = list(zip(*out)) or [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()))], names)

    for b in batches:
        for g, x, dup, w in zip(*(c.to_pylist() for c in b.columns)):
            k = 0
            if g == grp:
                while k < len(x) and k < len(last) and x[k] == last[k]:
                    k += 1
            close(k)
            last, grp = x, g
            while len(tf) <= len(x):
                tf.append(0), df.append(0)
            for n in range(1, len(x) + 1):
                tf[n] += w
                df[n] += w if n > dup else 0
        if len(out) > 20_000:
            yield made()
    close(0)
    yield made()


def term_counts(records: DataFrame, terms: str, group: str | None = None, weight: str | None = None, max_n: int | None = None) -> DataFrame:
    """``(grp, term ARRAY<STRING>, n, tf, df)``: occurrences and records of every n-gram of any length, per group.

    On request only of 1 to ``max_n`` terms: then the suffixes are cut.  A
    record is a row; with ``weight`` it stands for so many equal rows.  NULL
    terms are skipped, NULL and empty arrays hold none; no rows give no terms.
    A record of L terms has suffixes of L² / 2 terms in all, which is meant for
    fields; texts of many thousand terms want ``max_n``.
    """
    src = records.select(
        (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), F.col(terms).alias("terms"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w"),
    )
    suffixes = src.mapInArrow(lambda it: _suffixes(it, max_n), "grp string, suffix array<string>, dup int, w bigint")
    distinct = suffixes.groupBy("grp", "suffix", "dup").agg(F.sum("w").alias("w"))
    array = distinct.repartitionByRange("grp", "suffix").sortWithinPartitions("grp", "suffix")
    parts = array.mapInArrow(_intervals, "grp string, term array<string>, tf bigint, df bigint")
    return parts.groupBy("grp", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).select("grp", "term", F.size("term").alias("n"), "tf", "df")


def marked(counts: DataFrame, sizes: DataFrame, rare_rows: int = 3, common_share: float = 0.25) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in at most ``rare_rows`` records, ``common`` in over ``common_share`` of the group's ``total`` in ``sizes``, else NULL.

    A term that is both is ``rare``.  ``sizes`` has one row per group and is
    joined as Spark chooses.
    """
    return counts.join(sizes, counts.grp.eqNullSafe(sizes.grp)).drop(sizes.grp).withColumn("mark", F.when(F.col("df") <= rare_rows, "rare").when(F.col("df") > common_share * F.col("total"), "common"))
