"""Mixing sources to target shares of tokens by Sainte-Laguë apportionment.

Texts are counted where they are; from then on only (hash, source, id, tokens)
move.  Every source's texts stand in a seeded order, in shards of bounded size,
cut into blocks of equal tokens.  The mix' blocks go to the sources by highest
quotients, a source's blocks to its shards likewise, and a shard gives a run of
consecutive blocks from a seeded start on, going round as often as repeats are
allowed.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.tokens import VOCABULARY, tokenizer
from strideflow.plans.lineage import cut

#: Blocks that the whole mix is made of at least, and that a full shard is made of.
BLOCKS, SHARD_BLOCKS = 20_000, 16
#: Tokens of a source that one shard holds, and so one task orders.
SHARD_TOKENS = 200_000_000


def sainte_lague(votes: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by highest quotients votes / (2 · seats so far + 1), none above its cap; ties go to the first in the order of names."""
    votes = {k: v for k, v in votes.items() if v > 0}
    out = dict.fromkeys(votes, 0)
    total = sum(votes.values())
    for k, v in votes.items():  # what every party has for certain; the quotients decide on the rest
        out[k] = max(0, min(int(v / total * seats) - 1, (caps or {}).get(k, seats)))
    heap = [(-v / (2 * out[k] + 1), str(k), k) for k, v in votes.items() if out[k] < (caps or {}).get(k, seats)]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        if not heap:
            break
        _, name, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < (caps or {}).get(k, seats):
            heapq.heappush(heap, (-votes[k] / (2 * out[k] + 1), name, k))
    return out


def counted(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(h, source, id, tokens)`` of every text: its hash, where it comes from, its size. Empty and NULL texts and NULL sources are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in batches:
            texts = b.column(2).to_pylist()
            h = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([h, b.column(0), b.column(1), pa.array([tok.count(t) for t in texts], pa.int64())], ["h", "source", "id", "tokens"])

    src = documents.where(F.col(source).isNotNull() & (F.length(text) > 0)).select(F.col(source).cast("string").alias("source"), F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "h binary, source string, id bigint, tokens bigint")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, doc_id, tokens, copies)``: the texts of the mix, each with its number of uses.

    ``targets`` (``source``, ``target_share``, ``max_repeats``) is a stated
    small table.  Without ``total_tokens``, or where the sources can't give so
    many, the mix is the largest in which every source reaches its share.  A
    text that stands in several records or sources is used as one: from the
    source that is scarcest against its share, as its smallest id.  Sources
    without target, with no share or no repeats give nothing; a source without
    texts is left out, and the others share what there is.
    """
    spark = documents.sparkSession
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").toLocalIterator()}
    known = targets.where("target_share > 0 and max_repeats > 0").select("source").distinct()
    empty = spark.createDataFrame([], "source string, doc_id bigint, tokens bigint, copies int")
    texts = cut(counted(documents.join(known, "source", "left_semi"), vocabulary=vocabulary).groupBy("h", "source").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens")))
    supply = {r[0]: r[1] for r in texts.groupBy("source").agg(F.sum("tokens")).collect()}
    ranked = sorted(supply, key=lambda s: (supply[s] * wanted[s][1] / wanted[s][0], s))
    if not ranked:
        return empty
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(ranked) for x in (s, i)])
    own = texts.groupBy("h").agg(F.min_by(F.struct("source", "id", "tokens"), rank[F.col("source")]).alias("o")).select("h", "o.*")
    held = {s: int(n) for s, n in own.groupBy("source").agg(F.sum("tokens")).collect()}
    shards = {s: max(1, -(-n // shard_tokens)) for s, n in held.items()}
    per_shard = F.create_map(*[F.lit(x) for s, n in shards.items() for x in (s, n)])
    order = F.xxhash64("h", F.lit(seed))
    placed = cut(own.withColumn("o", order).withColumn("shard", F.pmod(F.xxhash64("h", F.lit(seed + 1)), per_shard[F.col("source")]).cast("int")).drop("h"))
    sizes = {(r[0], r[1]): int(r[2]) for r in placed.groupBy("source", "shard").agg(F.sum("tokens")).collect()}
    shares = {s: wanted[s][0] for s in held if held[s] > 0}
    whole = sum(shares.values())
    shares = {s: v / whole for s, v in shares.items()}
    most = min(held[s] * wanted[s][1] / shares[s] for s in shares)
    total = min(most, total_tokens) if total_tokens else most
    blocks = max(blocks, math.ceil(total / shard_tokens * SHARD_BLOCKS))  # a block is a small part of a shard, however large the mix
    size = total / blocks  # tokens of a block
    seats = sainte_lague(shares, blocks)
    plan: list[tuple] = []
    for s, n in seats.items():
        mine = {k[1]: v for k, v in sizes.items() if k[0] == s}
        room = {k: v * wanted[s][1] for k, v in mine.items()}
        give = sainte_lague(mine, n, {k: int(v / size) for k, v in room.items()})  # whole blocks only
        tokens = {k: give.get(k, 0) * size for k in mine}
        short = min(n * size, sum(room.values())) - sum(tokens.values())  # what only parts of blocks can give
        for k in sorted(mine):
            more = min(short, room[k] - tokens[k])
            tokens[k], short = tokens[k] + more, short - more
        if short > 1e-6 * total:
            raise AssertionError(f"{s}: {short:.0f} planned tokens are in no shard")
        for shard, t in tokens.items():
            passes = int(t // mine[shard])
            start = int.from_bytes(hashlib.blake2b(f"{seed}:{s}:{shard}".encode(), digest_size=6).digest(), "big") / 2**48
            plan.append((s, shard, passes, float(t - passes * mine[shard]), float(int(start * mine[shard] / size) * size), float(mine[shard])))
    quotas = spark.createDataFrame(plan, "source string, shard int, passes int, rest double, start double, size double")
    w = Window.partitionBy("source", "shard").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
    cum = placed.withColumn("at", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    joined = cum.join(F.broadcast(quotas), ["source", "shard"])
    round_ = F.expr("pmod(at + tokens / 2.0 - start, size)")  # a text is where its middle is, counted from the start of the run
    copies = F.col("passes") + F.when(round_ < F.col("rest"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).where("copies > 0").select("source", F.col("id").alias("doc_id"), "tokens", "copies")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, reached_share, tokens, texts, most_copies)`` for every target, also those that got nothing."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    return targets.where("source is not null").select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
