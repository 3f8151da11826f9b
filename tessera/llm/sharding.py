"""Sharding by a Feistel permutation over global row numbers, in SQL functions only.

Rows get global numbers 0 .. N-1 (hash blocks of doc_id first, then in order within the
block; no global sort).  A keyed Feistel network permutes an a x b grid with a * b just
above N, and cycle walking re-applies it until the value is below N: a permutation of
0 .. N-1.  Place p lies in shard p mod k at slot p div k, so both can be computed for any
row number without looking at other rows.  Law ``rows``: shard counts are at most one apart.

Defined results: null or empty texts have size 1 and checksum 0; repeated rows are
separate rows; rows without a doc_id are numbered like others, by their text; an empty table gives none.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import cut

SHARDS = 8
SEED = 11
ROUNDS = 6
#: Of the round function; products stay below 2 ** 62.
PRIME, MUL1, MUL2 = 2147483647, 1103515245, 1812433253 % 2147483647
#: The walk visits each value outside at most once; there are fewer than sqrt(N) of them, so 64 steps always
#: do up to N = 4096, and beyond that the chance to need more is under (1/64) ** 64 a row.
WALK = 64


def keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    draw = random.Random(seed)
    return [draw.randrange(1 << 30) for _ in range(rounds)]


def _round(v: str, k: str) -> str:
    y = f"(({v} + {k}) * {MUL1}L % {PRIME}L)"
    z = f"(({y} ^ shiftright({y}, 15)) * {MUL2}L % {PRIME}L)"
    return f"({z} ^ shiftright({z}, 13))"


def _feistel(x: str, seed: int) -> str:
    """SQL text of the network over ``__a`` x ``__b`` applied to ``x``."""
    steps = ", ".join(f"struct({k}L as k, {'true' if i % 2 == 0 else 'false'} as left)" for i, k in enumerate(keys(seed)))
    turn = (
        f"if(s.left, named_struct('l', (e.l + {_round('e.r', 's.k')}) % __a, 'r', e.r), "
        f"named_struct('l', e.l, 'r', (e.r + {_round('e.l', 's.k')}) % __b))"
    )
    return f"aggregate(array({steps}), named_struct('l', {x} % __a, 'r', {x} div __a), (e, s) -> {turn}, e -> e.r * __a + e.l)"


def place(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; needs the columns doc_id and text.  Columns of those two names are replaced."""
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows without a doc_id are told apart by their text, so that they don't meet in one block
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), text))
    # blocks of some thousand rows, but at most 16 ** 5; the order is the same for all
    digits = int(min(max(math.ceil(math.log2(max(df.count(), 1) / 4096) / 4), 3), 5))
    rows = df.drop("shard", "slot").withColumn("__key", F.md5(key.cast("binary"))).withColumn("__blk", F.substring("__key", 1, digits))
    blocks = rows.groupBy("__blk").agg(F.count("*").alias("n"))
    blocks = blocks.select("__blk", F.expr("coalesce(sum(n) over (order by __blk rows between unbounded preceding and 1 preceding), 0)").alias("__before"), F.expr("sum(n) over ()").alias("__total"))
    blocks = blocks.withColumn("__a", F.expr("cast(ceil(sqrt(__total)) as long)")).withColumn("__b", F.expr("(__total + __a - 1) div __a"))
    order = "__key, doc_id, crc32(cast(coalesce(text, '') as binary))"
    numbered = rows.withColumn("__n", F.expr(f"row_number() over (partition by __blk order by {order}) - 1"))
    walk = f"aggregate(sequence(1, {WALK}), {_feistel('__n', seed)}, (p, i) -> if(p < __total, p, {_feistel('p', seed)}))"
    return (
        numbered.join(F.broadcast(cut(blocks)), "__blk")
        .withColumn("__n", F.col("__before") + F.col("__n"))
        .withColumn("__p", F.expr(walk))
        .withColumn("__p", F.expr("if(__p < __total, __p, raise_error('the walk did not end'))").cast("long"))
        .withColumn("shard", F.expr(f"cast(__p % {shards} as int)"))
        .withColumn("slot", F.expr(f"__p div {shards}"))
        .drop("__key", "__blk", "__before", "__total", "__a", "__b", "__n", "__p")
    )


def digest(df: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return place(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
