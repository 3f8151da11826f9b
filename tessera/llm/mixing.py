"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies.  The documents of a
source stand in a fixed order (large size classes first, hashed within a class, so that
what a source gives stays near its target); the expected copies are prefix-summed along
it, one random offset is added, and a document is emitted once for every integer
boundary that its part of the sum crosses.

The order is never sorted in one place: rows fall into (source, size class, hash block)
cells, the cells' counts give every cell its place, and rows are numbered within cells.

Defined results: null texts have size 0; a null source is a source of its own, last in
order; rows without a doc_id are sampled like others, ordered by their text; repeated rows are
separate documents; sources whose texts are all empty get target 0 and give nothing.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 5


def offset(seed: int = SEED) -> float:
    """The one random offset, in 1024ths: sums with it stay exact."""
    return random.Random(seed).randrange(1024) / 1024


def _class(size: Column) -> Column:
    """Size classes, 32 an octave, in ascending order of size."""
    bits = F.length(F.bin(size))
    return F.when(size < 64, size).otherwise(bits * 64 + F.expr("shiftright(__size, length(bin(__size)) - 6)"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``__s, source_size, target`` of ``sizes(__s, source_size)``, one row a source.

    Targets are least(cap * size, level * weight) for the one level at which they add up
    to the share; that level is the largest of the levels that the sources, ordered by
    size over weight, give when all before them are capped.
    """
    weight = "element_at(array({}), cast((row_number() over (order by __s) - 1) % {} + 1 as int))"
    w = sizes.withColumn("w", F.expr(weight.format(", ".join(f"{x}D" for x in weights), len(weights))))
    before = "over (order by source_size / w, __s rows between unbounded preceding and 1 preceding)"
    all_rows = "over ()"
    level = (
        f"({share}D * sum(source_size) {all_rows} - {float(cap)}D * coalesce(sum(source_size) {before}, 0)) / "
        f"(sum(w) {all_rows} - coalesce(sum(w) {before}, 0D))"
    )
    w = w.withColumn("level", F.expr(level)).withColumn("level", F.expr("max(level) over ()"))
    return w.select("__s", "source_size", F.expr(f"least({float(cap)}D * source_size, level * w)").alias("target"))


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with the size of each text and what its place in the order depends on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows without a doc_id are told apart by their text, so that they don't meet in one block
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), text))
    digits = _digits(df.count())
    return (
        df.drop("size", "source_size", "target", "copies")
        .withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")))
        .withColumn("__cls", _class(F.col("__size")).cast("long"))
        .withColumn("__key", F.md5(key.cast("binary")))
        .withColumn("__crc", F.crc32(text.cast("binary")))
        .withColumn("__blk", F.substring("__key", 1, digits))
    )


def _digits(rows: int, least: int = 2) -> int:
    """Hex digits of the hash that name a block: blocks of some thousand rows, at most 16 ** 5 of them; the order is the same for all."""
    return int(min(max(math.ceil(math.log2(max(rows, 1) / 4096) / 4), least), 5))


def _taken(rows: DataFrame, weights, share: float, cap: float, seed: int) -> DataFrame:
    """Rows of ``_keyed`` with ``size, source_size, target, copies``."""
    cell = ["__s", "__cls", "__blk"]
    cells = cut(rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("__size").alias("words")))
    classes = cells.groupBy("__s", "__cls").agg(F.sum("n").alias("n"))
    above = "coalesce(sum(n) over (partition by {} order by {} rows between unbounded preceding and 1 preceding), 0)"
    classes = classes.select("__s", "__cls", F.expr(above.format("__s", "__cls desc")).alias("c0"))
    blocks = cells.select(*cell, F.expr(above.format("__s, __cls", "__blk")).alias("b0"))
    goal = cut(targets(cells.groupBy("__s").agg(F.sum("words").alias("source_size")), weights, share, cap))
    place = blocks.join(classes, ["__s", "__cls"]).join(goal, "__s").select(*cell, (F.col("c0") + F.col("b0")).alias("__before"), "source_size", "target")
    numbered = rows.withColumn("__n", F.expr("row_number() over (partition by __s, __cls, __blk order by __key, doc_id, __crc)"))
    return (
        numbered.join(cut(place), cell)
        .withColumn("__r", F.expr("if(source_size = 0, 0D, target / source_size)"))
        .withColumn("__n", F.col("__before") + F.col("__n"))
        .withColumn("copies", F.expr(f"cast(floor(__n * __r + {offset(seed)}D) - floor((__n - 1) * __r + {offset(seed)}D) as long)"))
        .withColumnRenamed("__size", "size")
        .drop("__s", "__cls", "__key", "__crc", "__blk", "__n", "__r", "__before")
    )


def sample(df: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``df`` with ``size, source_size, target, copies``: how often the mix takes each row.  Columns of those names are replaced."""
    return _taken(_keyed(df), weights, share, cap, seed)


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken."""
    own = df.select(F.struct(*df.columns).alias("__row"), "doc_id", "text", "source")
    taken = sample(own, **options).where("copies > 0")
    return taken.select("__row", F.explode(F.expr("sequence(1L, copies)"))).select("__row.*")


def digest(df: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``; the texts are read once, what follows works on narrow rows."""
    rows = _keyed(df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))).drop("text", "source")
    taken = _taken(cut(rows), weights, share, cap, seed)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, 't' || coalesce(text, ''))) as k from documents),
src as (select source, sum(size)::bigint as source_size from base group by source),
w as (select *, [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
         row_number() over (order by source nulls last) as rk from src),
lv as (select *, ({SHARE}::double * sum(source_size) over ()
          - 2.0::double * coalesce(sum(source_size) over (order by source_size / w, rk rows between unbounded preceding and 1 preceding), 0))
          / (sum(w) over () - coalesce(sum(w) over (order by source_size / w, rk rows between unbounded preceding and 1 preceding), 0)) as level from w),
goal as (select source, source_size, least(2.0::double * source_size, (max(level) over ()) * w) as target from lv),
pos as (select b.doc_id, b.size, g.source_size, g.target, case when g.source_size = 0 then 0.0::double else g.target / g.source_size end as r,
          row_number() over (partition by b.source order by case when b.size < 64 then b.size
            else length(bin(b.size)) * 64 + (b.size >> (length(bin(b.size)) - 6)) end desc, k, doc_id) as n
        from base b join goal g on b.source is not distinct from g.source)
select doc_id, size, source_size, target,
  ((floor(n * r + {offset()}::double) - floor((n - 1) * r + {offset()}::double))::bigint * size)::bigint as taken from pos
"""
