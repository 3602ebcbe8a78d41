"""Near frames by hash distance (E8): small groups whole, large groups by a banded index.

Frames of one hash are one class, and a class only keeps the smallest frame
among the classes near it, so the result is one row per frame (representative
plus membership) and no pair of rows is formed or written.

A group of at most ``WHOLE`` classes is compared as it is: its classes are
shuffled once, by group, and meet in a merge join that holds one group's classes
at a time. A larger group goes through the index: two 64-bit hashes that differ in
at most ``d`` bits agree in at least ``B - d`` of ``B`` bands, so they meet in an
equi-join on the bits of one choice of ``B - d`` bands. Every class is entered
once per choice; those that meet are verified with ``bit_count``. Choices are worked
in turns of about ``TURN`` entries (or of one choice), so the entries on disk at a
time don't grow with the number of choices.

Hot keys: a cell (group, choice, bits) with over a ``PARTS``-th of a turn's entries,
and a class with over a ``PARTS``-th of all frames, of which there can be only
``PARTS``, are broadcast to be spread by a salt, the cell's other side once per
salt. Nothing is dropped. Only those are broadcast: entries and classes grow with
the table while the file of the classes, from which Spark takes their size, is
small, so their joins are merge joins by hint.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.session import DROP_SHUFFLES, cut_lineage, held, release_cut

PARTS = 1024
#: Classes of a group that is compared whole: so many comparisons in memory cost less than a class's entries in the index.
WHOLE = 256
#: Entries of the index that are written at a time.
TURN = 50_000_000


def band_masks(max_distance: int, spare: int) -> list[int]:
    """The bits of every choice of ``spare + 1`` of ``max_distance + spare + 1``
    bands, as signed 64-bit masks."""
    n = max_distance + spare + 1
    edges = [64 * i // n for i in range(n + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(bands, spare + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hot_keys(counted: DataFrame, key: str, n: str, parts: int) -> DataFrame:
    """Keys with over a ``parts``-th of the sum of ``n`` (fewer than ``parts``
    rows) and _salts, the number of pieces of that size they are cut into."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = counted.where(F.col(n) * parts > total)
    return hot.select(F.col(key).alias("_hot"), F.ceil(F.col(n) * parts / F.lit(max(total, 1))).cast("int").alias("_salts"))


def near_frames(frames: DataFrame, max_distance: int, keys: tuple[str, ...] = ("video_id", "bucket"), order: str = "frame_idx",
                hash_col: str = "hash", name: str = "near_idx", spare: int | None = None) -> DataFrame:
    """``frames`` with ``name`` = the smallest ``order`` of another frame of
    the group ``keys`` that comes before this one and whose hash differs in at
    most ``max_distance`` bits; null for a frame that is the first of its like.
    A frame without a hash is near to none (its distance to any is 64); null
    keys are a group like others; of frames with one ``order`` none comes before
    the other. ``spare`` more bands make the index more selective and larger: by default one
    from a distance of 2 on, so that a join key has 16 bits or more."""
    if not 0 <= max_distance < 63:
        raise ValueError("max_distance must be from 0 to 62")
    spare = (0 if max_distance < 2 else 1) if spare is None else spare
    masks = band_masks(max_distance, min(spare, 63 - max_distance))
    group = F.struct(*[F.col(f"`{k}`") for k in keys])  # never null, its null fields equal each other
    with held(frames.sparkSession, DROP_SHUFFLES):
        classes = cut_lineage(frames.where(F.col(hash_col).isNotNull()).groupBy(group.alias("_g"), F.col(hash_col).alias("_h"))
                              .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")))
        large = cut_lineage(classes.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > WHOLE).select(F.col("_g").alias("_large")))
        if large.isEmpty():
            least = cut_lineage(_whole_groups(classes, max_distance))
        else:
            marked = cut_lineage(classes.join(large.hint("shuffle_merge"), F.col("_g") == F.col("_large"), "left")
                                 .select("_g", "_h", "_first", F.col("_large").isNotNull().alias("_many")))
            found = _by_index(marked.where("_many"), masks, max_distance)
            least = cut_lineage(_whole_groups(marked.where("NOT _many"), max_distance).unionByName(found))
            release_cut(found)
            release_cut(marked)
        hot = F.broadcast(hot_keys(classes.select(F.struct("_g", "_h").alias("_class"), "_n"), "_class", "_n", PARTS))
        hot = cut_lineage(hot.join(least, F.col("_hot") == F.struct("_g", "_h")).select("_hot", F.col("_least").alias("_hot_least")))
        release_cut(large)
        release_cut(classes)
    return _attach(frames, group, F.col(hash_col), least, hot, order, name)


def _near(max_distance: int, h: str, other: str) -> Column:
    return F.bit_count(F.col(h).bitwiseXOR(F.col(other))) <= max_distance


def _whole_groups(classes: DataFrame, max_distance: int) -> DataFrame:
    """The smallest first frame among the classes near each class, itself
    included, of groups that a task can hold. Both sides are one shuffle, whose
    partitions the aggregation keeps."""
    one = classes.select("_g", "_h", "_first")
    met = one.alias("a").join(one.alias("b").hint("shuffle_merge"), F.col("a._g") == F.col("b._g"))
    met = met.where((F.col("b._first") <= F.col("a._first")) & _near(max_distance, "a._h", "b._h"))
    return met.groupBy(F.col("a._g"), F.col("a._h")).agg(F.min("b._first").alias("_least"))


def _by_index(classes: DataFrame, masks: list[int], max_distance: int) -> DataFrame:
    """The same for groups of any size, by the index."""
    turn = max(1, TURN // max(classes.count(), 1))
    # every class is there with its own first frame, so one that meets none stays
    found, table = classes.select("_g", "_h", F.col("_first").alias("_least")), None
    for k in range(0, len(masks), turn):
        met = _meet(classes, masks[k:k + turn], max_distance)
        now = cut_lineage(met.unionByName(found).groupBy("_g", "_h").agg(F.min("_least").alias("_least")))
        if table is not None:
            release_cut(table)
        found = table = now
    return found


def _meet(classes: DataFrame, masks: list[int], max_distance: int) -> DataFrame:
    """Classes with the first frame of an earlier class near them, for each
    choice of bands in ``masks`` that they agree in."""
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("bigint").alias("m")) for i, m in enumerate(masks)]))
    entries = classes.select("_g", "_h", "_first", choice.alias("_x"))
    # a cell's number; cells that share one by chance are told apart where their classes meet
    cell = F.xxhash64("_g", "_x.i", F.col("_h").bitwiseAND(F.col("_x.m")))
    entries = entries.select("_g", "_h", "_first", cell.alias("_cell"))
    counted = entries.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    # a cell of one class joins with itself alone; it need not be joined at all
    hot = F.broadcast(cut_lineage(hot_keys(counted.where("_n > 1"), "_cell", "_n", PARTS)))
    spread = entries.join(hot, F.col("_cell") == F.col("_hot"), "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    ask = spread.select("_g", "_h", "_first", "_cell", F.pmod(F.xxhash64("_h"), F.col("_salts")).cast("int").alias("_salt"))
    tell = spread.select(F.col("_g").alias("_og"), F.col("_h").alias("_oh"), F.col("_first").alias("_other"), "_cell",
                         F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    met = ask.join(tell.hint("shuffle_merge"), ["_cell", "_salt"])
    met = met.where((F.col("_g") == F.col("_og")) & (F.col("_other") < F.col("_first")) & _near(max_distance, "_h", "_oh"))
    return met.select("_g", "_h", F.col("_other").alias("_least"))


def _attach(frames: DataFrame, group: Column, hashed: Column, least: DataFrame, hot: DataFrame, order: str, name: str) -> DataFrame:
    """Each frame gets its class's smallest near frame; classes with very many
    frames meet them by broadcast, and those frames are dealt by their order."""
    met = frames.join(F.broadcast(hot), F.struct(group.alias("_g"), hashed.alias("_h")) == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull() | hashed.isNull(), F.xxhash64(order)).otherwise(F.lit(0))
    least = least.select(F.col("_g").alias("_cg"), F.col("_h").alias("_ch"), "_least", F.lit(0).cast("bigint").alias("_s"))
    same = (group == F.col("_cg")) & (hashed == F.col("_ch")) & (F.col("_salt") == F.col("_s"))
    out = met.withColumn("_salt", salt).join(least.hint("shuffle_merge"), same, "left")
    found: Column = F.coalesce("_hot_least", "_least")
    return out.withColumn(name, F.when(found < F.col(order), found)).drop("_hot", "_hot_least", "_salt", "_cg", "_ch", "_least", "_s")


def index_rows(max_distance: int, spare: int) -> int:
    """Entries a distinct hash makes."""
    return comb(max_distance + spare + 1, spare + 1)
