"""Exact copies by two passes of Bloom filters; only rows whose text may repeat are shuffled.

DataFrame expressions only. In the first pass every row marks one cell, told by its text's hash, of a filter that counts to
two; marks are added up within each task before they are shuffled. Cells that are marked again are those of possibly repeated
texts; they make up the filter of the second pass, in blocks of 32,768 bits with ``bits`` bits for each cell. A row whose cell
is not in that filter has a text of its own and passes straight through. The others, copies and a few strangers that share a
cell or bits, are grouped by the SHA-256 of their text, again with sums within the task.

The second filter holds repeated cells only. It is broadcast if it has at most ``broadcast_blocks`` blocks (4 KB each); a larger
one is joined by block. Groups of more than ``hot`` rows, the larger of 1,000 and a 10,000th of all rows, are 10,000 at most; their
verdicts are broadcast, so a text that a third of all rows share is spread over all tasks, and other groups are joined by digest.

Edge cases: a null text counts as empty; of equal texts the row with the largest key stays, a null key being the smallest; rows
that repeat both key and text share one verdict and each count in the group's size (``keep_one`` returns one of them); an empty
table gives no rows. Extra columns are ignored by ``verdicts`` and passed on by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sheltered, written

#: Bits of a block: what ``bitmap_construct_agg`` holds.
BLOCK_BITS = 32_768


@dataclass(frozen=True)
class Filters:
    cells_per_row: int = 32
    bits_per_cell: int = 16
    bits: int = 4
    broadcast_blocks: int = 16_384


@dataclass(frozen=True)
class Plan:
    """What the sizes of a table ask for: cells of the first filter, blocks of the second, rows of a hot group."""

    cells: int
    blocks: int
    hot: int


def cell_of(text_hash: Column, cells: int) -> Column:
    return F.pmod(text_hash, F.lit(cells))


def block_of(cell: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(cell, F.lit("block")), F.lit(blocks))


def bit_of(cell: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(cell, F.lit(k)), F.lit(BLOCK_BITS))


def repeated_cells(hashes: DataFrame, cells: int) -> DataFrame:
    """First pass: cells of the hashes (column h) that are marked at least twice."""
    return hashes.groupBy(cell_of(F.col("h"), cells).alias("cell")).agg(F.count("*").alias("n")).where("n > 1").select("cell")


def block_filter(cells: DataFrame, blocks: int, bits: int) -> DataFrame:
    """The second filter: block, and its bits as a bitmap."""
    set_bits = cells.select(block_of(F.col("cell"), blocks).alias("block"), F.explode(F.array(*[bit_of(F.col("cell"), k) for k in range(bits)])).alias("bit"))
    return set_bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def plan(hashes: DataFrame, filters: Filters) -> tuple[Plan, DataFrame]:
    """Sizes, and the repeated cells, written."""
    rows = hashes.count()
    cells = max(1024, filters.cells_per_row * rows)
    again = written(repeated_cells(hashes, cells), "repeated-cells")
    blocks = again.count() * filters.bits_per_cell // BLOCK_BITS + 1
    return Plan(cells, blocks, max(1_000, rows // 10_000)), again


def told_apart(rows: DataFrame, text_hash: Column, again: DataFrame, sizes: Plan, filters: Filters, name: str) -> DataFrame:
    """rows and, under the name, whether the text may repeat."""
    block, bitmap, cell, own = fresh(rows, "block", "bitmap", "cell", "own_block")
    found = block_filter(again, sizes.blocks, filters.bits).select(F.col("block").alias(block), F.col("bitmap").alias(bitmap))
    if sizes.blocks <= filters.broadcast_blocks:
        found = F.broadcast(found)
    marked = rows.withColumn(cell, cell_of(text_hash, sizes.cells)).withColumn(own, block_of(F.col(cell), sizes.blocks))
    joined = marked.join(found, F.col(own) == F.col(block), "left")
    inside = F.lit(True)
    for k in range(filters.bits):
        inside = inside & has_bit(F.col(bitmap), bit_of(F.col(cell), k))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(bitmap).isNotNull() & inside).alias(name))


def groups_of(rows: DataFrame) -> DataFrame:
    """sha, keep_id and group_size of texts that really repeat."""
    return rows.groupBy("sha").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def with_groups(rows: DataFrame, groups: DataFrame, hot: int) -> DataFrame:
    """rows (sha and others) with keep_id and group_size of their group, null for a text of its own."""
    named = lambda df, p: df.select(F.col("sha").alias(f"{p}_sha"), F.col("keep_id").alias(f"{p}_id"), F.col("group_size").alias(f"{p}_size"))
    large, small = named(groups.where(F.col("group_size") > hot), "large"), named(groups.where(F.col("group_size") <= hot), "small")
    out = rows.join(F.broadcast(large), F.col("sha") == F.col("large_sha"), "left")
    # Rows of large groups are dealt out by their keys; eight bytes never equal a digest.
    spread = F.when(F.col("large_sha").isNull(), F.col("sha")).otherwise(F.unhex(F.hex(F.xxhash64("key"))))
    out = out.withColumn("spread", spread).join(small, F.col("spread") == F.col("small_sha"), "left")
    return out.select(*rows.columns, F.coalesce("large_id", "small_id").alias("keep_id"), F.coalesce("large_size", "small_size").alias("group_size"))


def digests(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, sha (32 bytes) and h of every row, written: the passes read these and no texts."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return written(docs.select(F.col(f"`{key}`").alias("key"), F.unhex(F.sha2(whole, 256)).alias("sha"), F.xxhash64(whole).alias("h")), "digests")


def judged(rows: DataFrame, filters: Filters) -> tuple[DataFrame, DataFrame, Plan, DataFrame]:
    """Rows that pass straight through, the others with their groups, the sizes and the repeated cells."""
    sizes, again = plan(rows.select("h"), filters)
    parted = told_apart(rows, F.col("h"), again, sizes, filters, "maybe")
    maybe = parted.where("maybe").select("key", "sha")
    return parted.where("NOT maybe").select("key", "sha"), with_groups(maybe, groups_of(maybe), sizes.hot), sizes, again


def verdicts(docs: DataFrame, filters: Filters = Filters(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256; one row per row of docs."""
    through, grouped, _, _ = judged(digests(docs, text, key), filters)
    own = through.select("key", "sha", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    alone = F.col("group_size").isNull()
    others = grouped.select("key", "sha", F.when(alone, F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return own.unionAll(others).select(
        F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, filters: Filters = Filters(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the copies, with all columns; exactly one row of each text stays. Texts that do not repeat aren't shuffled."""

    def work(docs: DataFrame) -> DataFrame:
        h, maybe, sha, stays_key, stays_sha = fresh(docs, "h", "maybe", "sha", "stays_key", "stays_sha")
        whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        rows = digests(docs, text, key)
        _, grouped, sizes, again = judged(rows, filters)
        # The row that stays, for repeated texts; rows that repeat key and text are one.
        stays = grouped.where(F.col("group_size").isNull() | F.col("key").eqNullSafe(F.col("keep_id"))).select("key", "sha").distinct()
        parted = told_apart(docs.withColumn(h, F.xxhash64(whole)), F.col(h), again, sizes, filters, maybe)
        columns = [F.col(f"`{c}`") for c in docs.columns]
        again_rows = parted.where(F.col(maybe)).withColumn(sha, F.unhex(F.sha2(whole, 256)))
        stays = stays.select(F.col("key").alias(stays_key), F.col("sha").alias(stays_sha))
        chosen = again_rows.join(stays, (F.col(sha) == F.col(stays_sha)) & F.col(f"`{key}`").eqNullSafe(F.col(stays_key)), "left_semi")
        return parted.where(~F.col(maybe)).select(*columns).unionAll(chosen.dropDuplicates([key, sha]).select(*columns))

    return sheltered(work, docs)
