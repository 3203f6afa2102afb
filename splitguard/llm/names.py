"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of fixed size. Distinct blocks are sorted and numbered,
so a number names one block content and no other. Then neighbouring names are named in pairs, level
by level, until one name is left per document. Two documents have the same identity (level, name)
exactly if their texts are equal; no hash takes part in that decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitguard.storage import lookup, materialize

BLOCK_CHARS = 4096


def folded(text: Column) -> Column:
    """Runs of ASCII white space become one blank; NULL becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def row_mark(text: Column) -> Column:
    """Tells rows apart that share an id: a hash of the raw text."""
    return F.xxhash64(text)


def block_identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    block_hash=F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, text_sha256, n_blocks, level, name.

    A NULL or empty text is one empty block. Rows may repeat an id, and the id may be NULL; ``mark``
    keeps such rows apart, and a row that repeats id and text comes out as often as it went in.
    Other columns of ``docs`` are not read. An empty table gives no rows.

    ``block_hash`` only routes: blocks meet their names by it, and contents whose hashes collide
    (found when the blocks are sorted) meet them by content instead.
    """
    blocks = _blocks(docs, id_col, text_col, block_chars, block_hash)
    names = materialize(
        blocks.groupBy("hash", "block").agg(F.count("*").alias("n_rows"))
        .sortWithinPartitions("hash", "block").select("hash", F.monotonically_increasing_id().alias("name"), "n_rows"),
        "block_names",
    )
    by_hash = materialize(
        names.groupBy("hash").agg(F.min("name").alias("name"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_contents")),
        "names_by_hash",
    )
    found = lookup(blocks.drop("block"), by_hash, ["hash"], "n_rows", "mark")
    rows = found.filter(F.col("n_contents") == 1).drop("n_contents", "hash")
    collided = by_hash.filter(F.col("n_contents") > 1)
    if not collided.isEmpty():
        rows = rows.unionByName(_named_by_content(blocks, collided))
    rows = materialize(rows, "names_0")

    done = [rows.filter(F.col("n_names") == 1).withColumn("level", F.lit(0))]
    level = 0
    most = rows.agg(F.max("n_names")).first()[0] or 1
    while most > 1:
        level += 1
        most = (most + 1) // 2
        rows = _named_pairs(rows.filter(F.col("n_names") > 1), level)
        done.append(rows.filter(F.col("n_names") == 1).withColumn("level", F.lit(level)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        "doc_id", "mark", "text_sha256", "n_blocks", "level", "name", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_one")
    ).drop("_one")


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int, block_hash) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc_id"), row_mark(F.col(text_col)).alias("mark"), folded(F.col(text_col)).alias("text"))
    cut = text.select(
        "doc_id", "mark", F.sha2("text", 256).alias("text_sha256"),
        # Cut in one pass over the text; a substring per block would start at its head each time.
        F.when(F.col("text") == "", F.array(F.lit("")))
        .otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))).alias("blocks"),
    )
    n = F.size("blocks")
    rows = cut.select("doc_id", "mark", "text_sha256", n.alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    return rows.select(
        "doc_id", "mark", F.when(F.col("pos") == 0, F.col("text_sha256")).alias("text_sha256"), "n_blocks",
        F.col("n_blocks").alias("n_names"), "pos", F.lit(1).alias("copies"), block_hash(F.col("block")).alias("hash"), "block",
    )


def _named_by_content(blocks: DataFrame, collided: DataFrame) -> DataFrame:
    """Names for the blocks of colliding hashes, met by content. They are negative, so no other block has them."""
    rows = blocks.join(collided.select("hash"), "hash", "left_semi")
    names = materialize(
        rows.groupBy("block").agg(F.count("*").alias("n_rows")).sortWithinPartitions("block")
        .select("block", (-F.lit(1) - F.monotonically_increasing_id()).alias("name"), "n_rows"),
        "content_names",
    )
    return lookup(rows.drop("hash"), names, ["block"], "n_rows", "mark").drop("block")


def _named_pairs(rows: DataFrame, level: int) -> DataFrame:
    """One level up: neighbours 2i and 2i+1 become one name; a last single one is paired with nothing."""
    even = F.col("pos") % 2 == 0
    pairs = materialize(
        rows.groupBy("doc_id", "mark", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max("text_sha256").alias("text_sha256"),
            F.max("n_blocks").alias("n_blocks"),
            F.ceil(F.max("n_names") / 2).cast("int").alias("n_names"),
            F.sum(F.when(even, F.col("copies")).otherwise(0)).cast("int").alias("copies"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.max(F.when(~even, F.col("name"))).alias("right"),
        ),
        f"pairs_{level}",
    )
    names = materialize(
        pairs.groupBy("left", "right").agg(F.count("*").alias("n_rows")).sortWithinPartitions("left", "right")
        .select("left", "right", F.monotonically_increasing_id().alias("name"), "n_rows"),
        f"pair_names_{level}",
    )
    return lookup(pairs, names, ["left", "right"], "n_rows", "mark").drop("left", "right")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, mark, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. NULL ids are passed over in that choice, and
    where all ids of a group are NULL, all its rows stay. Rows that repeat the kept id and text stay too.
    """
    ids = materialize(block_identities(docs, id_col, text_col, **options), "identities")
    groups = materialize(
        ids.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("n_rows", F.col("group_size")),
        "copy_groups",
    )
    return lookup(ids, groups, ["level", "name"], "n_rows", "mark").select(
        "doc_id", "mark", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
