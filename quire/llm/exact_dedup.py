"""Operator 3: exact duplicates by content-defined chunk recipes.

Each normalised text is cut where its own content says so; a cut depends only
on the characters around it. Every distinct chunk moves once (after map-side
aggregation), which verifies that a chunk hash stands for one content; hashes
that stand for several contents get a rank beside the hash. A document is then
its recipe, the ordered list of verified chunk identifiers: a few numbers for
every kilobyte. Only recipes are grouped and joined, so long texts are never
moved to be compared. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SPACE, col, id_text, salted_join, small
from quire.session import stored
from quire.sources.papers import load_table

#: A chunk ends after a blank that follows one of these two-letter endings, at
#: 512 characters or more, and at 8192 at the latest.
CUT = r"(?s).{512,8191}?[aeinrstu][dnrst,.] |.{1,8192}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def chunk_hash(chunk: Column, hash_bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if hash_bits >= 64 else F.pmod(h, F.lit(1 << hash_bits))


def recipes(docs: DataFrame) -> DataFrame:
    """``_id``, ``sha`` and ``chunks``: the document's chunks in order.

    ``docs`` has ``_id`` and ``_text``.
    """
    return (docs.select("_id", normalised(F.col("_text")).alias("_norm"))
            .select("_id", F.sha2("_norm", 256).alias("sha"),
                    F.regexp_extract_all("_norm", F.lit(CUT), F.lit(0)).alias("chunks")))


def shared_hashes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(``h``, ``chunk``, ``rank``) of hashes that stand for several contents."""
    contents = (recipes(docs).select(F.explode("chunks").alias("chunk"))
                .groupBy(chunk_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
                .agg(F.count(F.lit(1)).alias("n")))
    several = (contents.groupBy("h").agg(F.sort_array(F.collect_list(
        F.when(F.col("n") > 0, F.sha2("chunk", 256)))).alias("all"), F.count(F.lit(1)).alias("k"))
        .where("k > 1"))
    return several.select("h", F.posexplode("all").alias("rank", "content"))


def verified(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``_id``, ``sha``, ``recipe`` (list of verified chunk identifiers)."""
    doc = recipes(docs).select("_id", "sha", "chunks", F.transform(
        "chunks", lambda c: chunk_hash(c, hash_bits)).alias("hs"))
    clashes = stored(shared_hashes(docs, hash_bits), "chunk-clashes")
    plain = doc.select("_id", "sha", F.col("hs").alias("recipe"), F.array().cast("array<int>").alias("ranks"))
    if clashes.isEmpty():  # every hash was verified to be one content
        return plain
    # The rank of each chunk whose hash is shared; -1 for all others.
    rows = (recipes(docs).withColumn("_row", F.monotonically_increasing_id())
            .select("_row", "_id", "sha", F.posexplode("chunks").alias("pos", "chunk"))
            .select("_row", "_id", "sha", "pos", chunk_hash(F.col("chunk"), hash_bits).alias("h"),
                    F.sha2("chunk", 256).alias("content")))
    ranked = salted_join(rows, clashes.select("h", "content", "rank"), ["h", "content"])
    resolved = (ranked.groupBy("_row", "_id", "sha").agg(F.sort_array(F.collect_list(
        F.struct("pos", "h", F.coalesce("rank", F.lit(-1)).alias("rank")))).alias("r"))
        .select("_id", "sha", F.col("r.h").alias("recipe"), F.col("r.rank").alias("ranks")))
    return resolved.unionByName(plain.where(F.size("recipe") == 0))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_bits: int = 64) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``, ``n_chunks``.

    Texts are equal when identical after each run of ASCII white space becomes
    one blank; of equal texts the row with the smallest id stays. A null text
    counts as empty; empty texts equal each other but not a blank one. Of rows
    that repeat the same id and text one is kept. A null id sorts last. An
    empty table gives an empty result. Other columns of ``df`` are ignored, so
    their names cannot clash. ``hash_bits`` below 64 is for tests of hashes
    that stand for several contents.
    """
    docs = id_text(df, id_col, text_col)
    light = (verified(docs, hash_bits).groupBy("_id", "sha", "recipe", "ranks")
             .agg(F.count(F.lit(1)).alias("copies")))
    groups = (light.groupBy("recipe", "ranks")
              .agg(F.min("_id").alias("keep_id"), F.sum("copies").alias("group_size"))
              .where("group_size > 1"))
    # Most texts are single: only groups of two or more are joined back.
    out = salted_join(light, groups, ["recipe", "ranks"])
    out = (out.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
           .withColumn("keep_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("_id")))
           .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                      F.col("sha").alias("text_sha256"),
                      F.size("recipe").alias("n_chunks"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(load_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with their columns.

    Rows are dropped by id and text hash. Only where an id repeats are rows
    with the same id and text reduced to one.
    """
    out = exact_dedup(df, id_col, text_col)
    gone = out.where(~F.col("kept") & ~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(
        F.col(id_col).alias("_gone"), F.unhex("text_sha256").alias("_gone_sha")).distinct()
    rows = df.withColumn("_row_sha", F.unhex(F.sha2(normalised(F.coalesce(col(text_col), F.lit(""))), 256)))
    same = col(id_col).eqNullSafe(F.col("_gone")) & (F.col("_row_sha") == F.col("_gone_sha"))
    rows = rows.join(small(gone, "copies"), same, "left_anti")
    again = stored(df.groupBy(col(id_col).alias("_again")).count().where("count > 1")
                   .select("_again"), "repeated-ids")
    if not again.isEmpty():
        repeats = col(id_col).eqNullSafe(F.col("_again"))
        rows = rows.join(again, repeats, "left_anti").unionByName(
            rows.join(again, repeats, "left_semi").dropDuplicates([id_col, "_row_sha"]))
    return rows.select(*[col(c) for c in df.columns])


SQL = {"op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t"""}
