"""Paper records: JSON-lines splits (S1, S2, S6) and the ``papers`` view
over the driver tables.

A record has title, abstract, keywords, venue, year, n_citation, plength.
Line order is data (positional splits, ordered training), so every scan
attaches a stable ``row_id`` (D1) from file path, block start and the
position inside the block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import WS
from quire.operators.rows import with_row_index

#: Numbers are read as variants, so that ``8.9`` and ``"8.9"`` stay apart.
PAPER_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("venue", T.StringType()),
    T.StructField("year", T.VariantType()),
    T.StructField("n_citation", T.VariantType()),
    T.StructField("plength", T.VariantType()),
])

REQUIRED = ("title", "abstract", "keywords", "venue", "year", "n_citation", "plength")
NUMBERS = ("year", "n_citation", "plength")
SPLITS = ("train", "val", "test")
#: The raw text of a line that is no JSON record.
BROKEN = "_broken"


def _scan(spark: SparkSession, path: str, mode: str) -> DataFrame:
    schema = T.StructType([*PAPER_SCHEMA, T.StructField(BROKEN, T.StringType())])
    df = (spark.read.schema(schema).option("mode", mode).option("encoding", "UTF-8")
          .option("columnNameOfCorruptRecord", BROKEN).json(path))
    return df.select(
        *PAPER_SCHEMA.fieldNames(), BROKEN,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"))


def _missing(name: str) -> F.Column:
    """Is a required field absent or null? (A JSON null is a variant, not null.)"""
    null = F.col(name).isNull()
    return null | F.is_variant_null(name) if name in NUMBERS else null


def reject_reason(required=REQUIRED) -> F.Column:
    """Why a scanned record is rejected; null for a good one."""
    out = F.when(F.col(BROKEN).isNotNull(), F.lit("broken line"))
    for name in required:
        out = out.when(_missing(name), F.lit(f"no {name}"))
    return out


def read_papers(spark: SparkSession, path: str, split: str | None = None,
                mode: str = "FAILFAST", required=REQUIRED) -> DataFrame:
    """One record per JSON line, declared schema, explicit null check.

    A broken line raises (``mode`` PERMISSIVE: it is left out), and a record
    without a required field raises, whatever columns are read afterwards: the
    check is a filter on the records, not a part of a column. Use
    :func:`read_papers_with_rejects` to go on without the bad lines. Adds
    ``_file``, ``_block``, ``_seq`` ordering columns.
    """
    df = _scan(spark, path, mode)
    reason = reject_reason(required)
    if mode != "FAILFAST":
        df = df.where(F.col(BROKEN).isNull())
    df = df.where(F.when(reason.isNull(), True).otherwise(
        F.raise_error(F.concat(F.lit("paper record rejected: "), reason)).cast("boolean"))).drop(BROKEN)
    if split is not None:
        df = df.withColumn("split", F.lit(split))
    return df


def read_papers_with_rejects(spark: SparkSession, path: str, required=REQUIRED) -> tuple[DataFrame, DataFrame]:
    """The good records, and (``reason``, ``line``, ordering columns) of the bad
    ones; ``line`` is the raw text of a broken line."""
    df = _scan(spark, path, "PERMISSIVE").withColumn("reason", reject_reason(required))
    good = df.where("reason is null").drop(BROKEN, "reason")
    return good, df.where("reason is not null").select("reason", F.col(BROKEN).alias("line"), "_file", "_block", "_seq")


def read_splits(spark: SparkSession, data_dir: str, splits=SPLITS,
                mode: str = "FAILFAST", required=REQUIRED) -> DataFrame:
    """S2 + D2 + D1: stack train/val/test in order and number the rows."""
    frames = []
    for order, name in enumerate(splits):
        part = read_papers(spark, f"{data_dir.rstrip('/')}/{name}.txt", split=name,
                           mode=mode, required=required)
        frames.append(part.withColumn("_split_no", F.lit(order)))
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f)
    numbered = with_row_index(stacked, ["_split_no", "_file", "_block", "_seq"])
    return numbered.drop("_split_no", "_file", "_block", "_seq")


def write_papers(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.select(*[c for c in PAPER_SCHEMA.fieldNames() if c in df.columns]) \
        .write.mode("append").json(path)


def variant_kind(column) -> F.Column:
    """The JSON type of a variant column: BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN ..."""
    return F.schema_of_variant(column)


def whole_number(column: str) -> F.Column:
    """Python's ``int()`` of a JSON value, null where that would raise.

    A bare number is cut to its whole part (8.9 becomes 8), true and false are 1
    and 0; a text has to be a whole number, with a sign, white space around it
    and single underscores between digits allowed ("8.9" and "1e3" raise). Values
    beyond 64 bits are null too.
    """
    kind = variant_kind(column)
    text = F.try_variant_get(column, "$", "string")
    inner = F.regexp_replace(F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", ""), "_", "")
    from_text = F.when(text.rlike(f"^[{WS}]*[+-]?[0-9]+(_[0-9]+)*[{WS}]*$"), inner.try_cast("bigint"))
    return (F.when(kind == "STRING", from_text)
            .when(kind == "BOOLEAN", F.try_variant_get(column, "$", "boolean").cast("bigint"))
            .when(kind == "BIGINT", F.try_variant_get(column, "$", "bigint"))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
                  F.try_variant_get(column, "$", "decimal(38,10)").try_cast("bigint")))


def typed_papers(df: DataFrame) -> DataFrame:
    """T12 + T13: integer target and numeric fields by :func:`whole_number`; a
    value that is no whole number raises."""
    def to_int(c):
        v = whole_number(c)
        wrong = F.concat(F.lit(f"{c} is no whole number: "), F.to_json(F.col(c)))
        return F.when(v.isNotNull(), v).otherwise(F.raise_error(wrong).cast("bigint")).cast("int")
    out = df.withColumn("label", to_int("plength").cast("double"))
    for name in ("year", "n_citation"):
        if name in df.columns:
            out = out.withColumn(name, to_int(name))
    return out.drop("plength")


# ---------------------------------------------------------------------------
# The ``papers`` view over the driver tables
# ---------------------------------------------------------------------------

def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small scan over all cores where fewer of its tasks than
    cores hold rows (a file of one row group is one task's, however it is cut).
    What the tasks hold is counted, from the footers alone; a scan with many
    tasks is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores:
        return df
    busy = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).count()
    return df.repartition(cores, key) if busy < cores else df


def paper_numbers(spark: SparkSession, sf_dir: str, train_fraction: float = 0.8) -> tuple[DataFrame, int]:
    """(``paper_id``, ``rn``) by id from 0, and the number of train papers."""
    ids = load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"))
    n_train = int(ids.count() * train_fraction)  # answered from parquet footers
    return with_row_index(ids, ["paper_id"], name="rn"), n_train


def papers_from_tables(spark: SparkSession, sf_dir: str, train_fraction: float = 0.8,
                       with_rn: bool = False, with_split: bool = True,
                       with_labels: bool = True) -> DataFrame:
    """Papers derived from ``documents`` (+ ``labels``), with split.

    paper_id = doc_id; title = first line of the text; abstract = text;
    keywords = first line split on one blank; venue = source;
    year = 1990 + doc_id % 30; n_citation = 50 * quality + doc_id % 37;
    plength = 1 + n_chars div 500; the first floor(0.8 n) rows by doc_id are
    train, the rest test; rn = row number by doc_id from 0.

    The view is a projection of the scan. Only ids are numbered (8 bytes a
    row), to read off the id where the test rows begin; the split then compares
    ids with that literal. ``with_rn`` joins the numbers themselves, for the
    few operators that need them. Texts are never moved to be numbered.
    """
    docs = spread(load_table(spark, sf_dir, "documents"), "doc_id")
    first_line = F.substring_index(F.col("text"), "\n", 1)
    cites = F.col("doc_id") % 37
    if with_labels:
        labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
        # labels has at most one row per doc and is small next to documents;
        # AQE broadcasts it when its size allows, otherwise a shuffle join.
        docs = docs.join(labels, "doc_id", "left")
        cites = F.coalesce(F.col("quality"), F.lit(0)) * 50 + cites
    columns = [
        F.col("doc_id").alias("paper_id"),
        first_line.alias("title"),
        F.col("text").alias("abstract"),
        F.split(first_line, " ", -1).alias("keywords"),
        F.col("source").alias("venue"),
        (F.lit(1990) + F.col("doc_id") % 30).cast("int").alias("year"),
        (F.lit(1) + F.expr("n_chars div 500")).cast("int").alias("plength"),
        (F.lit(1) + F.expr("n_chars div 500")).cast("int").cast("double").alias("label")]
    if with_labels:
        columns.insert(6, cites.cast("int").alias("n_citation"))
    papers = docs.select(*columns)
    if not (with_split or with_rn):
        return papers
    numbered, n_train = paper_numbers(spark, sf_dir, train_fraction)
    if with_split:
        border = numbered.where(F.col("rn") == n_train).first()
        test = F.lit(False) if border is None else F.col("paper_id") >= F.lit(border["paper_id"])
        papers = papers.withColumn("split", F.when(test, "test").otherwise("train"))
    return papers.join(numbered, "paper_id") if with_rn else papers
