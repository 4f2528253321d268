"""What a query leaves on the disks besides its result."""
import glob
import os

from pyspark.sql import functions as F

from quire import session
from quire.operators import tfidf as TF
from quire.session import shuffles_removed, stored


def shuffle_files(spark) -> set:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in blocks for f in glob.glob(os.path.join(d, "*", "shuffle_*"))}


def test_a_written_table_leaves_no_shuffle_files(spark):
    counts = spark.range(2000).repartition(7, F.col("id") % 13).groupBy((F.col("id") % 13).alias("k")).count()
    before = shuffle_files(spark)
    counts.write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before  # without it they stay
    before = shuffle_files(spark)
    df = stored(counts, "counts")
    assert not shuffle_files(spark) - before
    assert sorted(r["count"] for r in df.collect()) == sorted(len(range(i, 2000, 13)) for i in range(13))


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(session.REMOVE_SHUFFLES, None)
    for value in ("false", "true"):
        spark.conf.set(session.REMOVE_SHUFFLES, value)
        with shuffles_removed(spark):
            assert spark.conf.get(session.REMOVE_SHUFFLES) == "true"
        assert spark.conf.get(session.REMOVE_SHUFFLES) == value
    spark.conf.unset(session.REMOVE_SHUFFLES) if before is None else spark.conf.set(session.REMOVE_SHUFFLES, before)


def test_a_vocabulary_is_written_once(spark, monkeypatch):
    written = []
    for module in (TF, __import__("quire.operators.rows", fromlist=["rows"])):
        monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or stored(df, name))
    tf = spark.createDataFrame([(i, f"t{i * j % 11}") for i in range(20) for j in range(4)], "id long, term string").distinct()
    vocab = TF.fit_vocabulary(tf, 20)
    terms = sorted({f"t{i * j % 11}" for i in range(20) for j in range(4)})
    assert len(written) == 1 and vocab.size == len(terms)
    assert [(r.term, r.idx) for r in vocab.table.orderBy("idx").collect()] == list(zip(terms, range(len(terms))))
