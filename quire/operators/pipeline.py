"""Text columns to predictions as one saved Spark ML pipeline.

``TextBlocks`` learns a vocabulary per text column and turns a row's columns
into one vector; ``LeastSquares`` is the closed-form regressor for vectors of
bounded width. Both are ordinary Spark ML stages whose work is joins, sums and
built-in expressions: they stand in a ``Pipeline`` with Spark's own estimators,
take parameters, and are saved and loaded with it (the vocabulary as Parquet).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.analyzers import analyzer
from quire.operators import least_squares as LS
from quire.operators.hashing import signed_hash
from quire.operators.hot_join import BUDGET, hot_join
from quire.operators.rows import deal_by, with_row_index
from quire.operators.tfidf import VOCABULARY_ROW_BYTES, VectorizerParams, idf_of, tf_weight
from quire.operators.vectors import assemble
from quire.session import stored


class _TextParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "text columns, a block each", TypeConverters.toListString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns, put after the blocks", TypeConverters.toListString)
    idCol = Param(Params._dummy(), "idCol", "unique id of a row", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "signed buckets a block; 0: a place for every term", TypeConverters.toInt)
    ngramLow = Param(Params._dummy(), "ngramLow", "shortest n-gram", TypeConverters.toInt)
    ngramHigh = Param(Params._dummy(), "ngramHigh", "longest n-gram", TypeConverters.toInt)
    norm = Param(Params._dummy(), "norm", "l1, l2 or none", TypeConverters.toString)
    smoothIdf = Param(Params._dummy(), "smoothIdf", "add one document that holds every term", TypeConverters.toBoolean)
    sublinearTf = Param(Params._dummy(), "sublinearTf", "1 + ln(count)", TypeConverters.toBoolean)
    stopWords = Param(Params._dummy(), "stopWords", "drop English stop words", TypeConverters.toBoolean)
    lowercase = Param(Params._dummy(), "lowercase", "lower-case texts", TypeConverters.toBoolean)
    useIdf = Param(Params._dummy(), "useIdf", "weigh by idf + 1; else counts", TypeConverters.toBoolean)

    def _init(self, kwargs):
        self._setDefault(numericCols=[], idCol="paper_id", outputCol="features", width=0, ngramLow=1, ngramHigh=1, norm="l2",
                         smoothIdf=True, sublinearTf=False, stopWords=False, lowercase=False, useIdf=True)
        self._set(**kwargs)

    def get(self, param):
        return self.getOrDefault(param)

    def vectorizer(self) -> VectorizerParams:
        norm = self.get(self.norm)
        if norm not in ("l1", "l2", "none"):
            raise ValueError(f"unknown norm {norm!r}; choose l1, l2 or none")
        p = VectorizerParams((self.get(self.ngramLow), self.get(self.ngramHigh)), None if norm == "none" else norm,
                             self.get(self.smoothIdf), self.get(self.sublinearTf), None, self.get(self.lowercase),
                             self.get(self.useIdf))
        return p.with_stop_words(self.get(self.stopWords))

    def counted(self, df: DataFrame) -> DataFrame:
        """(id, ``block``, ``term``, ``tf``) of all text columns in one pass."""
        p, key = self.vectorizer(), self.get(self.idCol)
        arrays = F.array(*[analyzer(c, p.ngram_range, p.stop_words, p.lowercase) for c in self.get(self.inputCols)])
        return (deal_by(df.select(key, *self.get(self.inputCols)), key, like=df).select(key, F.posexplode(arrays).alias("block", "terms"))
                .select(key, "block", F.explode("terms").alias("term"))
                .groupBy(key, "block", "term").agg(F.count(F.lit(1)).alias("tf")))


class TextBlocks(Estimator, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the terms of every text column, their places, frequencies and idf."""

    @keyword_only
    def __init__(self, *, inputCols=None, numericCols=None, idCol=None, outputCol=None, width=None, ngramLow=None, ngramHigh=None,
                 norm=None, smoothIdf=None, sublinearTf=None, stopWords=None, lowercase=None, useIdf=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TextBlocksModel":
        p, n = self.vectorizer(), df.count()
        dfreq = self.counted(df).groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"))
        vocab = with_row_index(dfreq, ["block", "term"], name="idx", columnar=True)
        idf = idf_of(F.col("df"), n, p) if p.use_idf else F.lit(1.0)
        vocab = stored(vocab.select("block", "term", "idx", "df", idf.alias("idf")), "vocabulary")
        return self._copyValues(TextBlocksModel(vocab))


class TextBlocksModel(Model, _TextParams, MLWritable, MLReadable):
    """Adds ``outputCol`` to every row; terms never seen in the fit have no weight."""

    def __init__(self, vocabulary: DataFrame | None = None):
        super().__init__()
        self._init({})
        self.vocabulary = vocabulary

    def _transform(self, df: DataFrame) -> DataFrame:
        p, key, width = self.vectorizer(), self.get(self.idCol), self.get(self.width)
        blocks, numbers = self.get(self.inputCols), self.get(self.numericCols)
        counted = self.counted(df)
        few = self.vocabulary.count() * VOCABULARY_ROW_BYTES <= BUDGET
        if not few:  # read twice: frequent terms, rare ones
            counted = stored(counted, "block-counts")
        met = hot_join(counted, self.vocabulary, ["block", "term"], "df", VOCABULARY_ROW_BYTES, key)
        v = F.col("value")
        cells = met.select(key, "block", "term", "idx", (tf_weight(p) * F.col("idf")).alias("value"))
        if not width:
            if not few:  # the window sorts what a task holds
                cells = deal_by(cells, key, like=counted)
            w = Window.partitionBy(key, "block")
            size = {"l2": F.sqrt(F.sum(v * v).over(w)), "l1": F.sum(F.abs(v)).over(w), None: F.lit(1.0)}[p.norm]
            cells = cells.withColumn("value", F.when(size > 0, v / size).otherwise(v))
            size = self.vocabulary.count()
            parts = cells.select(key, "idx", "value")
            for i, c in enumerate(numbers):
                parts = parts.unionByName(df.select(key, F.lit(size + i).cast("long").alias("idx"), F.col(c).cast("double").alias("value"))
                                          .where("value <> 0"))
            return assemble(df, parts, size + len(numbers), key, self.get(self.outputCol))
        # A block's norm divides its buckets' sums: both are added up where the
        # cells lie, and only sums, at most blocks x width a row, are moved.
        h = signed_hash("term")
        at = F.col("block") * width + F.abs(h) % width
        part = {"l2": v * v, "l1": F.abs(v), None: F.lit(0.0)}[p.norm]
        sums = cells.select(key, "block", at.alias("at"), F.when(h >= 0, v).otherwise(-v).alias("v"), part.alias("q")) \
            .groupBy(key, "block", "at").agg(F.sum("v").alias("v"), F.sum("q").alias("q"))
        row = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("_m"),
                                    F.array(*[F.sum(F.when(F.col("block") == i, F.col("q"))) for i in range(len(blocks))]).alias("_q"))
        sizes = F.transform("_q", lambda q: F.when(q > 0, F.sqrt(q) if p.norm == "l2" else q).otherwise(1.0))
        row = row.select(key, "_m", sizes.alias("_q"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(len(blocks) * width - 1)), lambda i: F.coalesce(
            F.try_element_at("_m", i.cast("long")) / F.get("_q", F.floor(i / width).cast("int")), F.lit(0.0)))
        whole = F.concat(dense, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers])) if numbers else dense
        return df.join(row, key, "left").withColumn(self.get(self.outputCol), array_to_vector(whole)).drop("_m", "_q")

    def write(self) -> MLWriter:
        return _TextBlocksWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TextBlocksReader(cls)


class _TextBlocksWriter(MLWriter):
    def __init__(self, model: TextBlocksModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.vocabulary.write.parquet(f"{path}/vocabulary")


class _TextBlocksReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TextBlocksModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/vocabulary"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _SquaresParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    fitIntercept = Param(Params._dummy(), "fitIntercept", "fit a constant", TypeConverters.toBoolean)
    weights = Param(Params._dummy(), "weights", "intercept and weights of the fitted model", TypeConverters.toListFloat)

    def _init(self, kwargs):
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", fitIntercept=True)
        self._set(**kwargs)

    def get(self, param):
        return self.getOrDefault(param)


class LeastSquares(Estimator, _SquaresParams, DefaultParamsReadable, DefaultParamsWritable):
    """M1 from one pass of summed products, for vectors of a few hundred places."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, fitIntercept=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LeastSquaresModel":
        gram, size = LS.vector_matrix(df, self.get(self.featuresCol), self.get(self.labelCol))
        weights = LS.solve(gram, self.get(self.fitIntercept)) if size else []
        model = self._copyValues(LeastSquaresModel())
        return model._set(weights=[float(x) for x in weights])


class LeastSquaresModel(Model, _SquaresParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._init({})

    def _transform(self, df: DataFrame) -> DataFrame:
        w = self.get(self.weights)
        x = vector_to_array(self.get(self.featuresCol))
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in w[1:]]), lambda a, b: a * b), F.lit(w[0]), lambda a, b: a + b)
        return df.withColumn(self.get(self.predictionCol), dot)


