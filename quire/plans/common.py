"""Shared building blocks of the registered queries: the papers view and
its tokenised forms, as lazily planned DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import concat_text, core_tokenize, keyword_string
from quire.session import stored
from quire.sources.papers import papers_from_tables


def papers(spark: SparkSession, sf_dir: str, rn: bool = False, split: bool = False,
           labels: bool = False) -> DataFrame:
    """The view with only what the caller asks for: plain columns are a
    projection of one scan."""
    return papers_from_tables(spark, sf_dir, with_rn=rn, with_split=split, with_labels=labels)


def tokenize_papers(p: DataFrame) -> DataFrame:
    """Title and abstract of papers through the core tokenizer, keywords
    summarised; ids, split, label and numbers are kept."""
    keep = [c for c in ("paper_id", "rn", "split", "label", "venue", "year", "n_citation") if c in p.columns]
    return p.select(*keep, keyword_string("keywords").alias("kw"),
                    core_tokenize("title").alias("title_t"),
                    core_tokenize("abstract").alias("abstract_t"))


def one_text_of(t: DataFrame) -> DataFrame:
    """Keywords + title + abstract of tokenised papers as one text column."""
    keep = [c for c in ("paper_id", "rn", "split", "label") if c in t.columns]
    return t.select(*keep, concat_text("kw", "title_t", "abstract_t").alias("text"))


def tokenized(spark: SparkSession, sf_dir: str, rn: bool = False, split: bool = True, labels: bool = True) -> DataFrame:
    """The papers view, tokenised; without ``labels`` it has no ``n_citation``."""
    out = tokenize_papers(papers(spark, sf_dir, rn=rn, split=split, labels=labels))
    # The regex chain is the costliest step; where several passes follow (those
    # that split) its output is written once, as Parquet, so that they read the
    # tokens they need and not raw text.
    return stored(out, "tokens") if split or rn else out


def one_text(spark: SparkSession, sf_dir: str, rn: bool = False, split: bool = True) -> DataFrame:
    """The papers view as one text column. Nothing of ``labels`` is in it, so texts are
    not joined with them, a join that shuffles the texts once labels outgrow a broadcast."""
    return one_text_of(tokenized(spark, sf_dir, rn=rn, split=split, labels=False))


def round4(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)
