import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.plans.common import one_text_of, tokenize_papers
from quire.plans.runs import run_default, run_grid
from quire.sources.papers import read_papers, read_papers_with_rejects, read_splits, typed_papers, whole_number
from quire.sources.vectors import FILES, read_named_vectors, read_word_vectors


def write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def rec(**kw):
    base = {"title": "T", "abstract": "A", "keywords": ["k"], "venue": "V", "year": 2000,
            "n_citation": 3, "plength": 7}
    base.update(kw)
    return json.dumps(base, ensure_ascii=False)


def test_read_splits_order_and_types(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    write(os.path.join(d, "train.txt"), [rec(title="Ünïcode"), "", rec(plength="7")])
    write(os.path.join(d, "val.txt"), [rec(keywords=["", "  ", "a", "a"])])
    write(os.path.join(d, "test.txt"), [rec(abstract="x " * 500)])
    df = typed_papers(read_splits(spark, d)).orderBy("row_id").collect()
    assert [r.split for r in df] == ["train", "train", "val", "test"]
    assert [r.row_id for r in df] == [0, 1, 2, 3]
    assert df[0].title == "Ünïcode" and df[1].label == 7.0


def test_missing_field_raises(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "x.txt")
    write(p, [json.dumps({"title": "t", "abstract": "a", "keywords": []})])
    with pytest.raises(Exception):
        read_papers(spark, p).collect()


def test_broken_line_fails_fast(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "x.txt")
    write(p, [rec(), "{not json"])
    with pytest.raises(Exception):
        read_papers(spark, p).collect()


def test_missing_field_raises_whatever_is_read(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "x.txt")
    write(p, [rec(), json.dumps({"title": "t", "abstract": "a", "keywords": [], "venue": "v", "year": 1, "n_citation": None, "plength": 3})])
    with pytest.raises(Exception, match="no n_citation"):
        read_papers(spark, p).select("title").collect()
    with pytest.raises(Exception, match="no n_citation"):
        read_papers(spark, p).count()
    assert read_papers(spark, p, required=("title",)).count() == 2


def test_rejects_keep_the_raw_line(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "x.txt")
    write(p, [rec(), "{not json", rec(title=None), rec(plength=None), rec(year="2001"), '["an", "array"]'])
    good, bad = read_papers_with_rejects(spark, p)
    assert good.count() == 2
    got = sorted((r.reason, r.line) for r in bad.collect() if r.line != '["an", "array"]')
    assert got == [("broken line", "{not json"), ("no plength", None), ("no title", None)]
    assert bad.count() == 4


@pytest.mark.parametrize("text, value", [
    ("7", 7), ('"7"', 7), ("8.9", 8), ("-8.9", -8), ('"8.9"', None), ('"1e3"', None), ("1e3", 1000), ('" 12\\n"', 12), ('"+5"', 5),
    ('"1_000"', 1000), ('"1__0"', None), ('"_1"', None), ('""', None), ("true", 1), ('"x"', None), ("[1]", None), ("null", None),
    ("9223372036854775807", 9223372036854775807), ('"9223372036854775808"', None)])
def test_whole_numbers_as_python_reads_them(spark, text, value):
    df = spark.range(1).select(F.parse_json(F.lit(text)).alias("v"))
    assert df.select(whole_number("v")).first()[0] == value
    try:
        assert value is None or int(json.loads(text)) == value
    except (TypeError, ValueError):
        assert value is None


def test_a_quoted_decimal_raises(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "x.txt")
    write(p, [rec(plength=8.9, year="1999"), rec(plength="8.9")])
    rows = typed_papers(read_papers(spark, p))
    assert rows.limit(1).first().label == 8.0
    with pytest.raises(Exception, match="no whole number"):
        rows.collect()


def test_vector_file_by_name(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    write(os.path.join(d, FILES["gs"][0]), ["a 1 2", "a 3 4"])
    write(os.path.join(d, FILES["w2v"][0]), ["1 2", "aaaaaaaa 1.000000 2.000000", "aaaaaaaa 3.000000 4.000000"])
    assert [list(r.vec) for r in read_named_vectors(spark, d, "gs", 2)[0].collect()] == [[3.0, 4.0]]
    assert [list(r.vec) for r in read_named_vectors(spark, d, "w2v", 2)[0].collect()] == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        read_named_vectors(spark, d, "bert")


def test_papers_of_files_go_through_set_1_and_set_3(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    papers = [rec(title=f"Title {i}", abstract=f"word{i % 3} of the text {i % 5}", keywords=[f"k{i % 2}"], plength=3 + i % 4,
                  year=str(2000 + i % 7), n_citation=i) for i in range(40)]
    write(os.path.join(d, "train.txt"), papers[:24])
    write(os.path.join(d, "val.txt"), papers[24:30])
    write(os.path.join(d, "test.txt"), papers[30:])
    tok = tokenize_papers(typed_papers(read_splits(spark, d)).withColumn("rn", F.col("row_id")).withColumnRenamed("row_id", "paper_id"))
    tok = tok.cache()
    for vectorizer in ("tfidf", "hash", "union"):
        r = run_default(spark, None, vectorizer, "lr", docs=one_text_of(tok)).first()
        assert (r.n_train, r.n_val, r.n_test) == (24, 6, 10)
    _, best, scores, _ = run_grid(spark, None, "lr", 24, 10, 4, vect_grid={"norm": ["l1", None]}, tokens=tok)
    assert best.first().n == 10 and scores.count() == 2 * 8 * 4


def test_glove_lines(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "v.txt")
    write(p, ["a 1 2", "b c 1 2", "a 3 4", "w 1 2 3", "", "z 5 6"])
    vecs, rejects = read_word_vectors(spark, p, "glove", dim=2)
    got = {r.word: list(r.vec) for r in vecs.collect()}
    assert got == {"a": [3.0, 4.0], "z": [5.0, 6.0]}
    assert sorted(r.reason for r in rejects.collect()) == ["blank", "not_numeric", "wrong_width"]


def test_w2v_header_and_first_wins(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    p = os.path.join(d, "v.txt")
    write(p, ["3 2", "alpha 1.5 2.5 0000000", "alpha 9.0 9.0 00000000", "beta 1.0 1.0 0000000"])
    vecs, _ = read_word_vectors(spark, p, "w2v", dim=3)
    got = {r.word: list(r.vec) for r in vecs.collect()}
    assert got == {"alpha": [1.5, 2.5, 0.0], "beta": [1.0, 1.0, 0.0]}


def test_write_appends_and_reads_back(spark):
    from quire.sources.papers import write_papers
    d = tempfile.mkdtemp(prefix="quire-test-")
    src = os.path.join(d, "in.txt")
    write(src, [rec(title="a"), rec(title="b")])
    out = os.path.join(d, "out")
    df = read_papers(spark, src)
    write_papers(df, out)
    write_papers(df, out)
    assert sorted(r.title for r in read_papers(spark, out).collect()) == ["a", "a", "b", "b"]


def test_parsed_vectors_hold_the_indexed_words(spark, tmp_path):
    from quire.plans.sequence_queries import QUERIES
    docs = [(i, f"alpha beta w{i} alpha", "en", "s", 20) for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [float(i)] * 64) for i in range(1, 7)], "vec_id long, embedding array<float>") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    last = {r.word: r.vsum / 64 for r in QUERIES["embedding_parse"](spark, str(tmp_path)).collect()}
    first = {r.word: r.vsum / 64 for r in QUERIES["embedding_parse_w2v"](spark, str(tmp_path)).collect()}
    # words by count: alpha, beta, then w0 to w4 (3 to 7); lines by rule: w2 of 4, w3 of 6 are good
    assert last == {"alpha": 1, "beta": 2, "w0": 3, "w1": 4, "w2": 5, "w3": 6}
    assert first == {"alpha": 1, "beta": 2, "w0": 3, "w1": 4, "w2": 4, "w3": 6}
