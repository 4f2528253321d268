from quire.operators import fold_search as FS
from quire.operators import rows as RW


def test_search_terms_are_counted_without_a_shuffle_of_terms(spark):
    tok = spark.createDataFrame([(i, i % 3, "k w", f"t w{i % 2}", f"a b c{i} a b", "v") for i in range(9)],
                                "paper_id long, fold int, " + ", ".join(f"{c} string" for c in FS.TEXTS))
    kinds = [((1, 1), False), ((1, 2), True)]
    counted = FS._terms(tok, kinds).groupBy("paper_id", "fold", "block", "term").count()
    rows = counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
    got = {(r.block, r.term): r["count"] for r in rows if r.paper_id == 4}
    assert got[(3, "c4")] == 1 and (3, "a") not in got and all(n == 1 for (b, t), n in got.items() if t == "c4")


def test_partitions_grow_with_the_scan(spark):
    df = spark.range(100, numPartitions=9)
    assert RW.deal_by(df, "id").rdd.getNumPartitions() == 36
    assert RW.deal_by(spark.range(4, numPartitions=1), "id").rdd.getNumPartitions() == 4


def test_a_search_cell_is_moved_as_few_numbers(spark, monkeypatch):
    """Two folds' frequencies lie in one number, bucket and sign with block and count; odd numbers of folds too."""
    rows = [(i, i % 3, 1.0, "k", "A plan", f"word w{i} mesh mesh", "v", 2000, 3) for i in range(9)]
    tok = spark.createDataFrame(rows, "paper_id long, fold int, label double, kw string, title_t string, abstract_t string, venue string, "
                                      "year int, n_citation int")
    moved, deal = [], FS.deal_by
    monkeypatch.setattr(FS, "deal_by", lambda df, *a, **b: moved.append(df) or deal(df, *a, **b))
    FS.fold_text(tok, [], 3)
    cells = moved[-1]
    assert cells.columns == ["paper_id", "cell", "tf", "d0", "d1"]
    counts = [(r.d0 & 0xFFFFFFFF, r.d0 >> 32, r.d1) for r in cells.where("abs(tf) = 2").collect()]
    assert set(counts) == {(3, 3, 3)} and len(counts) == 9
