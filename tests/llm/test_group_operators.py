"""Operators 2, 4, 6, 9, 10, components and the pipeline against brute force."""
import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import passage_dedup as passages
from quire.llm.common import id_text
from quire.llm.components import components
from quire.llm import embedding_dedup as embeddings
from quire.llm.embedding_dedup import embedding_dedup
from quire.llm.mixing import fit_lengths, knapsack, mix, mixed_rows
from quire.llm.ngram_join import keep_one_of_group, ngram_join
from quire.llm.passage_dedup import bands_for, passage_dedup
from quire.llm.warc import (ArchiveWriter, WarcError, build_record, parse_record, read_archive,
                            warc_round_trip, write_archives)
from quire.session import scratch_path

from conftest import ROWS  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(nodes, edges):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {x: c for x, c in want.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_texts():
    rng = np.random.default_rng(3)
    rows, base = [], [[f"b{k}w{rng.integers(0, 500)}" for _ in range(80)] for k in range(6)]
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, len(w))] = f"z{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(w[:rng.integers(60, 80)]), "s"))
    common = " ".join(f"c{i}" for i in range(20))  # a passage that unlike texts share
    rows += [(300 + i, common + " " + " ".join(f"u{i}x{k}" for k in range(30)), "s") for i in range(30)]
    return rows


def test_ngram_join_against_all_pairs(frame, empty):
    rows = ROWS + near_texts()
    out = ngram_join(frame(rows)).collect()
    assert len(out) == len(rows)
    sets = [(i, shingles(t)) for i, t, _ in rows]
    edges = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = union_find({i for i, _ in sets}, edges)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out}
    assert got == {(i, len(x), want[i]) for i, x in sets}
    kept = sorted(r["doc_id"] for r in keep_one_of_group(frame(rows)).collect())
    assert sorted(set(kept)) == sorted(i for i, c in want.items() if i == c)
    assert ngram_join(empty).collect() == [] and keep_one_of_group(empty).collect() == []


def test_knapsack_finds_the_best_sum():
    rng = np.random.default_rng(4)
    for _ in range(80):
        lengths = np.sort(rng.choice(np.arange(0, 60), rng.integers(1, 6), replace=False))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 9))
        sums = {sum(n * int(x) for n, x in zip(way, lengths)) for way in product(*[range(c + 1) for c in counts])}
        order = rng.permutation(len(lengths))
        take = knapsack(lengths, counts, budget, order)
        assert (take >= 0).all() and (take <= counts).all()
        assert (lengths * take).sum() == max(x for x in sums if x <= budget)


def test_fit_lengths_takes_all_lengths_alike():
    rng = np.random.default_rng(7)
    for share in (0.1, 0.36, 0.8):
        for lengths, counts in ((np.arange(1, 20001), np.ones(20000, int)),
                                (np.unique(rng.lognormal(5.5, 1, 4000).astype(int)), None)):
            counts = rng.integers(1, 40, len(lengths)) // np.maximum(1, lengths // 50) + 1 if counts is None else counts
            budget = int(share * (lengths * counts).sum())
            take = fit_lengths(lengths, counts, budget)
            assert (take >= 0).all() and (take <= counts).all()
            assert budget - 1 <= (lengths * take).sum() <= budget
            words = np.cumsum(lengths * counts) / (lengths * counts).sum()
            for some in (words <= 0.5, words > 0.5, words > 0.9):
                near = 2 * lengths[some].max() / (lengths * counts)[some].sum() + 0.05
                assert abs((lengths * take)[some].sum() / (lengths * counts)[some].sum() - share) < near
            again = fit_lengths(lengths, counts, budget, seed=43)
            assert (again != take).any() and (fit_lengths(lengths, counts, budget) == take).all()
    assert fit_lengths(np.array([7]), np.array([10**6]), 7 * 999_999).tolist() == [999_999]
    assert fit_lengths(np.array([0, 5]), np.array([3, 2]), 4)[1] == 0


def test_mix(frame, empty):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), [None, "a", "b", "c", "a", "a"][i % 6]) for i in range(600)]
    rows += [(1000 + i, "same length here", "a") for i in range(300)]
    out = mix(frame(rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, total = {}, sum(size.values())
    capped = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and w[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in out:
        s = r["source"]
        target = 3 * size[s] if s in capped else w[s] * level
        assert r["source_size"] == size[s] and math.isclose(r["target"], target, rel_tol=1e-9)
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        size_of = r["target"]
        assert size_of >= 0
    for r in out:
        assert abs(taken[r["source"]] - r["target"]) <= 1
    again = mix(frame(rows)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    table = frame(rows)
    words = sum(len(WORD.findall(r["text"])) for r in mixed_rows(table).collect())
    assert words == sum(taken.values())
    assert mix(empty).collect() == []


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 8))
    vectors = [(i, [float(x) for x in base[i % 12] + rng.standard_normal(8) * rng.choice([0.02, 0.2, 1.0])], i % 2)
               for i in range(160)]
    vectors += [(200 + i, vectors[0][1], 0) for i in range(5)]
    odd = [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] + [0.0] * 6, 0), (303, [float("nan")] * 8, 0),
           (304, vectors[0][1], None), (305, [], 0), (306, [float("inf")] + [1.0] * 7, 0), (307, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(i, v, la, 1, "x") for i, v, la in vectors + odd],
                               "vec_id long, embedding array<double>, label int, cls long, v string")
    for block in (2048, 7):
        got = {r["vec_id"]: r for r in embedding_dedup(df, block=block).collect()}
        assert len(got) == len(vectors) + len(odd)

        def cos(a, b):
            return np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))
        edges = [(i, j) for (i, a, la), (j, b, lb) in combinations(vectors, 2) if la == lb and cos(a, b) >= 0.93]
        want, links = union_find(got, edges), Counter(x for e in edges for x in e)
        for i, r in got.items():
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], want[i], want[i] == i)
    assert embedding_dedup(df.where("vec_id < 0")).collect() == []


def test_unrelated_vectors_are_written_once(spark, monkeypatch):
    """However many pivots there are, no table has a vector more than once."""
    rng = np.random.default_rng(16)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(16)], 0) for i in range(300)],
                               "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "PER_PIVOT", 10)
    rows, write = {}, embeddings.stored

    def counted(table, name):
        out = write(table, name)
        rows[name] = out.count() if "v" in out.columns else 0
        return out
    monkeypatch.setattr(embeddings, "stored", counted)
    assert embedding_dedup(df, block=60).count() == 300
    assert max(rows.values()) == 300


def test_tiles_of_two_blocks_against_all_pairs():
    rng = np.random.default_rng(17)
    base = rng.standard_normal((300, 8))
    x = base[rng.integers(0, 300, 2600)] + rng.standard_normal((2600, 8)) * rng.choice([0.02, 0.2, 1.0], (2600, 1))
    pivots = {8: embeddings.choose_pivots(embeddings._unit(x[:500]), 40)}
    cell = embeddings._distances(x, pivots[8]).argmin(axis=1)
    w = rng.integers(1, 4, len(x))
    cosine = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    for sides in (np.zeros(len(x), int), (np.arange(len(x)) >= 1400).astype(int)):
        table = pa.table({"cls": 7 * np.arange(len(x)) - 3, "w": w, "cell": pa.array(cell, pa.int32()), "side": pa.array(sides, pa.int32()),
                          "v": pa.array(list(x), pa.list_(pa.float64()))})
        got = {r["cls"]: r for r in embeddings._join_blocks(0.93, pivots)(table).to_pylist()}
        linked = (cosine >= 0.93) & ~np.eye(len(x), dtype=bool) & ((sides[:, None] != sides[None, :]) | (sides.max() == 0))
        want = union_find(range(len(x)), np.argwhere(linked).tolist())
        assert {c: r["n"] for c, r in got.items()} == {7 * i - 3: n for i, n in enumerate((linked @ w).tolist()) if n}
        assert all(r["root"] == 7 * want[(c + 3) // 7] - 3 for c, r in got.items())


def test_passages(frame, empty):
    rng = np.random.default_rng(7)

    def words(n, tag):
        return [f"{tag}{rng.integers(0, 10**7)}" for _ in range(n)]
    passage = " ".join(words(60, "p"))
    line = words(70, "q")
    changed = list(line)
    changed[30] = "other"
    rows = [(i, " ".join(words(40, "a")) + (f" {passage} " if i < 12 else " ") + " ".join(words(40, "e")), "s")
            for i in range(40)]
    rows += [(50, "x\n" + " ".join(line) + "\ny", "s"), (51, "z\n" + " ".join(changed) + "\nu", "s"), (52, None, "s"),
             (53, "", "s"), (54, " ".join(["same words again and more"] * 80), "s"), (55, "All rights reserved.", "s"),
             (56, "All rights reserved.", "s")]
    out = passage_dedup(frame(rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) <= {*range(12), 50, 51}
    assert len(set(by) & set(range(12))) >= 11 and {50, 51} <= set(by)
    text = dict((i, (t or "").encode()) for i, t, _ in rows)
    for i in set(by) & set(range(12)):
        assert text[i][by[i][0]["start"]:by[i][0]["end"]].decode() in passage
        assert by[i][0]["removed"] == (i != min(by)) and by[i][0]["keep_id"] == min(by)
    assert by[51][0]["removed"] and by[51][0]["keep_id"] == 50 and not by[50][0]["removed"]
    assert passage_dedup(empty).collect() == []
    assert 1 - (1 - 0.75 ** 3) ** bands_for(0.75) >= 0.99


def test_passages_inside_lines_are_all_found(frame):
    """Runs of 50 words between different texts, at any place, and of one repeated word."""
    rng = random.Random(11)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, runs = [], {}
    for pair in range(100):
        run = words(50) if pair < 98 else ["again"] * 50 if pair == 98 else ["two", "words"] * 25
        for i in (2 * pair, 2 * pair + 1):
            before, after = words(rng.randrange(5, 80)), words(rng.randrange(5, 80))
            text = " ".join(before + run[:25]) + rng.choice(["  ", "\n", "\n\n"]) + " ".join(run[25:] + after)
            rows.append((i, text, "s"))
            runs[i] = (len(before), " ".join(run))
    out = {}
    for r in passage_dedup(frame(rows)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == set(runs)
    for i, found in out.items():
        for r in found:
            span = dict((i, t) for i, t, _ in rows)[i][r["start"]:r["end"]].split()
            assert r["n_words"] == len(span) >= 25 and " ".join(span) in runs[i][1]
            assert r["keep_id"] == i - i % 2 and r["removed"] == (i % 2 == 1)


def test_passages_of_short_and_of_wrapped_lines(frame):
    """Lines of 25 words or more and paragraphs over several lines are compared whole."""
    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    def wrapped(w, width):
        return "\n".join(" ".join(w[i:i + width]) for i in range(0, len(w), width))
    rows, want = [], {}
    for pair in range(60):
        line = words(25 + pair % 14)
        last = line[:-1] + ["other"] if pair % 2 else line
        for i, w in ((2 * pair, line), (2 * pair + 1, last)):
            rows.append((i, "\n".join((" ".join(words(20)), " ".join(w), " ".join(words(20)))), "s"))
            want[i] = " ".join(w)
    for pair in range(60, 80):
        para = words(49)
        changed = para[:24] + ["other"] + para[25:]  # no 25 words in a row are left
        for i, w in ((2 * pair, wrapped(para, 10)), (2 * pair + 1, wrapped(changed, 11))):
            rows.append((i, "\n \n".join((wrapped(words(30), 10), w, wrapped(words(30), 10))), "s"))
            want[i] = w
    out = {r["doc_id"]: r for r in passage_dedup(frame(rows)).collect()}
    assert set(out) == set(want)
    for i, text, _ in rows:
        r = out[i]
        assert text[r["start"]:r["end"]] == want[i] and r["n_words"] == len(want[i].split())
        assert r["keep_id"] == i - i % 2 and r["removed"] == (i % 2 == 1)


def test_picks_of_ties_are_few_and_leave_no_gap():
    rng = np.random.default_rng(8)
    for period in (1, 2, 7, 24, 40):
        s = np.tile(rng.integers(1, 2**63, period, dtype=np.uint64), 4000 // period)
        at = passages.picks(s, np.zeros(len(s), np.int64), 25)
        assert np.diff(at).max() <= 25 and len(at) <= len(s) / 6
        assert {s[i:i + 25].min() for i in range(len(s) - 24)} == set(s[at])


def test_hashes_of_a_row_once():
    rng = np.random.default_rng(9)
    for most in (1, 3, 50, 10**6):
        own = np.sort(rng.integers(0, 40, 600))
        s = rng.integers(0, most, 600).astype(np.uint64)
        kept, rows = passages._once(s, own)
        assert list(zip(rows, kept)) == list(dict.fromkeys(zip(own, s)))
    assert len(passages._once(s[:0], own[:0])[0]) == 0


def test_cells_bound_what_sets_share(spark):
    """The bound from sizes and cells never falls below the true overlap, and
    full cells or equal sets still pass."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        n, shared = rng.choice((1, 21, 300, 3000)), rng.random()
        a = [f"a{i}w{j}" for j in range(n + 4)]
        b = [w if rng.random() < shared else f"b{w}" for w in a]
        rows.append((i, " ".join(a), " ".join(b)))
    grams = [(i, shingles(a), shingles(b)) for i, a, b in rows]
    docs = [(2 * i, a) for i, a, _ in rows] + [(2 * i + 1, b) for i, _, b in rows]
    data, bounds = passages.S.buffer_of(pa.array([t for _, t in docs]))
    h, row, _, _ = passages.S.words(data, bounds)
    s, own, _ = passages.S.shingle_hashes(h, row, len(docs))
    s, own = passages._once(s, own)
    cls = passages.S.set_keys(s, own, len(docs))[1][:, 0].tolist()
    key = {i: c for (i, _), c in zip(docs, cls)}
    spans = [[{"start": 0, "end": len(t), "cls": key[i]}] for i, t in docs]
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in docs]), pa.array(spans)], ["_text", "spans"])
    bits = {c: g for out in passages._sets([batch], True) for c, g in zip(out[0].to_pylist(), out[1].to_pylist())}
    assert set(bits) == set(cls)
    pairs = spark.createDataFrame([(i, len(a), bits[key[2 * i]], len(b), bits[key[2 * i + 1]]) for i, a, b in grams],
                                  "i int, na int, ca array<long>, nb int, cb array<long>")
    most = {r["i"]: r["o"] for r in pairs.select("i", passages._most_shared(*[F.col(c) for c in ("na", "ca", "nb", "cb")])
                                                 .alias("o")).collect()}
    assert all(len(a & b) <= most[i] <= min(len(a), len(b)) for i, a, b in grams)


def test_passage_documents_are_counted_exactly(frame):
    """A passage of 3000 documents, some of which hold it twice or changed."""
    words = [f"p{i}" for i in range(60)]
    changed = words[:30] + ["other"] + words[31:]
    rows = [(i, f"d{i}\n" + " ".join(words) + f"\ne{i}" + ("\n" + " ".join(changed) if i % 3 == 0 else "")
             + ("\n" + " ".join(words) if i % 5 == 0 else ""), "s") for i in range(3000)]
    out = passage_dedup(frame(rows)).collect()
    assert {r["doc_id"] for r in out} == set(range(3000))
    assert {(r["keep_id"], r["n_docs"], r["removed"]) for r in out if r["n_words"] >= 60} == {(0, 3000, False), (0, 3000, True)}


def test_passage_links_lose_no_colliding_pair(frame):
    """Lines that drift word by word: bucket mates link although their hubs do not."""
    rng = random.Random(5)
    rows, texts = [], {}
    for family in range(3):
        line = [f"f{family}w{i}" for i in range(60)]
        for step in range(40):
            line = list(line)
            for _ in range(rng.choice((1, 1, 2, 3))):
                line[rng.randrange(60)] = f"n{family}s{step}r{rng.randrange(10**6)}"
            texts[len(rows)] = " ".join(line)
            rows.append((len(rows), " ".join(line), "s"))
    docs = id_text(frame(rows), "doc_id", "text").repartition(7)
    units = docs.mapInArrow(lambda it: passages._paragraphs(it, bands_for(0.75)),
                            "_id long, kind int, start int, end int, words int, cls long, n int, bands array<long>").where("kind = 1").cache()
    held = {r["cls"]: (r["_id"], set(enumerate(r["bands"]))) for r in units.collect()}
    assert len(held) == len(rows)
    sets = {c: shingles(texts[i]) for c, (i, _) in held.items()}
    edges = [(a, b) for a, b in combinations(held, 2) if held[a][1] & held[b][1]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    links = [(r["a"], r["b"]) for r in passages._near(units, docs, 75).collect()]
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
    found = union_find(sets, links)
    assert edges and all(found[a] == found[b] for a, b in edges)
    assert 3 <= len(set(found.values())) < len(rows)


def test_warc_round_trip(spark):
    big, small = "<p>" + "é" * 700 + "</p>", "<p>tiny</p>"
    pages = [(1, "http://a/1", big, 0), (2, None, big, 0), (3, "http://a/3", small, 0), (4, "u 4", small, 0), (5, "u", None, 0),
             (6, "u", "", 0), (7, "u", big + "x", 0), (9, "u", big, 0), (10, "u", "a\r\n\r\nWARC/1.1" * 200, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    folder = scratch_path(spark, "warc-test").replace("file:/", "file:///", 1)
    got = {r["page_id"]: r for r in warc_round_trip(df, folder).collect()}
    assert set(got) == {p[0] for p in pages}
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = i in (1, 2)
        assert got[i]["record_type"] == ("revisit" if again else "response")
        assert got[i]["refers_to"] == (9 if again else None)
    empty = warc_round_trip(df.where("page_id < 0"), scratch_path(spark, "warc-none").replace("file:/", "file:///", 1))
    assert empty.collect() == []


def test_warc_writes_every_row(spark):
    """Null ids, ids repeated with other texts, and equal rows."""
    big, other = "<p>" + "a" * 1200 + "</p>", "<p>" + "b" * 1300 + "</p>"
    pages = [(1, "u1", big), (1, "u1", other), (1, "u1", "tiny"), (2, "u2", big), (9, None, big), (9, "u9", other), (9, "x", big),
             (None, "n", big), (None, None, big), (None, "n", None), (3, "u3", other), (3, "u3", other), (4, "u4", "tiny"),
             (5, "u5", "tiny"), (5, "u5", "tiny"), (5, "u5", "tiny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)

    def folder():
        return scratch_path(spark, "warc-rows").replace("file:/", "file:///", 1)
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        top = max(j for j, _, h in pages if h == html and j is not None) if html else None
        again = len(raw) >= 1000 and i is not None and i != top
        want[(i, "revisit" if again else "response", hashlib.sha1(raw).hexdigest(), len(raw), top if again else None)] += 1
    columns = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    assert Counter(map(tuple, warc_round_trip(df, folder()).select(*columns).collect())) == want
    at = folder()
    names, found = [r["archive"] for r in write_archives(df, at).collect()], []
    for name in names:
        with open(name, "rb") as f:
            found += [r["headers"] for r in read_archive(f.read)]
    held = {h["warc-record-id"]: h["warc-payload-digest"] for h in found if h["warc-type"] == "response"}
    assert len(found) == len({h["warc-record-id"] for h in found}) == len(pages)
    assert all(held[h["warc-refers-to"]] == h["warc-payload-digest"] for h in found if h["warc-type"] == "revisit")


def archive(records, dictionary=b""):
    import io
    w = ArchiveWriter(dictionary)
    for r in records:
        w.add(r)
    return io.BytesIO(b"".join(w.parts))


def test_warc_reader_validates():
    import zstandard
    texts = [f"<html><body>page {i} of many, with the same words</body></html>".encode() * 3 for i in range(300)]
    dictionary = zstandard.train_dictionary(2048, texts).as_bytes()
    records = [build_record(i, "http://x", t, hashlib.sha1(t).hexdigest(), None) for i, t in enumerate(texts)]
    read = [r["payload"] for r in read_archive(archive(records, dictionary).read, chunk=17)]
    assert read == texts
    with pytest.raises(WarcError):
        list(read_archive(archive([records[0] + b"x"]).read))
    with pytest.raises(WarcError):
        list(read_archive(__import__("io").BytesIO(archive(records).getvalue()[:-5]).read))
    for broken in (records[0].replace(b"Content-Length: ", b"Content-Length: 9"), records[0].replace(b"WARC/1.1", b"HTTP/1.1"),
                   records[0].replace(b"page 0", b"page 9"), records[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(WarcError):
            parse_record(broken)


def test_stages_tell_rows_with_unclear_ids_apart(spark, frame):
    """Null ids and ids that repeat with other texts: a decision takes its own row alone."""
    from quire.llm.quality import keep_good, quality_scores
    rng = np.random.default_rng(9)

    def text(i, good):
        w = [f"w{rng.integers(0, 300)}" for _ in range(60)]
        return " ".join(w) + f". t{i}" if good else " ".join([w[0]] * 40 + [x.upper() + "!!" for x in w[:20]])
    rows = [(i, text(i, i % 3 > 0), "a") for i in range(300)]
    odd = [(i, text(k, k % 2 > 0), "ab"[k % 2]) for i in (None, 7, 1000) for k in range(4)]
    table = frame(rows + odd)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300) if i != 7], "doc_id long, quality int")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    bad = sum(r["predicted"] == 0 for r in quality_scores(table, labels).collect())
    kept = texts(keep_good(table, labels))
    assert sum(kept.values()) == len(rows) + len(odd) - bad
    for i, t, s in odd:
        assert kept[(i, t)] == (s == "b")
    near = " ".join(f"n{i}" for i in range(60))
    some = [(1, near, "a"), (5, near + " x", "a"), (5, "quite another text that links with nothing", "a"), (5, "", "a"),
            (None, near, "a"), (None, "b c", "a"), (6, near + " y", "a"), (8, "d e", "b"), (5, "w " * 3, "b")]
    assert texts(keep_one_of_group(frame(some))) == Counter((i, t) for i, t, _ in some if i not in (5, 6) or "n1" not in t)
    some += [(5, "quite another text that links with nothing", "a")] * 2
    table = frame(some)
    taken = Counter()
    for r in mix(table).collect():
        taken[(r["doc_id"], r["source"], r["size"])] += r["taken"]
    got = Counter()
    for r in mixed_rows(table).collect():
        assert (r["doc_id"], r["text"], r["source"]) in some
        got[(r["doc_id"], r["source"], len(WORD.findall(r["text"])))] += len(WORD.findall(r["text"]))
    assert got == +taken


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns = columns or docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert rows and all(before[i] == t for i, t in rows)
        ids = {i for i, _ in rows}
        if name == "exact dedup":
            first = {}
            for i, t in sorted(before.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            assert ids == set(first.values())
        if name == "n-gram Jaccard join":
            sets = {i: shingles(t) for i, t in before.items()}
            edges = [(a, b) for a, b in combinations(sets, 2)
                     if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert ids == {i for i, c in union_find(sets, edges).items() if i == c}
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()
