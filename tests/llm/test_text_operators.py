"""Operators 1, 3, 5, 8 and 7 against plain versions on edge cases."""
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest

from quire.llm.exact_dedup import exact_dedup, keep_first
from quire.llm.quality import isotonic, quality_scores
from quire.llm.secrets import secret_scan
from quire.llm.sentencepiece_spans import Encoder, Normaliser, _fields, encode
from quire.llm.token_counts import Lengths, token_counts
from pyspark.sql import functions as F

from conftest import ROWS  # noqa: F401  (tests/llm/conftest.py)

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    got = sorted(map(tuple, token_counts(docs, BPE, batch_bytes=64, memory_chars=100).collect()))
    want = sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 1024)
                  for i, t, _ in ROWS)
    assert got == want
    assert token_counts(empty, BPE).collect() == []


def test_token_pieces_are_safe_for_random_texts():
    from tokenizers import Tokenizer
    tok, rng = Tokenizer.from_file(BPE), np.random.default_rng(5)
    with open(BPE, "rb") as f:
        lengths = Lengths(f.read(), 50, 500)
    parts = [" ", "  ", "\n", "\t", "a", "B", "1", "'s", "'", "!!", "\xa0", "\x1c", "\x85", "é", "<|endoftext|>", "<|", "日"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert lengths.of([text])[0] == len(tok.encode(text, add_special_tokens=False)), repr(text)


def test_exact_dedup_against_brute_force(docs, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in ROWS]
    for bits in (64, 2):  # two bits: hashes stand for several chunks
        out = exact_dedup(docs, hash_bits=bits).collect()
        assert len(out) == len(ROWS)
        for r in out:
            text = dict(norm)[r["doc_id"]]
            group = [i for i, t in norm if t == text]
            assert (r["keep_id"], r["group_size"]) == (min(group), len(group))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        kept = [r["doc_id"] for r in out if r["kept"]]
        assert sorted(kept) == sorted({min(i for i, t in norm if t == x) for _, x in norm})
    rows = keep_first(docs)
    assert rows.columns == docs.columns and sorted(r["doc_id"] for r in rows.collect()) == sorted(kept)
    assert exact_dedup(empty).collect() == [] and keep_first(empty).collect() == []


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    for r in encode(docs, SP, batch_bytes=256).collect():
        text = dict((i, t or "") for i, t, _ in ROWS)[r["doc_id"]]
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
        size = len(text.encode())
        spans = list(zip(r["begins"], r["ends"]))
        assert all(0 <= a <= b <= size for a, b in spans)
        inner = spans[1:-1]  # spans follow each other and cover the text
        assert [a for a, _ in inner[1:]] == [b for _, b in inner[:-1]]
        assert not inner or (inner[0][0], inner[-1][1]) == (0, size)
    assert encode(empty, SP).collect() == []


def test_cut_texts_encode_alike():
    import sentencepiece
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=SP), np.random.default_rng(6)
    with open(SP, "rb") as f:
        encoder = Encoder(f.read())
    for _ in range(800):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "Bc", "é", "日", "▁", "the", "<s>"], rng.integers(0, 30)))
        assert encoder.ids([text], 3)[0].tolist() == sp.encode(text, add_bos=True, add_eos=True), repr(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_map_normalises_like_the_library(rule):
    import sentencepiece
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = Normaliser(next(v for n, v in _fields(lib.serialized_model_proto()) if n == 3))
    rng = np.random.default_rng(7)
    for _ in range(500):
        text = "".join(rng.choice([" ", "  ", "Ａ", "ﬁ", "é", "①", "ｶﾞ", "x", "　", "\t", "ß"], rng.integers(0, 12)))
        norm, source = own(text.encode())
        assert norm.decode() == lib.normalize(text)
        assert len(source) == len(norm) + 1 and (np.diff(source) >= 0).all()


def test_secret_scan(frame, empty):
    live, copied = "tk9fQ2xLr7Bz0Wm4Yc8v", "ab12cd34ef56ab12cd34ef56"
    rows = [(1, f"password: hunter22 x\U0001f600 AKIA{'Z9' * 8}", "a"), (2, f"key {live} and {live}", "b"),
            (3, f"see {copied}", "a"), (4, f"see {copied}", "b"), (5, None, None), (6, "password=ab; token == 'x'", "a"),
            (7, "password=token: abcdefgh API_KEY=\"q1w2e3r4\" " + "0" * 23, "c")]
    out = {r["doc_id"]: r for r in secret_scan(frame(rows), F.col("source"), F.col("source")).collect()}
    assert out[1]["spans"].startswith("assign:0:18,access:22:42")
    assert (out[1]["n_assign"], out[1]["n_access"], out[1]["n_hex"]) == (1, 1, 0)
    assert out[2]["spans"] == "live:4:24,live:29:49" and out[2]["n_live"] == 2
    assert out[3]["spans"] == "hex:4:28" and out[3]["n_copied"] == 1 and out[4]["n_live"] == 0
    assert out[5]["spans"] == "" and out[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[6]["n_assign"] == 0
    # the first match swallows the second keyword, as leftmost matches do
    assert out[7]["n_assign"] == 1 and out[7]["n_hex"] == 0
    assert secret_scan(empty, F.col("source"), F.col("source")).collect() == []


def test_secret_scan_rates_by_repositories_and_all_base_values(frame):
    sample, own = "tk9fQ2xLr7Bz0Wm4Yc8v", "Zk3Wq81mVb6Ty0Xs5Lp7"
    rows = [(i, f"see {sample} or password=changeme123", "hot") for i in range(40)]  # one owner, all its repositories
    rows += [(100, f"key {own} token: a.b-c.d9", "hot"), (101, "SECRET = a.b-c.d9", "b"), (102, "AKIA" + "QWERTYUIOPASDFGH", "b"),
             (103, "api_key=AKIA" + "QWERTYUIOPASDFGH", "c"), (104, "password: only.one.owner", "c"),
             (105, f"key {own}", "hot"), (106, "secret=" + "9f" * 3 + "0123456789abcdef0123", "c")]
    table = frame(rows).withColumn("lang", F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.expr("int(doc_id % 4 + 1)")))
    out = {r["doc_id"]: r for r in secret_scan(table, F.concat_ws("/", "source", "lang"), F.col("source")).collect()}
    got = {i: (r["spans"], r["n_live"], r["n_copied"]) for i, r in out.items()}
    assert {got[i] for i in range(40)} == {("assign:28:48", 0, 2)}
    assert got[100] == ("live:4:24,assign:25:40", 1, 1) and got[101] == ("assign:0:17", 0, 1)
    assert got[102] == ("access:0:20", 0, 1) and got[103] == ("assign:0:28,access:8:28", 0, 1)
    assert got[104] == ("assign:0:24", 1, 0) and got[105] == ("live:4:24", 1, 0)
    assert got[106] == ("assign:0:33,hex:7:33,live:7:33", 1, 0)


def test_isotonic_pools_violators():
    x, y = isotonic(np.array([0., 1, 2, 3]), np.array([0., 1, 0, 1]), np.array([1., 1, 1, 1]))
    assert y.tolist() == [0, .5, 1] and x.tolist() == [0, 1.5, 3]


def test_quality_separates_held_out_rows(spark, frame, empty):
    from zlib import crc32
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.integers(0, 300)}" for _ in range(60)]
        good = i % 3 > 0
        rows.append((i, " ".join(words) + "." if good else " ".join([words[0]] * 40 + [w.upper() + "!!" for w in words[:20]]), "a"))
        labels.append((i, int(good)))
    labels.append((2, None))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    extra = [(1000, None, None), (1001, "", "b")]
    out = {r["doc_id"]: r for r in quality_scores(frame(rows + extra), table).collect()}
    held = [i for i in range(400) if crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in held) for i in range(400))
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in held]) >= 0.95
    assert out[1000]["score"] == out[1001]["score"] and 0 <= out[1000]["score"] <= 1
    assert quality_scores(empty, table).collect() == []
    assert {r["score"] for r in quality_scores(frame(rows[:5]), table.limit(0)).collect()} == {0.5}
