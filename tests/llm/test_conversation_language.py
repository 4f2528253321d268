"""Operators 11, 12 and 13 against brute force."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from quire.llm import conversation_repair as CR
from quire.llm import conversation_trie as CT
from quire.llm import language_id as LI

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth int, seg int, sha string, kind int"


def frame(spark, rows):
    """conversations rows with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 7, 8, 9, "x", 1) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode())


# -- operator 11 -------------------------------------------------------------

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (rest and len(rest) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(rest)))


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of every row and up to two inserts a gap."""
    best = None
    faults, seen = [], set()
    for role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))
    options = []
    for (role, text), f in zip(rows, faults):
        late = 5 if f == "t" else 0
        options.append([(2, "D", [])] + ([] if f in ("b", "d") else [
            (late, "K", [(role, text)]), (1 + late, "R", [("user", text)]), (1 + late, "R", [("assistant", text)])]))
    gaps = [(0, "", []), (5, "I", [("user", "")]), (5, "I", [("assistant", "")]),
            (10, "II", [("user", ""), ("assistant", "")]), (10, "II", [("assistant", ""), ("user", "")])]
    slots = [gaps]
    for o in options:
        slots += [o, gaps]
    if not rows:
        return 0, "", [], faults
    for way in product(*slots):
        lines = [x for _, _, w in way for x in w]
        if not legal([r[:1] for r, _ in lines] and "".join(r[:1] or "?" for r, _ in lines)):
            continue
        key = (sum(c for c, _, _ in way), "".join(a for _, a, _ in way))
        if best is None or key < best[:2]:
            best = (*key, lines)
    return (*best, faults)


def by_hand(rows):
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in after if r[0] == conv],
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2]).digest()))
        cost, audit, lines, faults = cheapest([r[1:] for r in mine])
        turns = [r[0] for r in mine if r[0] is not None]
        first = [r[1][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in "bdt"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                     sha("\n".join(f"{r}:{t}" for r, t in lines)).hexdigest())
    return out


def repaired(spark, rows, **kw):
    got = CR.repair_conversations(CR.damage(frame(spark, rows))).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def random_conversations(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["a.", "b", " c!\n", "", " \t", "d?", None, f"t{turn}."])
            rows.append((conv, draw.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def test_repairs_equal_all_edits_tried(spark):
    rows = random_conversations(5, 25, 3) + [(None, 0, "user", "hi."), (None, 1, "assistant", "yes."), (99, 3, "user", "x.")] * 2
    assert repaired(spark, rows) == by_hand(rows)


def fold(steps):
    """(cost, audit) by a plain fold over rows of (initial, kind, n)."""
    def closed(v):
        for q in (0, 1, 3, 2):  # at most two inserts in a row help
            if v[q]:
                to = CR.AFTER[q]
                v[to] = min(filter(None, [v[to], (v[q][0] + 5, v[q][1] + "I")]))
        return v
    v = closed([(0, ""), None, None, None])
    for step in steps:
        new = [None] * 4
        for q in range(4):
            if v[q]:
                for to, c, a in CR.row_edits(*step)[q]:
                    new[to] = min(filter(None, [new[to], (v[q][0] + c, v[q][1] + a)]))
        v = closed(new)
    return min(filter(None, [v[0], v[3]]))


def test_agenda_of_long_conversations_in_spans():
    draw = random.Random(1)
    steps = [(draw.choice("suat"), draw.randrange(3), draw.choice([1, 1, 3])) for _ in range(700)]
    steps = [(i, k, n if k == CR.GONE else 1) for i, k, n in steps]
    for cut in (700, 64, 7):
        spans = [dict(zip(("costs", "audits"), CR.span_moves(tuple(steps[i:i + cut])))) | {
            "first": "u", "last": "u", "lo": None, "hi": None, **dict.fromkeys(CR.NUMBERS, 0)} for i in range(0, 700, cut)]
        assert CR.repair(CR.join_spans(spans)) == fold(steps)


def test_a_long_conversation_is_shared_out(spark):
    draw = random.Random(2)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice(["a.", "b", ""]) + str(t % 7) + ".") for t in range(400)]
    rows += random_conversations(3, 6, 3)
    turns = CR.damage(frame(spark, rows))
    whole = {r.conv: CR.repair(r.asDict()) for r in CR.conversation_spans(turns).collect()}
    parts = {r.conv: CR.repair(r.asDict()) for r in CR.conversation_spans(turns, span=8, fan=3).collect()}
    assert parts == whole
    got = repaired(spark, rows)
    lines = defaultdict(list)
    for r in CR.repaired_turns(turns).collect():
        lines[r.conv].append((r.place, f"{r.role}:{r.text}"))
    for conv, want in got.items():
        assert sha("\n".join(x for _, x in sorted(lines[conv]))).hexdigest() == want[-1]


def test_repair_of_an_empty_table(spark):
    assert CR.repair_conversations(CR.damage(frame(spark, [(1, 1, "user", "x")]).where("conv_id < 0"))).collect() == []


# -- operator 12 -------------------------------------------------------------

def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role.encode())}:{role}{text}").digest()
            own[c].append(((turn is not None, turn or 0, role.encode(), digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for node, cs in members.items():
        under = [n for n in members if n[:len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(m[:len(n)] == n and len(m) == len(n) + 1 for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(node)))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved,
                 sha(ends).hexdigest()))
    return out


def trie_rows(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 12), 100, 103, *range(205, 215), 777, *range(1000, 1006)]:
        n = draw.randint(1, 7)
        for turn in range(n):
            rows.append((c, draw.choice([turn, turn, None]) if c % 3 == 0 else turn, draw.choice(["user", "a", None]),
                         draw.choice(["x", "yé", None, f"{turn}", "日本"])))
    return rows + rows[:3] + [(None, 1, "user", "left out"), (500, 0, "u", "same"), (501, 0, "u", "same"), (502, 0, "u", "same")]


def trie(df, **kw):
    got = CT.prefix_trie(df, **kw)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    rows = got.collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_trie_equals_rebuilt_texts(spark):
    rows = trie_rows(4)
    assert trie(frame(spark, rows)) == trie_by_hand(rows)


def test_trie_in_small_blocks_and_deep_copies(spark):
    deep = [(c, t, "user", f"t{t % 5}") for c in (300, 304, 350) for t in range(40)]
    assert trie(frame(spark, deep), block=4) == trie_by_hand(deep)


def test_trie_draws_again_when_fingerprints_clash(spark, monkeypatch):
    real = CT.bases
    tried = []

    def weak(seed):
        tried.append(seed)
        return [1] * CT.LANES if seed == 1 else real(seed)  # base 1: order is lost
    monkeypatch.setattr(CT, "bases", weak)
    h5 = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 == 0 and c % 100)
    h6 = next(c for c in range(h5 + 1, 200) if zlib.crc32(str(c).encode()) % 6 == 0)
    rows = [(h5, 0, "u", "a"), (h5, 1, "u", "b"), (h6, 0, "u", "b"), (h6, 1, "u", "a")]
    assert trie(frame(spark, rows)) == trie_by_hand(rows)
    assert tried == [1, 2]


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert trie(frame(spark, [(1, 1, "u", "x")]).where("conv_id < 0")) == set()
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(c, 0, "u", "x"), (c, 1, "a", "y")]
    assert trie(frame(spark, rows)) == trie_by_hand(rows)
    assert {r[1] for r in trie_by_hand(rows)} == {0}


# -- operator 13 -------------------------------------------------------------

WORDS = {"xx": ["tion", "the", "and", "sher", "of"], "yy": ["été", "que", "ment", "les", "où"],
         "zz": ["für", "und", "schen", "groß", "über"]}


def language_rows(n=240):
    draw = random.Random(6)
    rows = []
    for i in range(n):
        lang = draw.choice(list(WORDS))
        words = [draw.choice(WORDS[lang]) + draw.choice(["", draw.choice(WORDS[lang])]) for _ in range(draw.randint(3, 60))]
        rows.append((i, draw.choice([". ", " ", "\n"]).join(words), lang if i % 17 else None))
    return rows + [(n, None, "xx"), (n + 1, "", "xx"), (n + 2, "12 34 !!", "yy"), (n + 3, "日本", None), (None, "the sher", "xx"),
                   (3, rows[3][1], rows[3][2]), (n + 4, "und schen " * 40000, "zz"), (n + 5, "ment" * 60000, "yy")]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(*r, "s", 1, 2.0, "clash") for r in language_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gram int, score double, lang_pred string")


def exact_sets(rows):
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 4 != 2:
            for piece in LI.pieces(text):
                low = "".join(c if c.isalpha() else " " for c in piece.lower()).split()
                if low:
                    s = " " + " ".join(low) + " "
                    for n in (1, 2, 3):
                        counts[lang].update(g for g in (s[k:k + n] for k in range(len(s) - n + 1))
                                            if g != " " and not (n == 3 and g[1] == " "))
    rates = {}
    for lang, c in counts.items():
        whole = Counter()
        for g, n in c.items():
            whole[len(g)] += n
        rates[lang] = {g: n / whole[len(g)] for g, n in c.items() if n / whole[len(g)] >= LI.MIN_RATE}
    best = Counter()
    for r in rates.values():
        for g, x in r.items():
            best[g] = max(best[g], x)
    return {k: {g for g, x in r.items() if x >= LI.MIN_SHARE * best[g]} for k, r in rates.items()}


def packed(g):
    return sum(ord(c) << 21 * i for i, c in enumerate(g))


def test_learned_ngrams_are_the_plain_counts(spark, texts):
    train = texts.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 4 <> 2")
    want = {k: {packed(g) for g in v} for k, v in exact_sets(language_rows()).items()}
    got = defaultdict(set)
    for r in LI.learn(train).collect():
        got[r.lang].add(r.gram)
    assert got == want
    model = LI.fit_filter(train)
    keys = np.array(sorted(set().union(*want.values())), np.int64)
    masks = model.rows[model.places(keys, len(model.rows))[0]]
    for places in model.places(keys, len(model.rows))[1:]:
        masks &= model.rows[places]
    for k, lang in enumerate(model.langs):
        found = set(keys[model._bit(masks, k).astype(bool)].tolist())
        assert want[lang] <= found, "a Bloom filter loses nothing"
        assert len(found - want[lang]) <= 5 + 3 * model.false[k] * len(keys)


def test_predictions_equal_exact_sets_and_labels(texts):
    rows = language_rows()
    sets = exact_sets(rows)
    got = LI.identify_languages(texts).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    right = held = 0
    for i, text, lang in rows:
        r = by_id[i]
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2)
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif i == 243:  # no n-gram of it is known
            assert r.lang_pred in sets
        else:
            keys = {g for piece in LI.pieces(text) for g in LI.grams(piece).tolist()}
            hits = {k: len(keys & {packed(g) for g in v}) for k, v in sets.items()}
            first, second = sorted(hits.values(), reverse=True)[:2]
            if first > second * 1.2 + 2:
                assert r.lang_pred == max(sorted(hits), key=hits.get)
            if r.held_out and lang:
                held += 1
                right += r.lang_pred == lang
    assert held > 30 and right / held >= 0.97


def test_many_languages_take_several_words(spark):
    rows = [(i * 7 + j, chr(0x4E00 + 10 * i) * 3 + " " + chr(0x4E01 + 10 * i) * 2, f"l{i:03d}") for i in range(80) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LI.fit_filter(df)
    assert model.rows.shape[1] == 2
    assert all(model.decide(t)[0] == lang for _, t, lang in rows)


def test_nothing_learned(spark, texts):
    got = LI.identify_languages(texts.withColumn("lang", texts["lang"].substr(1, 0)).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in got.collect()} == {"und"}
    assert LI.identify_languages(texts.where("doc_id < 0")).collect() == []
