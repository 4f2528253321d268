"""DuckDB oracle SQL for the registered queries (same names, same columns)."""

from __future__ import annotations

from quire import oracle as O
from quire.functions.analyzers import ENGLISH_STOP_WORDS
from quire.operators.tfidf import COUNT, TFIDF, VectorizerParams

W = O.with_papers
TOK = O.TOKENIZED_CTE


def _list(words) -> str:
    return "[" + ", ".join(O.q(w) for w in words) + "]"


def analyzer_sql(expr: str, ngram_range=(1, 1), stop_words=None, lowercase=True) -> tuple[str, str]:
    """Two expressions: base terms (over ``expr``) and n-grams over column ``t0``."""
    base = O.analyze_terms(f"lower({expr})" if lowercase else expr)
    if stop_words:
        base = f"list_filter({base}, lambda x: NOT list_contains({_list(stop_words)}, x))"
    lo, hi = ngram_range
    grams = None
    for n in range(lo, hi + 1):
        if n == 1:
            part = "t0"
        else:
            part = (f"list_transform(range(0, greatest(len(t0) - {n - 1}, 0)), "
                    f"lambda i: array_to_string(t0[i + 1:i + {n}], ' '))")
        grams = part if grams is None else f"list_concat({grams}, {part})"
    return base, grams


def terms_ctes(params: VectorizerParams, src: str = "txt", text: str = "text",
               prefix: str = "") -> list[str]:
    base, grams = analyzer_sql(text, params.ngram_range, params.stop_words, params.lowercase)
    return [
        f"{prefix}t0 AS (SELECT paper_id, split, {base} AS t0 FROM {src})",
        f"{prefix}tf AS (SELECT paper_id, split, term, count(*) AS tf FROM "
        f"(SELECT paper_id, split, unnest({grams}) AS term FROM {prefix}t0) GROUP BY ALL)",
    ]


def vocab_ctes(params: VectorizerParams, src: str = "txt", prefix: str = "") -> list[str]:
    n = f"(SELECT CAST(count(*) AS DOUBLE) FROM {src} WHERE split = 'train')"
    if params.smooth_idf:
        idf = f"ln(({n} + 1.0e0) / (df + 1.0e0)) + 1.0e0"
    else:
        idf = f"ln({n} / df) + 1.0e0"
    return [
        f"{prefix}vocab0 AS (SELECT term, count(*) AS df FROM {prefix}tf WHERE split = 'train' "
        f"GROUP BY term)",
        f"{prefix}vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, "
        f"{idf} AS idf FROM {prefix}vocab0)",
    ]


def weight_ctes(params: VectorizerParams, where: str = "paper_id IS NOT NULL",
                prefix: str = "", inputs: str | None = None) -> list[str]:
    inp = prefix if inputs is None else inputs
    tfw = "(ln(CAST(tf AS DOUBLE)) + 1.0e0)" if params.sublinear_tf else "CAST(tf AS DOUBLE)"
    value = f"{tfw} * idf" if params.use_idf else tfw
    ctes = [f"{prefix}w0 AS (SELECT t.paper_id, v.idx, t.term, {value} AS value FROM {inp}tf t "
            f"JOIN {inp}vocab v USING (term) WHERE t.{where})"]
    if params.norm == "l2":
        norm = "value / sqrt(sum(value * value) OVER (PARTITION BY paper_id))"
    elif params.norm == "l1":
        norm = "value / sum(abs(value)) OVER (PARTITION BY paper_id)"
    else:
        norm = "value"
    ctes.append(f"{prefix}w AS (SELECT paper_id, idx, term, {norm} AS value FROM {prefix}w0)")
    return ctes


def tfidf_sql(params: VectorizerParams) -> str:
    ctes = [TOK] + terms_ctes(params) + vocab_ctes(params) + weight_ctes(params)
    return W(*ctes) + "SELECT paper_id, term, idx, round(value, 4) AS value FROM w"


def hash_ctes(src_tf: str = "tf", where: str = "true", width: int = 1 << 20,
              prefix: str = "h") -> list[str]:
    return [
        f"{prefix}0 AS (SELECT paper_id, tf, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS u "
        f"FROM {src_tf} WHERE {where})",
        f"{prefix}1 AS (SELECT paper_id, tf, CASE WHEN u >= 2147483648 THEN u - 4294967296 "
        f"ELSE u END AS h FROM {prefix}0)",
        f"{prefix}2 AS (SELECT paper_id, abs(h) % {width} AS idx, sum(CASE WHEN h >= 0 THEN 1.0e0 "
        f"ELSE -1.0e0 END * tf) AS value FROM {prefix}1 GROUP BY ALL)",
        f"{prefix}3 AS (SELECT paper_id, idx, value / sqrt(sum(value * value) OVER "
        f"(PARTITION BY paper_id)) AS value FROM {prefix}2 WHERE value <> 0)",
    ]


def _digest(expr_list: str) -> str:
    return f"len({expr_list}) AS n_terms, md5(array_to_string({expr_list}, '|')) AS digest"


SQL = {}

SQL["row_ids"] = W() + "SELECT paper_id, rn FROM papers"
SQL["union_splits"] = W() + (
    "SELECT split, paper_id, rn FROM papers WHERE split = 'train' "
    "UNION ALL SELECT split, paper_id, rn FROM papers WHERE split = 'test'")
SQL["split_counts"] = W() + "SELECT split, count(*) AS n FROM papers GROUP BY split"
SQL["positional_split"] = W("nt AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM papers)") + (
    "SELECT paper_id, rn, CASE WHEN rn < n THEN 'train' ELSE 'test' END AS part "
    "FROM papers, nt WHERE rn < n + n // 8")
SQL["contiguous_folds"] = W(
    "tr AS (SELECT paper_id, rn FROM papers WHERE split = 'train')",
    "k AS (SELECT count(*) // 4 AS q, count(*) % 4 AS m FROM tr)") + (
    "SELECT paper_id, rn, CAST(CASE WHEN rn < m * (q + 1) THEN rn // (q + 1) "
    "ELSE m + (rn - m * (q + 1)) // q END AS INTEGER) AS fold FROM tr, k")
SQL["lower_ascii"] = W() + f"SELECT paper_id, {O.lower_ascii('title')} AS value FROM papers"
SQL["keyword_summary"] = W() + \
    f"SELECT paper_id, {O.keyword_summary('keywords')} AS value FROM papers"
SQL["symbol_split"] = W() + f"SELECT paper_id, {O.symbol_split('abstract')} AS value FROM papers"
SQL["treebank_tokens"] = W(
    f"tt AS (SELECT paper_id, {O.treebank_tokens('abstract')} AS t FROM papers)") + \
    "SELECT paper_id, len(t) AS n_tokens, array_to_string(t, ' ') AS value FROM tt"
SQL["period_split"] = W(
    f"tt AS (SELECT paper_id, {O.split_periods(O.treebank_tokens('abstract'))} AS t FROM papers)"
) + "SELECT paper_id, array_to_string(t, ' ') AS value FROM tt"
SQL["core_tokenize"] = W() + f"SELECT paper_id, {O.core_tokenize('abstract')} AS value FROM papers"
SQL["record_tokenize"] = W(TOK) + \
    "SELECT paper_id, kw AS keywords, title_t AS title, abstract_t AS abstract FROM tok"
SQL["concat_text"] = W(TOK) + "SELECT paper_id, text FROM txt"
SQL["typed_features"] = W(TOK) + (
    "SELECT paper_id, kw AS keywords, title_t AS title, abstract_t AS abstract, venue, year, "
    "n_citation AS citations, label FROM tok")

_b, _ = analyzer_sql("text")
SQL["analyze_terms"] = W(TOK, f"a AS (SELECT paper_id, {_b} AS t FROM txt)") + \
    f"SELECT paper_id, {_digest('t')} FROM a"
_b, _g = analyzer_sql("text", (1, 3))
SQL["ngram_terms"] = W(TOK, f"a AS (SELECT paper_id, {_b} AS t0 FROM txt)",
                       f"g AS (SELECT paper_id, {_g} AS t FROM a)") + \
    f"SELECT paper_id, {_digest('t')} FROM g"
_b, _ = analyzer_sql("text", stop_words=ENGLISH_STOP_WORDS)
SQL["stopword_filter"] = W(TOK, f"a AS (SELECT paper_id, {_b} AS t FROM txt)") + \
    f"SELECT paper_id, {_digest('t')} FROM a"

SQL["vocabulary"] = W(TOK, *terms_ctes(TFIDF), *vocab_ctes(TFIDF)) + \
    "SELECT term, idx, df, round(idf, 4) AS idf FROM vocab"
SQL["idf_smooth"] = W(TOK, *terms_ctes(TFIDF), *vocab_ctes(TFIDF)) + \
    "SELECT term, round(idf, 4) AS idf FROM vocab"
_raw = VectorizerParams(smooth_idf=False)
SQL["idf_raw"] = W(TOK, *terms_ctes(_raw), *vocab_ctes(_raw)) + \
    "SELECT term, round(idf, 4) AS idf FROM vocab"
SQL["count_vectorize"] = tfidf_sql(COUNT)
SQL["tfidf"] = tfidf_sql(TFIDF)
SQL["tf_sublinear"] = tfidf_sql(VectorizerParams(sublinear_tf=True))
SQL["norm_l1"] = tfidf_sql(VectorizerParams(norm="l1", smooth_idf=False, sublinear_tf=True))
SQL["norm_l2"] = tfidf_sql(VectorizerParams(ngram_range=(1, 2)).with_stop_words(True))
SQL["tfidf_transform_test"] = W(TOK, *terms_ctes(TFIDF), *vocab_ctes(TFIDF),
                                *weight_ctes(TFIDF, where="split = 'test'")) + (
    "SELECT t.paper_id, w.term, w.idx, round(w.value, 4) AS value "
    "FROM txt t LEFT JOIN w USING (paper_id) WHERE t.split = 'test'")
SQL["hash_vectorize"] = W(TOK, *terms_ctes(TFIDF), *hash_ctes()) + \
    "SELECT paper_id, idx, round(value, 4) AS value FROM h3"
SQL["feature_union"] = W(
    TOK, *terms_ctes(TFIDF), *vocab_ctes(TFIDF), *weight_ctes(TFIDF, where="paper_id IS NOT NULL"),
    *weight_ctes(COUNT, prefix="c_", inputs="", where="paper_id IS NOT NULL"),
    *hash_ctes(),
    "nv AS (SELECT count(*) AS v FROM vocab)") + (
    "SELECT paper_id, idx, round(value, 4) AS value FROM w "
    "UNION ALL SELECT paper_id, idx + (SELECT v FROM nv), round(value, 4) FROM c_w "
    "UNION ALL SELECT paper_id, idx + 2 * (SELECT v FROM nv), round(value, 4) FROM h3")


def _column_tfidf_sql() -> str:
    ctes = [TOK]
    p = VectorizerParams(lowercase=False)
    cols = ["kw", "title_t", "abstract_t", "venue"]
    selects = []
    offset = "0"
    for i, c in enumerate(cols):
        pre = f"c{i}_"
        ctes += terms_ctes(p, src="tok", text=c, prefix=pre)
        ctes += vocab_ctes(p, src="tok", prefix=pre)
        ctes += weight_ctes(p, prefix=pre, where="paper_id IS NOT NULL")
        selects.append(f"SELECT paper_id, idx + {offset} AS idx, value FROM {pre}w")
        offset = f"{offset} + (SELECT count(*) FROM {pre}vocab)"
    selects.append(f"SELECT paper_id, {offset} AS idx, CAST(year AS DOUBLE) AS value "
                   f"FROM tok WHERE year <> 0")
    selects.append(f"SELECT paper_id, {offset} + 1 AS idx, CAST(n_citation AS DOUBLE) AS value "
                   f"FROM tok WHERE n_citation <> 0")
    body = " UNION ALL ".join(selects)
    return W(*ctes) + f"SELECT paper_id, idx, round(value, 4) AS value FROM ({body})"


SQL["column_tfidf"] = _column_tfidf_sql()


# ---------------------------------------------------------------------------
# one-feature least squares, scores, cross-validation, selection
# ---------------------------------------------------------------------------

_X = f"CAST(len({O.analyze_terms('lower(text)')}) AS DOUBLE)"
ONE_FEATURE = [TOK, f"f AS (SELECT paper_id, rn, split, label, {_X} AS x FROM txt)",
               "tr AS (SELECT * FROM f WHERE split = 'train')",
               "c AS (SELECT regr_slope(label, x) AS b1, regr_intercept(label, x) AS a1, "
               "sum(x * label) / sum(x * x) AS b0 FROM tr)"]


def _scores(p: str, extra: str = "") -> str:
    res = f"(label - {p})"
    return (f"{extra}count(*) AS n, round(avg({res} * {res}), 4) AS mse, "
            f"round(avg(abs({res})), 4) AS mae, "
            f"round(CASE WHEN var_pop(label) * count(*) > 0 THEN 1.0e0 - sum({res} * {res}) / "
            f"(var_pop(label) * count(*)) WHEN sum({res} * {res}) = 0 THEN 1.0e0 ELSE 0.0e0 END, 4)"
            f" AS r2")


def _r2(p: str) -> str:
    res = f"(label - {p})"
    return (f"CASE WHEN var_pop(label) * count(*) > 0 THEN 1.0e0 - sum({res} * {res}) / "
            f"(var_pop(label) * count(*)) WHEN sum({res} * {res}) = 0 THEN 1.0e0 ELSE 0.0e0 END")


SQL["lr_simple"] = W(*ONE_FEATURE) + (
    "SELECT true AS fit_intercept, round(b1, 4) AS slope, round(a1, 4) AS intercept FROM c "
    "UNION ALL SELECT false, round(b0, 4), 0.0e0 FROM c")
SQL["regression_metrics"] = W(*ONE_FEATURE) + (
    f"SELECT {_scores('(a1 + b1 * x)')} FROM f, c WHERE split = 'test'")

CV = ONE_FEATURE + [
    "k AS (SELECT count(*) // 4 AS q, count(*) % 4 AS m FROM tr)",
    "fo AS (SELECT tr.*, CAST(CASE WHEN rn < m * (q + 1) THEN rn // (q + 1) "
    "ELSE m + (rn - m * (q + 1)) // q END AS INTEGER) AS fold FROM tr, k)",
    "fl AS (SELECT DISTINCT fold FROM fo)",
    "cf AS (SELECT fl.fold, regr_slope(fo.label, fo.x) AS b1, regr_intercept(fo.label, fo.x) AS a1, "
    "sum(fo.x * fo.label) / sum(fo.x * fo.x) AS b0 FROM fl JOIN fo ON fo.fold <> fl.fold "
    "GROUP BY fl.fold)",
    "pr AS (SELECT fo.fold, fo.label, cf.a1 + cf.b1 * fo.x AS p0, cf.b0 * fo.x AS p1 "
    "FROM fo JOIN cf USING (fold))",
    f"sc AS (SELECT 0 AS candidate, fold, {_r2('p0')} AS r2 FROM pr GROUP BY fold "
    f"UNION ALL SELECT 1, fold, {_r2('p1')} FROM pr GROUP BY fold)",
    "mn AS (SELECT candidate, avg(r2) AS mean_r2 FROM sc GROUP BY candidate)",
    "best AS (SELECT candidate, mean_r2 FROM mn ORDER BY mean_r2 DESC, candidate LIMIT 1)",
    "bc AS (SELECT CASE WHEN (SELECT candidate FROM best) = 0 THEN a1 ELSE 0.0e0 END AS a, "
    "CASE WHEN (SELECT candidate FROM best) = 0 THEN b1 ELSE b0 END AS b FROM c)",
]
SQL["cv_scores"] = W(*CV) + "SELECT CAST(candidate AS INTEGER) AS candidate, fold, round(r2, 4) AS r2 FROM sc"
SQL["best_candidate"] = W(*CV) + \
    "SELECT CAST(candidate AS INTEGER) AS candidate, round(mean_r2, 4) AS mean_r2 FROM best"
SQL["best_predict"] = W(*CV) + \
    "SELECT paper_id, round(a + b * x, 4) AS prediction FROM f, bc WHERE split = 'test'"
SQL["compare_models"] = W(*CV) + (
    f"SELECT {_scores('(a1 + b1 * x)', 'model, ')} FROM (SELECT 'default' AS model, * FROM f) f2, c "
    f"WHERE split = 'test' GROUP BY model "
    f"UNION ALL SELECT {_scores('(a + b * x)', 'model, ')} FROM (SELECT 'best' AS model, * FROM f) f3, bc "
    f"WHERE split = 'test' GROUP BY model")


# ---------------------------------------------------------------------------
# sequences, word vectors, convolution
# ---------------------------------------------------------------------------

def _seq_words(expr: str) -> str:
    from quire.functions.analyzers import SEQUENCE_FILTERS
    cls = "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in SEQUENCE_FILTERS) + "]"
    spaced = O.rx(f"lower({expr})", cls, " ")
    return f"list_filter(string_split({spaced}, ' '), lambda t: length(t) > 0)"


SEQ = [TOK,
       f"ws AS (SELECT paper_id, rn, {_seq_words('text')} AS w FROM txt)",
       "wp AS (SELECT paper_id, rn, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM ws)",
       "wi0 AS (SELECT term, count(*) AS cnt, min(struct_pack(o := rn, p := pos)) AS fo "
       "FROM wp GROUP BY term)",
       "wi AS (SELECT term, row_number() OVER (ORDER BY cnt DESC, fo.o, fo.p) AS idx, cnt FROM wi0)",
       "sq AS (SELECT wp.paper_id, list(wi.idx ORDER BY wp.pos) AS seq FROM wp JOIN wi USING (term) "
       "GROUP BY wp.paper_id)",
       "seqs AS (SELECT t.paper_id, coalesce(sq.seq, CAST([] AS BIGINT[])) AS seq FROM txt t "
       "LEFT JOIN sq USING (paper_id))",
       "kept AS (SELECT paper_id, CASE WHEN len(seq) > 400 THEN seq[len(seq) - 399:] "
       "ELSE seq END AS seq FROM seqs)",
       "padded AS (SELECT paper_id, list_concat(seq, list_transform(range(0, 400 - len(seq)), "
       "lambda i: CAST(0 AS BIGINT))) AS seq FROM kept)",
       "vw AS (SELECT wi.term, wi.idx, CAST(e.embedding AS DOUBLE[]) AS vec FROM wi "
       "JOIN embeddings e ON e.vec_id = wi.idx)"]

SQL["sequence_vocabulary"] = W(*SEQ) + "SELECT term, idx, cnt FROM wi"
SQL["texts_to_sequences"] = W(*SEQ) + \
    "SELECT paper_id, len(seq) AS n, md5(array_to_string(seq, ' ')) AS digest FROM seqs"
SQL["pad_sequences"] = W(*SEQ) + (
    "SELECT paper_id, len(seq) AS n, len(list_filter(seq, lambda x: x <> 0)) AS n_words, "
    "md5(array_to_string(seq, ' ')) AS digest FROM padded")
_ZEROS64 = "list_transform(range(0, 64), lambda i: 0.0e0)"
SQL["embedding_lookup"] = W(*SEQ) + (
    f"SELECT wi.idx, wi.term, vw.vec IS NOT NULL AS known, "
    f"round(list_reduce(list_prepend(0.0e0, coalesce(vw.vec, {_ZEROS64})), lambda a, b: a + b), 4) AS vsum, "
    f"round(sqrt(list_reduce(list_prepend(0.0e0, list_transform(coalesce(vw.vec, {_ZEROS64}), "
    f"lambda x: x * x)), lambda a, b: a + b)), 4) AS vnorm "
    f"FROM wi LEFT JOIN vw USING (idx, term)")
SQL["embedding_coverage"] = W(*SEQ) + (
    "SELECT (SELECT count(*) FROM vw) AS n_vectors, count(*) AS vocab_size, "
    "count(vw.idx) AS covered, round(count(vw.idx) / count(*), 4) AS coverage "
    "FROM wi LEFT JOIN vw USING (idx, term)")
_LINES = ("ln AS (SELECT vec_id AS i, 'w' || vec_id // 2 AS word, CAST(embedding AS DOUBLE[]) AS vec, "
          "CASE WHEN vec_id % 13 = 5 THEN 'blank' WHEN vec_id % 23 = 1 THEN 'short' WHEN vec_id % 17 = 7 OR (vec_id % 19 <> 2 "
          "AND vec_id % 11 = 3) THEN 'not_numeric' WHEN vec_id % 19 = 2 THEN 'wrong_width' END AS bad FROM embeddings)")


def _parse_sql(pick: str) -> str:
    # a line for every indexed word with a vector, and one by rule for every embedding after it
    return W(*SEQ, _LINES, (
        "al AS (SELECT term AS word, vec, 2 * idx AS o FROM vw UNION ALL "
        "SELECT word, vec, 2 * i + 1 AS o FROM ln WHERE bad IS NULL)"), (
        f"gd AS (SELECT word, {pick}(vec, o) AS vec FROM al GROUP BY word)")) + (
        "SELECT word, len(vec) AS dim, round(list_reduce(list_prepend(0.0e0, vec), lambda a, b: a + b), 4) AS vsum FROM gd")


SQL["embedding_parse"] = _parse_sql("max_by")
SQL["embedding_parse_w2v"] = _parse_sql("min_by")
SQL["embedding_rejects"] = f"WITH {_LINES} " + " UNION ALL ".join(
    f"SELECT '{fmt}' AS format, CASE WHEN bad = 'short' THEN '{short}' ELSE bad END AS reason, count(*) AS n FROM ln "
    "WHERE bad IS NOT NULL GROUP BY ALL" for fmt, short in (("glove", "wrong_width"), ("w2v", "header")))
SQL["embed_flatten"] = W(*SEQ, (
    "ep AS (SELECT p.paper_id, unnest(p.seq) AS idx, unnest(range(0, len(p.seq))) AS pos "
    "FROM padded p)"), (
    "ev AS (SELECT ep.paper_id, ep.pos, unnest(vw.vec) AS val, unnest(range(0, 64)) AS d "
    "FROM ep JOIN vw USING (idx))")) + (
    "SELECT p.paper_id, 400 * 64 AS n_values, round(coalesce(sum(ev.val), 0), 4) AS fsum, "
    "round(coalesce(sum(ev.val * ((ev.pos * 64 + ev.d) % 5 + 1)), 0), 4) AS wsum "
    "FROM padded p LEFT JOIN ev USING (paper_id) GROUP BY p.paper_id")


def _conv_sql(digits: int | None = 4) -> str:
    slot_k = "CASE WHEN c < 20 THEN 1 WHEN c < 60 THEN 2 ELSE 3 END"
    slot_b = "CASE WHEN c < 20 THEN 0 WHEN c < 60 THEN 20 ELSE 60 END"
    ctes = list(SEQ) + [
        f"sl AS (SELECT c, {slot_k} AS k, (c - {slot_b}) // 20 AS j, (c - {slot_b}) % 20 AS f "
        f"FROM range(0, 120) t(c))",
        "wt AS (SELECT sl.c, t.d, CAST(((7 * sl.f + 5 * sl.j + 3 * t.d + sl.k) % 11) - 5 AS DOUBLE)"
        " / 10.0e0 AS w FROM sl, range(0, 64) t(d))",
        "vl AS (SELECT idx, unnest(vec) AS val, unnest(range(0, 64)) AS d FROM vw)",
        "pl AS (SELECT vl.idx, wt.c, sum(vl.val * wt.w) AS p FROM vl JOIN wt USING (d) "
        "GROUP BY vl.idx, wt.c)",
        "pj AS (SELECT idx, list(p ORDER BY c) AS proj FROM pl GROUP BY idx)",
        "tk AS (SELECT paper_id, unnest(seq) AS idx, unnest(range(0, len(seq))) AS pos FROM kept)",
        "tp AS (SELECT tk.paper_id, tk.pos, coalesce(pj.proj, list_transform(range(0, 120), "
        "lambda i: 0.0e0)) AS proj FROM tk LEFT JOIN pj USING (idx))",
        "tl AS (SELECT paper_id, pos, proj, "
        "lead(proj, 1) OVER w AS l1, lead(proj, 2) OVER w AS l2 FROM tp "
        "WINDOW w AS (PARTITION BY paper_id ORDER BY pos))",
    ]
    aggs, outs = [], []
    rnd, tail = ("round", f", {digits}") if digits is not None else ("", "")
    for k, base in ((1, 0), (2, 20), (3, 60)):
        for f in range(20):
            terms = [f"proj[{base + f + 1}]"]
            if k >= 2:
                terms.append(f"coalesce(l1[{base + 20 + f + 1}], 0.0e0)")
            if k >= 3:
                terms.append(f"coalesce(l2[{base + 40 + f + 1}], 0.0e0)")
            aggs.append(f"max(CASE WHEN pos <= {400 - k} THEN {' + '.join(terms)} END) AS m_{k}_{f}")
            b = ((f + k) % 5 - 2) / 10.0
            outs.append(
                f"SELECT paper_id, {k} AS width, {f} AS filter, {rnd}(greatest("
                f"greatest(m_{k}_{f}, CASE WHEN n <= {400 - k} THEN 0.0e0 END) + ({b!r}), 0.0e0)"
                f"{tail}) AS value FROM mj")
    ctes.append(f"mx AS (SELECT paper_id, {', '.join(aggs)} FROM tl GROUP BY paper_id)")
    ctes.append("mj AS (SELECT k.paper_id, len(k.seq) AS n, mx.* EXCLUDE (paper_id) FROM kept k "
                "LEFT JOIN mx USING (paper_id))")
    return W(*ctes) + " UNION ALL ".join(outs)


SQL["ngram_conv_pool"] = _conv_sql()


def _ncnn_score_sql() -> str:
    pooled = _conv_sql(digits=None)
    head = (
        "pooled AS ({pooled}), "
        "pi AS (SELECT paper_id, (width - 1) * 20 + filter AS i, value FROM pooled), "
        "hu AS (SELECT pi.paper_id, u.u, greatest(sum(pi.value * "
        "(CAST(((3 * pi.i + 7 * u.u) % 13) - 6 AS DOUBLE) / 50.0e0)) + "
        "CAST((u.u % 7) - 3 AS DOUBLE) / 10.0e0, 0.0e0) AS h "
        "FROM pi, range(0, 100) u(u) GROUP BY pi.paper_id, u.u) "
        "SELECT paper_id, round(sum(h * CAST(((5 * u) % 11) - 5 AS DOUBLE) / 20.0e0) + 0.5e0, 4)"
        " AS prediction FROM hu GROUP BY paper_id")
    return "WITH " + head.format(pooled=pooled)


SQL["ncnn_score"] = _ncnn_score_sql()

_HIDDEN = "CAST((u.u % 7) - 3 AS DOUBLE) / 10.0e0"
_OUTPUT = "round(sum(h * CAST(((5 * u) % 11) - 5 AS DOUBLE) / 20.0e0) + 0.5e0, 4) AS prediction"
SQL["mlp_score"] = W(TOK, *terms_ctes(TFIDF), *vocab_ctes(TFIDF), *weight_ctes(TFIDF, where="paper_id IS NOT NULL"),
                     "hs AS (SELECT w.paper_id, u.u, sum(w.value * (CAST(((7 * w.idx + 3 * u.u) % 13) - 6 AS DOUBLE) / 50.0e0)) "
                     "AS s FROM w, range(0, 100) u(u) GROUP BY ALL)",
                     f"hu AS (SELECT t.paper_id, u.u, greatest(coalesce(hs.s, 0.0e0) + {_HIDDEN}, 0.0e0) AS h FROM txt t "
                     "CROSS JOIN range(0, 100) u(u) LEFT JOIN hs ON hs.paper_id = t.paper_id AND hs.u = u.u)") + \
    f"SELECT paper_id, {_OUTPUT} FROM hu GROUP BY paper_id"
SQL["dense_score"] = W(
    *SEQ, "wm AS (SELECT p.pos, u.u, list(CAST((3 * (p.pos * 64 + d.d) + 7 * u.u) % 13 - 6 AS DOUBLE) / 500.0e0 ORDER BY d.d) AS w "
    "FROM range(0, 400) p(pos), range(0, 100) u(u), range(0, 64) d(d) GROUP BY ALL)",
    "tk AS (SELECT paper_id, unnest(seq) AS idx, unnest(range(0, len(seq))) AS pos FROM kept)",
    "tv AS (SELECT idx, pos, count(*) AS n FROM tk JOIN vw USING (idx) GROUP BY idx, pos)",
    "tp AS (SELECT tv.idx, tv.pos, wm.u, list_dot_product(vw.vec, wm.w) AS s FROM tv JOIN vw USING (idx) JOIN wm USING (pos))",
    "ts AS (SELECT idx, pos, list(s ORDER BY u) AS s FROM tp GROUP BY idx, pos)",
    "hs AS (SELECT paper_id, u.u, sum(ts.s[u.u + 1]) AS s FROM tk JOIN ts USING (idx, pos), range(0, 100) u(u) GROUP BY ALL)",
    f"hu AS (SELECT t.paper_id, u.u, greatest(coalesce(hs.s, 0.0e0) + {_HIDDEN}, 0.0e0) AS h FROM txt t "
    "CROSS JOIN range(0, 100) u(u) LEFT JOIN hs ON hs.paper_id = t.paper_id AND hs.u = u.u)") + \
    f"SELECT paper_id, {_OUTPUT} FROM hu GROUP BY paper_id"


def _stumps_ctes(rates: list[float], fitted: str, pre: str = "") -> list[str]:
    """Boosted trees of depth 1 on six numbers, fitted on the rows of ``r0``
    where ``fitted``: the first fits the label, each later one twice what
    is left (the squared loss's gradient)."""
    ctes = []
    for i, rate in enumerate(rates):
        left, rows = "y" if i == 0 else "2 * (y - f)", "r0" if i == 0 else f"{pre}r{i}"
        v, c, b = f"{pre}v{i}", f"{pre}c{i}", f"{pre}b{i}"
        ctes += [
            f"{v} AS (SELECT c, x, count(*) AS n, sum(t) AS s FROM (SELECT unnest(range(6)) AS c, unnest(xs) AS x, "
            f"{left} AS t FROM {rows} WHERE {fitted}) GROUP BY c, x)",
            f"{c} AS (SELECT c, x, (x + lead(x) OVER w) / 2 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, "
            f"sum(n) OVER (PARTITION BY c) AS n, sum(s) OVER (PARTITION BY c) AS s FROM {v} "
            f"WINDOW w AS (PARTITION BY c ORDER BY x))",
            f"{b} AS (SELECT c, cut, sl / nl AS lo, (s - sl) / (n - nl) AS hi FROM {c} WHERE cut IS NOT NULL "
            f"ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, c, cut LIMIT 1)",
            f"{pre}r{i + 1} AS (SELECT {rows}.* REPLACE (f + {rate}e0 * CASE WHEN xs[c + 1] "
            f"<= cut THEN lo ELSE hi END AS f) FROM {rows}, {b})"]
    return ctes


_COUNTS = ", ".join(f"CAST(len({analyzer_sql(c, lowercase=False)[0]}) AS DOUBLE)" for c in ("kw", "title_t", "abstract_t", "venue"))
NUMERIC_ROWS = (f"r0 AS (SELECT paper_id, split, rn, [CAST(year AS DOUBLE), CAST(n_citation AS DOUBLE), {_COUNTS}] AS xs, "
                "label AS y, 0.0e0 AS f FROM tok)")


def _stumps_sql(rates: list[float]) -> str:
    return W(TOK, NUMERIC_ROWS, *_stumps_ctes(rates, "split = 'train'")) + (
        f"SELECT paper_id, round(f, 4) AS prediction FROM r{len(rates)} WHERE split = 'test'")


def _staged_cv_sql(rates: list[float], k: int = 4) -> str:
    ctes = [TOK, NUMERIC_ROWS.replace("r0 AS", "ra AS"), "nt AS (SELECT count(*) AS n FROM ra WHERE split = 'train')",
            f"r0 AS (SELECT ra.*, CASE WHEN rn < (n % {k}) * (n // {k} + 1) THEN rn // (n // {k} + 1) "
            f"ELSE n % {k} + (rn - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS fold FROM ra, nt WHERE split = 'train')"]
    parts = []
    for h in range(k):
        ctes += _stumps_ctes(rates, f"fold <> {h}", f"h{h}_")
        parts += [f"SELECT {i} AS candidate, {h} AS fold, round(1.0e0 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 4) AS r2 "
                  f"FROM h{h}_r{i + 1} WHERE fold = {h}" for i in range(len(rates))]
    return W(*ctes) + " UNION ALL ".join(parts)


SQL["rf_fit"] = _stumps_sql([1.0])
SQL["gbt_fit"] = _stumps_sql([1.0, 0.1])
SQL["gbt_eta_fit"] = _stumps_sql([1.0, 0.3, 0.3])
SQL["gb_staged_cv"] = _staged_cv_sql([1.0, 0.1, 0.1])


# ---------------------------------------------------------------------------
# the search: folds counted once, least squares from normal equations
# ---------------------------------------------------------------------------

def _eliminate(size: str) -> str:
    """One step of Gauss-Jordan elimination of the rows ``m`` (label last) at
    ``k``; a column that depends on those before it gets weight 0."""
    dependent = "m[k][k] <= 1e-9 * d[k]"
    cell = ("CASE WHEN {dep} THEN CASE WHEN i = k OR j = k THEN 0.0e0 ELSE m[i][j] END "
            "WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] / m[k][k] * m[k][j] END").format(dep=dependent)
    return (f"list_transform(range(1, {size} + 1), lambda i: list_transform(range(1, {size} + 2), lambda j: {cell}))")


def least_squares_ctes(rows: str, keys: str) -> list[str]:
    """From ``rows`` (keys, out, z: [1, features..., label]) to ``fit`` (keys,
    icept, w: weights with the intercept first) and ``ls`` (keys, icept, r2)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return [
        f"gp AS (SELECT {keys}, out, i, j, sum(z[i] * z[j]) AS v FROM {rows}, range(1, 200) a(i), range(1, 200) b(j) "
        f"WHERE i <= len(z) AND j <= len(z) GROUP BY {keys}, out, i, j)",
        f"gr AS (SELECT {keys}, out, i, list(v ORDER BY j) AS r FROM gp GROUP BY {keys}, out, i)",
        f"gm AS (SELECT {keys}, out, list(r ORDER BY i) AS g FROM gr GROUP BY {keys}, out)",
        f"s0 AS (SELECT {keys}, icept, list_transform(g[CASE WHEN icept THEN 1 ELSE 2 END:len(g) - 1], "
        f"lambda r: r[CASE WHEN icept THEN 1 ELSE 2 END:len(r)]) AS m FROM gm, (VALUES (true), (false)) t(icept) WHERE out = 0)",
        f"el AS (SELECT {keys}, icept, 0 AS k0, m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM s0 "
        f"UNION ALL SELECT {keys}, icept, k0 + 1, {_eliminate('len(m)').replace('[k]', '[k0 + 1]').replace('= k ', '= k0 + 1 ').replace('i = k OR', 'i = k0 + 1 OR')}, d "
        f"FROM el WHERE k0 < len(m))",
        f"fit AS (SELECT {keys}, icept, list_concat(CASE WHEN icept THEN [] ELSE [0.0e0] END, "
        f"list_transform(m, lambda r: r[len(r)])) AS w FROM el WHERE k0 = len(m))",
        f"ls AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, icept, g[1][1] AS n, "
        "list_sum(list_transform(range(1, len(g) + 1), lambda i: list_sum(list_transform(range(1, len(g) + 1), "
        "lambda j: g[i][j] * list_append(w, -1.0e0)[i] * list_append(w, -1.0e0)[j])))) AS sse, "
        f"g[len(g)][len(g)] - g[1][len(g)] * g[1][len(g)] / g[1][1] AS sst FROM fit a JOIN gm b ON {on} WHERE b.out = 1)"]


def _cv_pipeline_sql(width: int = 8, k: int = 4) -> str:
    from quire.operators.search import VECT_GRID, param_grid
    settings = param_grid(VECT_GRID)
    kinds = list(dict.fromkeys((s["ngram_range"], s["stop_words"] is not None)
                               for s in [{"ngram_range": (1, 1), "stop_words": None}, *settings]))
    weightings = [(False, True), (False, False), (True, True), (True, False)]  # (sub-linear, smooth)
    blocks = [("kw", (1, 1), False), ("title_t", (1, 1), False), ("venue", (1, 1), False)] + \
        [("abstract_t", n, stop) for n, stop in kinds]
    ctes = [TOK.strip(),
            "nt AS (SELECT count(*) AS n FROM tok WHERE split = 'train')",
            f"fo AS (SELECT tok.*, CAST(CASE WHEN rn < (n % {k}) * (n // {k} + 1) THEN rn // (n // {k} + 1) "
            f"ELSE n % {k} + (rn - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS fold FROM tok, nt WHERE split = 'train')"]
    for i, (text, n, stop) in enumerate(blocks):
        base, grams = analyzer_sql(text, n, ENGLISH_STOP_WORDS if stop else None, False)
        ctes += [f"b{i} AS (SELECT paper_id, fold, {base} AS t0 FROM fo)",
                 f"t{i} AS (SELECT paper_id, fold, {i} AS block, unnest({grams}) AS term FROM b{i})"]
    ctes.append("tf AS (SELECT paper_id, fold, block, term, count(*) AS tf FROM (" +
                " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(blocks))) + ") GROUP BY ALL)")
    ctes.append("dq AS (SELECT block, term, count(*) AS df, " +
                ", ".join(f"count(*) FILTER (fold = {f}) AS df{f}" for f in range(k)) + " FROM tf GROUP BY block, term)")
    ctes.append("nf AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (fold = {f}) AS n{f}" for f in range(k)) + " FROM fo)")
    idf = []
    for f in range(k):
        for smooth in (True, False):
            n, df = f"CAST(n - n{f} AS DOUBLE)", f"CAST(df - df{f} AS DOUBLE)"
            value = f"ln(({n} + 1.0e0) / ({df} + 1.0e0))" if smooth else f"ln({n} / {df})"
            idf.append(f"CASE WHEN df > df{f} THEN {value} + 1.0e0 ELSE 0.0e0 END AS i{f}_{int(smooth)}")
    ctes.append(f"kn AS (SELECT block, term, abs(h) % {width} AS bucket, CASE WHEN h >= 0 THEN 1.0e0 ELSE -1.0e0 END AS sign, {', '.join(idf)} "
                "FROM (SELECT *, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM "
                "(SELECT *, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS u FROM dq)), nf)")
    base = [(w, f) for w in weightings for f in range(k)]

    def value(w, f):
        return ("(ln(CAST(tf AS DOUBLE)) + 1.0e0)" if w[0] else "CAST(tf AS DOUBLE)") + f" * i{f}_{int(w[1])}"
    sums = ", ".join(f"sum(sign * {value(w, f)}) AS s{i}, sum({value(w, f)}) AS a{i}, sum({value(w, f)} * {value(w, f)}) AS q{i}"
                     for i, (w, f) in enumerate(base))
    ctes.append(f"su AS (SELECT paper_id, block, bucket, {sums} FROM tf JOIN kn USING (block, term) GROUP BY ALL)")
    n = len(base)

    def lists(name):
        return "[" + ", ".join(f"{name}{i}" for i in range(n)) + "]"
    ctes += [
        f"lg AS (SELECT paper_id, block, bucket, unnest({lists('s')}) AS s, unnest({lists('a')}) AS a, unnest({lists('q')}) AS q, "
        f"unnest(range({n})) AS wh FROM su)",
        "nm AS (SELECT paper_id, block, wh, sum(a) AS l1, sqrt(sum(q)) AS l2 FROM lg GROUP BY ALL)",
        f"xb AS (SELECT paper_id, block, wh, list(coalesce(s, 0.0e0) ORDER BY b) AS x FROM (SELECT p.paper_id, p.block, p.wh, t.b, lg.s "
        f"FROM nm p CROSS JOIN range({width}) t(b) LEFT JOIN lg ON lg.paper_id = p.paper_id AND lg.block = p.block AND lg.wh = p.wh "
        f"AND lg.bucket = t.b) GROUP BY ALL)"]
    values = ", ".join(
        f"({i}, {3 + kinds.index((s['ngram_range'], s['stop_words'] is not None))}, "
        f"{weightings.index((s['sublinear_tf'], s['smooth_idf']))}, {O.q(s['norm'] or 'none')})" for i, s in enumerate(settings))
    zeros = f"list_transform(range({width}), lambda b: 0.0e0)"

    def part(alias, norm="l2"):
        size = f"CASE {norm} WHEN 'l1' THEN {alias}n.l1 WHEN 'l2' THEN {alias}n.l2 ELSE 1.0e0 END" if norm != "l2" else f"{alias}n.l2"
        return (f"coalesce(list_transform({alias}.x, lambda v: CASE WHEN {size} > 0 THEN v / {size} ELSE v END), {zeros})")

    def joins(alias, block, at):
        on = f"paper_id = p.paper_id AND {{0}}.block = {block} AND {{0}}.wh = {at}"
        return f"LEFT JOIN xb {alias} ON {alias}.{on.format(alias)} LEFT JOIN nm {alias}n ON {alias}n.{on.format(alias + 'n')} "
    ctes += [
        f"vs(vi, blk, wt, norm) AS (VALUES {values})",
        f"zr AS (SELECT v.vi, h.h, CAST(p.fold = h.h AS INTEGER) AS out, list_concat([1.0e0], list_concat({part('k')}, list_concat({part('t')}, "
        f"list_concat({part('c', 'v.norm')}, list_concat({part('u')}, [CAST(year AS DOUBLE), CAST(n_citation AS DOUBLE), label]))))) AS z "
        f"FROM fo p CROSS JOIN vs v CROSS JOIN range({k}) h(h) {joins('k', 0, 'h.h')}{joins('t', 1, 'h.h')}"
        f"{joins('u', 2, 'h.h')}{joins('c', 'v.blk', f'v.wt * {k} + h.h')})"]
    ctes += least_squares_ctes("zr", "vi, h")
    body = ("SELECT CAST(vi * 8 + c AS INTEGER) AS candidate, CAST(h AS INTEGER) AS fold, "
            "round(CASE WHEN sst > 0 THEN 1.0e0 - sse / sst ELSE 0.0e0 END, 4) AS r2 "
            "FROM ls JOIN range(8) m(c) ON icept = ((c // 2) % 2 = 0)")
    return W(*ctes).replace("WITH ", "WITH RECURSIVE ", 1) + body


SQL["cv_pipeline"] = _cv_pipeline_sql()


def _pipeline_predict_sql(width: int = 8) -> str:
    ctes, zeros = [TOK], f"list_transform(range({width}), lambda b: 0.0e0)"
    p = VectorizerParams(lowercase=False)
    for i, text in enumerate(("kw", "title_t", "abstract_t", "venue")):
        pre = f"c{i}_"
        ctes += terms_ctes(p, src="tok", text=text, prefix=pre) + vocab_ctes(p, src="tok", prefix=pre) + weight_ctes(p, prefix=pre)
        ctes += [f"{pre}h AS (SELECT paper_id, value, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM "
                 f"(SELECT *, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS u FROM {pre}w))",
                 f"{pre}s AS (SELECT paper_id, abs(h) % {width} AS b, sum(CASE WHEN h >= 0 THEN value ELSE -value END) AS v FROM {pre}h GROUP BY ALL)",
                 f"{pre}x AS (SELECT p.paper_id, list(coalesce(v, 0.0e0) ORDER BY t.b) AS x FROM (SELECT DISTINCT paper_id FROM {pre}s) p "
                 f"CROSS JOIN range({width}) t(b) LEFT JOIN {pre}s s ON s.paper_id = p.paper_id AND s.b = t.b GROUP BY p.paper_id)"]
    parts = [f"coalesce(c{i}_x.x, {zeros})" for i in range(4)] + ["[CAST(year AS DOUBLE), CAST(n_citation AS DOUBLE), label]"]
    z = "[1.0e0]"
    for part in parts:
        z = f"list_concat({z}, {part})"
    joins = " ".join(f"LEFT JOIN c{i}_x ON c{i}_x.paper_id = tok.paper_id" for i in range(4))
    ctes.append(f"zr AS (SELECT 0 AS g0, tok.paper_id, CAST(split = 'test' AS INTEGER) AS out, {z} AS z FROM tok {joins})")
    ctes += least_squares_ctes("zr", "g0")
    return W(*ctes).replace("WITH ", "WITH RECURSIVE ", 1) + (
        "SELECT paper_id, round(list_dot_product(w, z[1:len(z) - 1]), 4) AS prediction FROM zr, fit WHERE out = 1 AND icept")


SQL["pipeline_predict"] = _pipeline_predict_sql()


# ---------------------------------------------------------------------------
# typed values and rejected records
# ---------------------------------------------------------------------------

SQL["typed_casts"] = (
    "WITH v AS (SELECT doc_id AS paper_id, CASE doc_id % 10 WHEN 0 THEN n_chars WHEN 1 THEN n_chars WHEN 2 THEN n_chars "
    "WHEN 4 THEN -n_chars WHEN 6 THEN 1 WHEN 7 THEN n_chars * 10 + 5 WHEN 8 THEN -n_chars WHEN 9 THEN n_chars * 100 END AS value FROM documents) "
    "SELECT paper_id, value, value IS NULL AS wrong FROM v")
SQL["paper_rejects"] = (
    "WITH v AS (SELECT CASE doc_id % 7 WHEN 1 THEN 'broken line' WHEN 2 THEN 'no plength' WHEN 3 THEN 'no title' "
    "WHEN 4 THEN 'no year' ELSE 'good' END AS reason, CASE WHEN doc_id % 7 = 1 THEN 2 + length(CAST(doc_id AS VARCHAR)) + 9 END AS size FROM documents) "
    "SELECT reason, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS raw_chars FROM v GROUP BY reason")
