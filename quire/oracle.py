"""DuckDB-dialect SQL for the correctness oracle.

The same rules as the Spark expressions, written as plain SQL over the
driver's tables, so the driver can run both engines side by side. Dialect
notes: DuckDB's regexp_replace needs the 'g' flag and writes groups as \\1;
lists are 1-based; integer division is //.
"""

from __future__ import annotations

from quire.functions.text import NON_ASCII, PERIOD_TOKEN, TOKEN_RULES, WS, WORD


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _repl(template: str) -> str:
    out = template
    for g in range(9, -1, -1):
        out = out.replace("{%d}" % g, "\\%d" % g)
    return out


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def lower_ascii(expr: str) -> str:
    return rx(f"lower({expr})", NON_ASCII, "")


def strip_ws(expr: str) -> str:
    return rx(expr, r"\A[" + WS + r"]+|[" + WS + r"]+\z", "")


def keyword_summary(expr: str) -> str:
    kept = f"list_filter({expr}, lambda x: length(x) >= 1)"
    stripped = f"list_transform({kept}, lambda x: {strip_ws('x')})"
    return f"array_to_string(list_sort(list_distinct({stripped})), ' , ')"


def keyword_string(expr: str) -> str:
    return lower_ascii(keyword_summary(expr))


def symbol_split(expr: str) -> str:
    return rx(expr, r"[|^/+=~*_]", " \\0 ")


def treebank_text(expr: str) -> str:
    e = expr
    for pattern, repl in TOKEN_RULES:
        if pattern == "PAD":
            e = f"(' ' || {e} || ' ')"
        elif pattern == "TWICE":
            p, r = repl
            e = rx(rx(e, p, _repl(r)), p, _repl(r))
        else:
            e = rx(e, pattern, _repl(repl))
    return e


def treebank_tokens(expr: str) -> str:
    parts = f"string_split_regex({treebank_text(expr)}, {q('[' + WS + ']+')})"
    return f"list_filter({parts}, lambda t: length(t) > 0)"


def split_periods(tokens: str) -> str:
    return (f"list_transform({tokens}, lambda t: CASE WHEN regexp_matches(t, {q(PERIOD_TOKEN)}) "
            f"THEN replace(t, '.', ' . ') ELSE t END)")


def join_collapse(tokens: str) -> str:
    return rx(f"array_to_string({tokens}, ' ')", "[" + WS + "]{2,}", " ")


def core_tokenize(expr: str) -> str:
    return lower_ascii(join_collapse(split_periods(treebank_tokens(expr))))


def analyze_terms(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q('[' + WORD + ']{2,}')})"


PAPERS_CTE = """
papers_raw AS (
  SELECT d.doc_id AS paper_id,
         split_part(d.text, chr(10), 1) AS title,
         d.text AS abstract,
         string_split(split_part(d.text, chr(10), 1), ' ') AS keywords,
         d.source AS venue,
         CAST(1990 + d.doc_id % 30 AS INTEGER) AS year,
         CAST(coalesce(l.quality, 0) * 50 + d.doc_id % 37 AS INTEGER) AS n_citation,
         CAST(1 + d.n_chars // 500 AS INTEGER) AS plength,
         row_number() OVER (ORDER BY d.doc_id) - 1 AS rn
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
papers AS (
  SELECT *, CASE WHEN rn < (SELECT floor(count(*) * 0.8) FROM documents)
                 THEN 'train' ELSE 'test' END AS split,
         CAST(plength AS DOUBLE) AS label
  FROM papers_raw)"""


def with_papers(*ctes: str) -> str:
    """WITH clause: the papers view followed by more named CTEs."""
    parts = [PAPERS_CTE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


# Tokenised records (T9) and the one-text column.
TOKENIZED_CTE = f"""
tok AS (
  SELECT paper_id, rn, split, label, venue, year, n_citation,
         {keyword_string('keywords')} AS kw,
         {core_tokenize('title')} AS title_t,
         {core_tokenize('abstract')} AS abstract_t
  FROM papers),
txt AS (
  SELECT paper_id, rn, split, label, kw || ' ' || title_t || ' ' || abstract_t AS text
  FROM tok)"""
