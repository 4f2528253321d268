"""Scalar text functions as Spark ``Column`` expressions.

Every function here is a pure, JVM-side expression (regexp_replace, split,
higher-order array functions): no Python runs per row, the expressions stay
inside whole-stage code generation where Spark supports it, and they work
unchanged on streaming DataFrames.

The tokenizer is a Penn-Treebank-style rule chain written without
look-around, so the same ordered rules run on Java regex (Spark) and RE2
(the DuckDB oracle) with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (they must equal the behaviour the workload was written for).
# ---------------------------------------------------------------------------

# White space as Python's str.isspace() / str.split() / re "\s" see it:
# tab, LF, VT, FF, CR, U+001C..U+001F, blank, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# Characters that get blanks put round them before word splitting.
SYMBOLS = "|_^/+=~*"

# Word characters as Python's Unicode "\w" sees them.
WORD = r"\p{L}\p{N}_"

# Ordered rewrite rules of the word tokenizer (T4). Each rule is
# (pattern, replacement); in replacements {n} is capture group n and {0} the
# whole match. The rule "PAD" puts one blank at both ends of the text.
# "TWICE" marks rules whose explicit word boundaries consume a character, so
# they run a second time to reach adjacent occurrences.
TOKEN_RULES = [
    (r"[|^/+=~*_]", " {0} "),                                   # T3 symbols
    (r'\A"', "`` "),                                            # opening quote at start
    (r'([ (\[{<])"', "{1} `` "),                                # opening quote after blank/bracket
    (r"[.]{2,}", " {0} "),                                      # ellipsis
    (r"([:,])([^0-9])", " {1} {2}"),                            # comma, colon not in numbers
    (r"([:,])\z", " {1} "),
    (r"[;@#$%&]", " {0} "),
    (r"([^.])([.])([\])}>" + '"' + r"' ]*)[" + WS + r"]*\z", "{1} {2} {3} "),  # final period
    (r"[?!]", " {0} "),
    (r"([^'])' ", "{1} ' "),
    (r"[\]\[(){}<>]", " {0} "),                                  # brackets
    (r"--", " -- "),
    ("PAD", None),
    (r'"', " '' "),                                             # closing quote
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "{1} {2} "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "{1} {2} "),
    ("TWICE", (r"(?i)(\A|[^" + WORD + r"])(can)(not)([^" + WORD + r"]|\z)", "{1} {2} {3} {4}")),
    ("TWICE", (r"(?i)(\A|[^" + WORD + r"])(gon|wan)(na)([^" + WORD + r"]|\z)", "{1} {2} {3} {4}")),
    ("TWICE", (r"(?i)(\A|[^" + WORD + r"])(got)(ta)([^" + WORD + r"]|\z)", "{1} {2} {3} {4}")),
    ("TWICE", (r"(?i)(\A|[^" + WORD + r"])(gim|lem)(me)([^" + WORD + r"]|\z)", "{1} {2} {3} {4}")),
    ("TWICE", (r"(?i) ('t)(is|was)([^" + WORD + r"]|\z)", " {1} {2} {3}")),
]

# What the rules of the list come to in one engine with look-around: a match
# starts at a rare letter instead of at every character, rules of single
# characters that do not see each other share a pass, plain texts are replaced
# without a regex, adjacent occurrences need no second run, and the contractions
# of two words share one. Texts are the same but for blanks next to blanks, which
# the token split drops.
_LOOK_AROUND = {
    r'([ (\[{<])"': (r'"(?<=[ (\[{<]")', " `` "),
    r"[;@#$%&]": (r"[;@#$%&?!]", " {0} "),
    r"[?!]": None,
    r"([^'])' ": (r"'(?<=[^']') ", " ' "),
    r"--": ("PLAIN", ("--", " -- ")),
    r'"': ("PLAIN", ('"', " '' ")),
    r"([^' ])('[sS]|'[mM]|'[dD]|') ": (r"'(?<=[^' ]')([sSmMdD]?) ", " '{1} "),
    r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ": (
        r"(?=['nN])('(?:ll|LL|re|RE|ve|VE)|n't|N'T)(?<=[^' ](?:'(?:ll|LL|re|RE|ve|VE)|n't|N'T)) ", " {1} "),
}
_TWO_WORDS = (r"(?i)(?=[cgwl])(?<![" + WORD + r"])(can(?=not)|gon(?=na)|wan(?=na)|got(?=ta)|gim(?=me)|lem(?=me))"
              r"(not|na|ta|me)(?![" + WORD + r"])", " {1} {2} ")
FAST_RULES = [rule for p, r in TOKEN_RULES if p != "TWICE" for rule in [_LOOK_AROUND.get(p, (p, r))] if rule] + [_TWO_WORDS, TOKEN_RULES[-1]]

# White space other than the blank, by one range test for most letters.
_NO_BLANK = r"[\x00-\x1F\x{80}-\x{FFFF}&&[" + WS.replace(r"\x1C-\x1F ", r"\x1C-\x1F") + "]]"

# A token whose inner periods are split (T5): two or more non-period
# characters then a period at the token start, or a period then two or more.
PERIOD_TOKEN = r"^([^." + WS + r"]{2,}[.]|[.][^." + WS + r"]{2,})"

NON_ASCII = r"[^\x00-\x7F]"

# T5 on blank-joined tokens, as one Java regex: at the start of a token that
# qualifies (look-ahead), or chained with \G right after the previous split
# period of the same token, match up to the next period and put blanks round
# it. Tokens never contain white space here, so [^. ] stays inside a token.
PERIOD_IN_TOKEN = (r"(?:(?<![^ ])(?=[^. ]{2,}[.]|[.][^. ]{2,})|\G(?<=[^ ]))"
                   r"([^. ]*)[.]")


def _java_replacement(template: str) -> str:
    out = template
    for g in range(9, -1, -1):
        out = out.replace("{%d}" % g, "$%d" % g)
    return out


def _apply_rules(col: Column, rules) -> Column:
    for pattern, repl in rules:
        if pattern == "PAD":
            col = F.concat(F.lit(" "), col, F.lit(" "))
        elif pattern == "PLAIN":
            col = F.replace(col, F.lit(repl[0]), F.lit(repl[1]))
        elif pattern == "TWICE":
            p, r = repl
            col = F.regexp_replace(F.regexp_replace(col, p, _java_replacement(r)), p,
                                   _java_replacement(r))
        else:
            col = F.regexp_replace(col, pattern, _java_replacement(repl))
    return col


# ---------------------------------------------------------------------------
# Keyword handling
# ---------------------------------------------------------------------------

def lower_ascii(col) -> Column:
    """Lower-case, then drop every non-ASCII character."""
    return F.regexp_replace(F.lower(_c(col)), NON_ASCII, "")


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.regexp_replace(_c(col), r"\A[" + WS + r"]+|[" + WS + r"]+\z", "")


def keyword_summary(col) -> Column:
    """Drop empty keywords, strip, de-duplicate, join with " , ".

    The empty filter runs before the strip, so a blank-only keyword survives
    as "". Distinct keywords are sorted (binary order) so the result is
    deterministic.
    """
    kept = F.filter(_c(col), lambda x: F.length(x) >= 1)
    stripped = F.transform(kept, strip_ws)
    return F.array_join(F.array_sort(F.array_distinct(stripped)), " , ")


def keyword_string(col) -> Column:
    """T2 then T1, as applied to the keywords field."""
    return lower_ascii(keyword_summary(col))


# ---------------------------------------------------------------------------
# The core tokenizer
# ---------------------------------------------------------------------------

def symbol_split(col) -> Column:
    """Put blanks round each of | _ ^ / + = ~ *."""
    return F.regexp_replace(_c(col), r"[|^/+=~*_]", " $0 ")


def treebank_text(col) -> Column:
    """T3+T4 rewrite chain, before splitting into tokens."""
    return _apply_rules(_c(col), FAST_RULES)


def treebank_tokens(col) -> Column:
    """T3+T4: the token array (split on white space, empty tokens dropped)."""
    parts = F.split(treebank_text(col), "[" + WS + "]+", -1)
    return F.filter(parts, lambda t: F.length(t) > 0)


def split_periods(tokens: Column) -> Column:
    """T5: inside a matching token replace every period by " . "."""
    return F.transform(
        tokens,
        lambda t: F.when(t.rlike(PERIOD_TOKEN), F.replace(t, F.lit("."), F.lit(" . ")))
        .otherwise(t))


def join_collapse(tokens: Column) -> Column:
    """Join by one blank and collapse runs of two or more white spaces."""
    return F.regexp_replace(F.array_join(tokens, " "), "[" + WS + "]{2,}", " ")


def core_tokenize(col) -> Column:
    """T8 = T3 -> T4 -> T5 -> T6 -> T7 as one expression (no UDF, no lambda).

    Same result as ``join_collapse(split_periods(treebank_tokens(col)))``
    followed by T7, but the token array is never built: tokens are kept as a
    text with blanks between them, T5 is the single regex ``PERIOD_IN_TOKEN``,
    and runs of blanks are collapsed once, at the end.
    """
    joined = F.trim(F.regexp_replace(treebank_text(col), _NO_BLANK, " "))
    split = F.regexp_replace(joined, PERIOD_IN_TOKEN, "$1 . ")
    return lower_ascii(F.regexp_replace(split, " {2,}", " "))


def concat_text(keywords, title, abstract) -> Column:
    """Keywords + " " + title + " " + abstract (null stays null)."""
    return F.concat(_c(keywords), F.lit(" "), _c(title), F.lit(" "), _c(abstract))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
