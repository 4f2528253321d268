"""Term analyzers as array expressions (F1-F3, F15 word split).

All of these map a string column to an array of terms inside the JVM;
exploding that array is left to the operators that need long form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import WORD

# Fixed values -------------------------------------------------------------

# Term pattern: runs of two or more word characters (Unicode-aware).
TOKEN_PATTERN = "[" + WORD + "]{2,}"

# English stop-word list of the workload (the common English list shipped
# with the NLTK corpus, in its natural order).
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()

# Characters a sequence tokenizer turns into blanks before splitting on the
# blank: !"#$%&()*+,-./:;<=>?@[\]^_`{|}~ plus tab and newline.
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def analyze(col, lowercase: bool = True) -> Column:
    """terms of two or more word characters."""
    c = F.col(col) if isinstance(col, str) else col
    if lowercase:
        c = F.lower(c)
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def remove_stop_words(terms: Column, stop_words) -> Column:
    """drop every occurrence of a stop word (repeats of other terms stay)."""
    if not stop_words:
        return terms
    # a set of literals, looked up by hash; an array would be searched word by word
    return F.filter(terms, lambda x: ~x.isin(list(stop_words)))


def word_ngrams(terms: Column, lo: int = 1, hi: int = 1) -> Column:
    """all word n-grams for n in [lo, hi], joined by one blank.

    Order: all 1-grams, then all 2-grams, ... (each in text order). Built from
    shifted slices zipped element-wise, so no lambda captures the whole array
    (a captured array expression would be re-evaluated per element).
    """
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(terms)
            continue
        m = F.greatest(F.size(terms) - F.lit(n - 1), F.lit(0))
        gram = F.slice(terms, 1, m)
        for j in range(1, n):
            gram = F.zip_with(gram, F.slice(terms, j + 1, m),
                              lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(gram)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def analyzer(col, ngram_range=(1, 1), stop_words=None, lowercase: bool = True) -> Column:
    """F1 -> F3 -> F2: the full term array of a text column."""
    terms = remove_stop_words(analyze(col, lowercase), stop_words)
    return word_ngrams(terms, ngram_range[0], ngram_range[1])


def sequence_words(col) -> Column:
    """F15 split: lower-case, filter characters become blanks, split on blank."""
    c = F.col(col) if isinstance(col, str) else col
    cls = "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in SEQUENCE_FILTERS) + "]"
    spaced = F.regexp_replace(F.lower(c), cls, " ")
    return F.filter(F.split(spaced, " ", -1), lambda t: F.length(t) > 0)
