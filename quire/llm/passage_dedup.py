"""Operator 9: substring dedup by paragraph MinHash banding.

A text's paragraphs are its lines of ``LEAST_WORDS`` words or more, its runs of
several lines between blank ones, and besides n-grams
of ``GRAM`` words wherever they start: of every ``GRAM`` consecutive ones that
with the smallest hash is picked, so a passage of ``2 * GRAM - 1`` words that is
copied into the middle of another line has a picked n-gram in both texts.
Paragraphs with equal shingle sets, and equal n-grams, form a class. Classes of lines and runs are banded by MinHash (bands tuned to a
probability of 0.99 or more at the threshold), colliding ones are joined (with
hubs of their bucket, then those still apart with each other), held against
their sizes and cells, verified by exact Jaccard over their whole shingle sets, and connected. A component that occurs in several documents stays in the one with
the smallest id; elsewhere its occurrences are removals, merged into spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm import shingles as S
from quire.llm.common import id_text, released
from quire.llm.components import components
from quire.session import ship_package, stored
from quire.sources.papers import load_table

#: Words that a line or paragraph needs for MinHash, and a merged span to be reported.
LEAST_WORDS = 25
#: Words of a picked n-gram, and n-grams of which the smallest is picked. Any
#: run of ``2 * GRAM - 1`` words (49) that two texts share has such a window
#: within it, so both texts pick the same n-gram of it.
GRAM = 25
ROWS_PER_BAND, RECALL = 3, 0.99
#: Turns in which members of a bucket meet a hub before those still apart meet each other.
HUB_TURNS = 3
#: Cells of a shingle set's outline.
CELLS = 1024
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, recall: float = RECALL) -> int:
    """Bands of ``rows`` hashes that two sets at the threshold share one of
    with a probability of at least ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def _running(a: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        a, have = f(a[:-have], a[have:]), have * 2
    return f(a[:len(a) - (width - have)], a[width - have:]) if have < width else a


def picks(s: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest of every ``width`` consecutive hashes of a
    row (of all, where it has fewer). Equal texts of ``width`` hashes or more
    have a hash picked in common. Where the smallest recurs within ``width``,
    as in runs of one repeated word, so few are left that neighbours stay
    within ``width``."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    picked = np.zeros(n, dtype=bool)
    if n >= width:
        least = _running(s, width, np.minimum)
        least = np.where(own[:n - width + 1] == own[width - 1:], least, np.uint64(0))
        none = np.zeros(width - 1, np.uint64)
        picked = _running(np.concatenate((none, least, none)), width, np.maximum) == s
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    count = np.diff(np.append(begin, n))
    picked |= np.repeat(count < width, count) & (s == np.repeat(np.minimum.reduceat(s, begin), count))
    at = np.flatnonzero(picked)
    tied = np.zeros(len(at), dtype=bool)
    tied[1:] = (s[at[1:]] == s[at[:-1]]) & (own[at[1:]] == own[at[:-1]]) & (at[1:] - at[:-1] < width)
    chain = np.maximum.accumulate(np.where(tied, 0, np.arange(len(at))))
    part = (at - at[chain]) // max(1, width - 1)
    inner = np.zeros(len(at), dtype=bool)  # neither first nor last of its part
    inner[1:-1] = tied[1:-1] & tied[2:] & (part[1:-1] == part[:-2]) & (part[1:-1] == part[2:])
    return at[~inner]


def _once(s: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, in their order: one sort of plain numbers
    finds the few that come again."""
    x = S.mix(s ^ S.mix(own.astype(np.uint64)))
    y = np.sort(x)
    twice = np.unique(y[1:][y[1:] == y[:-1]])
    if not len(twice):
        return s, own
    low, near = np.uint64(0xFFFF), np.zeros(1 << 16, dtype=bool)
    near[twice & low] = True
    again = np.flatnonzero(near[x & low])
    again = again[twice[np.minimum(np.searchsorted(twice, x[again]), len(twice) - 1)] == x[again]]
    again = again[np.argsort(x[again], kind="stable")]
    keep = np.ones(len(s), dtype=bool)
    keep[again[1:][x[again[1:]] == x[again[:-1]]]] = False
    return s[keep], own[keep]


def _minhash(s: np.ndarray, begin: np.ndarray, hashes: int) -> np.ndarray:
    return np.stack([np.minimum.reduceat(S.mix(s * _SEEDS[i]), begin) for i in range(hashes)], axis=1)


def _units(data, bounds, bands: int, least_words: int, k: int = 5):
    """Units of a slice: (row, kind, start, end, words, key, shingles, band hashes, first word)."""
    h, row, starts, ends = S.words(data, bounds)
    if not len(h):
        return None
    place = np.arange(len(h)) - np.searchsorted(row, row)
    gram = min(least_words, GRAM)
    s, own, at = S.shingle_hashes(h, row, len(bounds) - 1, gram)
    whole = (np.bincount(row, minlength=len(bounds) - 1) >= gram)[own]
    s, own, at = s[whole], own[whole], at[whole]
    p = picks(s, own, gram)
    f = at[p]
    out = [(row[f], np.zeros(len(f), np.int64), starts[f], ends[f + gram - 1], np.full(len(f), gram), s[p].view(np.int64),
            np.zeros(len(f), np.int64), None, place[f])]
    lines = np.cumsum(data == 10)[starts]
    other = row[1:] != row[:-1]
    newline, blank = (np.concatenate(([True], other | (np.diff(lines) >= n))) for n in (1, 2))
    in_line, in_paragraph = np.cumsum(newline) - 1, np.cumsum(blank) - 1
    # a paragraph of one line is that line
    wrapped = np.bincount(in_paragraph, newline) > 1
    for unit, worth in ((in_line, True), (in_paragraph, wrapped)):
        count = np.bincount(unit)
        keep = (count >= least_words) & worth
        if not keep.any():
            continue
        f, c = (np.cumsum(count) - count)[keep], count[keep]
        use = keep[unit]
        s, own, _ = S.shingle_hashes(h[use], (np.cumsum(keep) - 1)[unit[use]], len(f), k)
        s, own = _once(s, own)
        size, keys = S.set_keys(s, own, len(f))
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        m = _minhash(s, begin, bands * ROWS_PER_BAND)
        hashed = np.stack([S.mix(sum(m[:, b * ROWS_PER_BAND + i] * _SEEDS[200 + i] for i in range(ROWS_PER_BAND))
                                 + np.uint64(b)) for b in range(bands)], axis=1).view(np.int64)
        out.append((row[f], np.ones(len(f), np.int64), starts[f], ends[f + c - 1], c, keys[:, 0], size, hashed, place[f]))
    return out


def _placed(batches, bands: int, least_words: int = LEAST_WORDS):
    """Units of every text, each with its first word's number in the text."""
    for batch in batches:
        data, bounds = S.buffer_of(batch.column(1))
        for lo, hi in S.slices(bounds):
            found = _units(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], bands, least_words)
            for row, kind, start, end, words, key, size, hashed, place in found or []:
                at = bounds[lo:hi] - bounds[lo]
                lists = pa.nulls(len(row), pa.list_(pa.int64())) if hashed is None else \
                    pa.FixedSizeListArray.from_arrays(pa.array(hashed.ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + lo)), pa.array(kind, pa.int32()),
                     pa.array(start - at[row], pa.int32()), pa.array(end - at[row], pa.int32()),
                     pa.array(words, pa.int32()), pa.array(key), pa.array(size, pa.int32()), lists, pa.array(place, pa.int32())],
                    ["_id", "kind", "start", "end", "words", "cls", "n", "bands", "word"])


def _paragraphs(batches, bands: int):
    """The same without the word's number."""
    for batch in _placed(batches, bands):
        yield batch.select(batch.schema.names[:-1])


def _sets(batches, bits: bool):
    """Shingle sets of paragraphs given as byte spans of their texts; with
    ``bits`` only which of ``CELLS`` cells their shingles fall into."""
    for batch in batches:
        texts, spans, classes = [], batch.column("spans").to_pylist(), []
        for text, own in zip(batch.column("_text").to_pylist(), spans):
            raw = text.encode()
            for x in own:
                texts.append(raw[x["start"]:x["end"]].decode("utf-8", "replace"))
                classes.append(x["cls"])
        data, bounds = S.buffer_of(pa.array(texts, pa.string()))
        for lo, hi in S.slices(bounds):
            h, row, _, _ = S.words(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
            s, own, _ = S.shingle_hashes(h, row, hi - lo)
            s, own = _once(s, own)
            size, keys = S.set_keys(s, own, hi - lo)
            if bits:
                held = np.zeros((hi - lo, CELLS), dtype=bool)
                held[own, (s % np.uint64(CELLS)).astype(np.int64)] = True
                flat = np.packbits(held, axis=1).view(np.int64).ravel()
                lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), CELLS // 64).cast(pa.list_(pa.int64()))
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()),
                                                 pa.array(s.view(np.int64)))
            rows = pa.RecordBatch.from_arrays([pa.array(classes[lo:hi], pa.int64()), lists], ["cls", "grams"])
            # of rows that repeat an id only the one with the paragraph counts
            yield rows.filter(pa.array(keys[:, 0] == np.array(classes[lo:hi], dtype=np.int64)))


def _sets_of(classes: DataFrame, long: DataFrame, docs: DataFrame, bits: bool, name: str) -> DataFrame:
    """(cls, grams) of ``classes``, each read from the text of one of its
    paragraphs; repeated where rows repeat that text and its id."""
    at = (long.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("_id", "start", "end")).alias("at")))
    spans = stored(at.groupBy(F.col("at._id").alias("_doc"))
                   .agg(F.collect_list(F.struct("at.start", "at.end", "cls")).alias("spans")), name + "-spans")
    return stored(docs.join(spans, F.col("_id") == F.col("_doc")).select("_text", "spans")
                  .mapInArrow(lambda it: released(_sets(it, bits)), "cls long, grams array<long>"), name)


def _alike(na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _most_shared(na: Column, ca: Column, nb: Column, cb: Column) -> Column:
    """No fewer shingles than two sets share: each cell that only one of them
    holds has a shingle of its own."""
    def own(x, y):
        return sum(F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(CELLS // 64))
    return F.least(na - own(ca, cb), nb - own(cb, ca))


def _reaches(o: Column, na: Column, nb: Column, percent: int) -> Column:
    return o * (100 + percent) >= (na + nb) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose whole shingle sets reach the threshold."""
    b = sets.join(pairs.select(F.col("b").alias("cls")).distinct(), "cls", "left_semi").toDF("b", "gb")
    met = sets.toDF("a", "ga").join(pairs, "a").join(b, "b")
    met = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    return met.where(_reaches(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def _open_members(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members of buckets that hold several components, each with its component
    and the bucket's main one."""
    if links is None:
        state = members.withColumn("comp", F.col("cls"))
    else:
        comp = components(links).withColumnRenamed("node", "cls")
        state = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    per = state.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("met").alias("met"))
    main = (per.groupBy("h").agg(F.max(F.struct("c", "met", "comp")).alias("m"), F.count(F.lit(1)).alias("k"))
            .where("k > 1").select("h", F.col("m.comp").alias("main")))
    return stored(state.join(main, "h"), "passage-open")


def _hub_pairs(state: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member with its bucket's hub, one of the main component: first the
    member that collides most, which is what edited copies were made of, later
    another one each turn."""
    order = F.col("met") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    hubs = (state.where("comp = main").groupBy("h").agg(F.max(F.struct(order.alias("o"), "cls", "n", "comp")).alias("x"))
            .select("h", F.col("x.cls").alias("b"), F.col("x.n").alias("nb"), F.col("x.comp").alias("hub_comp")))
    return (state.join(hubs, "h").where("comp <> hub_comp").where(_alike(F.col("n"), F.col("nb"), percent))
            .select(F.col("cls").alias("a"), "b", F.col("n").alias("na"), "nb").distinct())


def _cross_pairs(state: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members in different components that their sizes and
    cells leave possible."""
    rows = state.join(bits.dropDuplicates(["cls"]), "cls")
    x, y = rows.where("comp <> main").alias("x"), rows.alias("y")
    na, nb = F.col("x.n"), F.col("y.n")
    return (x.join(y, F.col("x.h") == F.col("y.h")).where(F.col("x.comp") != F.col("y.comp"))
            .where((F.col("y.comp") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls")))
            .where(_alike(na, nb, percent))
            .where(_reaches(_most_shared(na, F.col("x.grams"), nb, F.col("y.grams")), na, nb, percent))
            .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), na.alias("na"), nb.alias("nb")).distinct())


def _near(units: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Verified links that connect every two classes of long paragraphs that
    links between members of a bucket connect: over the buckets' hubs, a few
    turns, then between what is still apart. Sizes and cells tell, without an
    error, most pairs below the threshold before any set is moved."""
    long = units.where("kind = 1")
    buckets = long.select("cls", "n", F.explode("bands").alias("h"))
    shared = stored(buckets.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
                    .where("lo <> hi").select("h"), "passage-buckets")
    members = stored(buckets.join(shared, "h").distinct(), "passage-colliding")
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    met = members.join(sizes, "h").groupBy("cls").agg(F.sum("size").alias("met"))
    members = stored(members.join(met, "cls"), "passage-members")
    bits = _sets_of(met.select("cls"), long, docs, True, "passage-bits")
    a, b = bits.toDF("a", "ca"), bits.toDF("b", "cb")
    links, tried = None, None
    for turn in range(HUB_TURNS + 1):
        state = _open_members(members, links)
        if state.isEmpty():
            break
        if turn < HUB_TURNS:
            pairs = _hub_pairs(state, turn, percent)
            o = _most_shared(F.col("na"), F.col("ca"), F.col("nb"), F.col("cb"))
            pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", o.alias("o"))
            # one hub a member and turn: the one that it may share most with
            pairs = (pairs.where(_reaches(F.col("o"), F.col("na"), F.col("nb"), percent)).groupBy("a", "na")
                     .agg(F.max(F.struct((F.col("o") / F.col("nb")).alias("part"), "b", "nb")).alias("x"))
                     .select("a", F.col("x.b").alias("b"), "na", F.col("x.nb").alias("nb")))
        else:
            pairs = _cross_pairs(state, bits, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "passage-pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = _sets_of(wanted, long, docs, False, "passage-sets")
        found = _verified(pairs, sets, percent)
        links = stored(found if links is None else links.unionByName(found), "passage-links")
        members = state.select("h", "cls", "n", "met")
    if links is None:
        links = units.sparkSession.createDataFrame([], "a long, b long")
    return links


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                  least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per repeated passage of a document: ``id_col``, ``start`` and
    ``end`` (byte offsets in UTF-8, end exclusive), ``n_words``, ``keep_id``
    (smallest document that holds it), ``removed`` (whether this is not it),
    ``n_docs`` (most documents that share a paragraph of it).

    Every run of ``2 * GRAM - 1`` words or more that documents share is
    reported with ``least_words`` of its words at least; a span made of picked
    n-grams alone can end up to ``GRAM - 1`` words inside the run on each side.
    Passages that repeat only inside one document are none. Null, empty and
    blank texts have no passages. Ids are integers; rows with a null id are
    left out, rows that repeat an id count as one document. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    bands = bands_for(percent / 100)
    docs = id_text(df, id_col, text_col).withColumn("_id", F.col("_id").cast("long")).where("_id is not null")
    units = stored(docs.mapInArrow(
        lambda it: released(_placed(it, bands, least_words)),
        "_id long, kind int, start int, end int, words int, cls long, n int, bands array<long>, word int"), "passage-units")
    linked = components(_near(units, docs, percent)).withColumnRenamed("node", "cls")
    linked = stored(linked, "passage-linked")
    # Classes by document span: smallest and largest id, summed map-side.
    exact = units.groupBy("cls").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
    near = exact.join(linked, "cls").groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = linked.join(near, "component").select("cls", "component", "lo", "hi")
    alone = exact.join(linked, "cls", "left_anti").select("cls", F.col("cls").alias("component"), "lo", "hi")
    across = stored(alone.unionByName(near).where("lo < hi").select("cls", "component", "lo"), "passage-classes")
    held = units.select("cls", "_id").join(across, "cls").select("component", "_id").distinct()
    counts = held.groupBy("component").agg(F.count(F.lit(1)).alias("docs"))
    across = stored(across.join(counts, "component").select("cls", "lo", "docs"), "passage-counted")
    hits = units.select("_id", "start", "end", "word", (F.col("word") + F.col("words")).alias("last"), "cls").join(across, "cls")
    # Overlapping or adjacent hits of a document, on the same side, make one span.
    hits = hits.withColumn("removed", F.col("_id") != F.col("lo"))
    order = Window.partitionBy("_id", "removed").orderBy("word", "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("reach", F.max("last").over(before))
    hits = hits.withColumn("new", (F.col("reach").isNull() | (F.col("word") > F.col("reach"))).cast("int"))
    hits = hits.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = hits.groupBy("_id", "removed", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("word")).alias("n_words"),
        F.min("lo").alias("keep_id"), F.max("docs").alias("n_docs"))
    return (merged.where(F.col("n_words") >= least_words)
            .select(F.col("_id").alias(id_col), "start", "end", "n_words", "keep_id", "removed", "n_docs"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(load_table(spark, sf_dir, "documents"))
