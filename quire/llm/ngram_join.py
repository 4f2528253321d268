"""Operator 2: n-gram Jaccard join by vertical partitioning.

1. Every text becomes its set of word shingles; equal sets become one class.
2. The hash order of all n-grams is cut into fragments. In half of them it is
   counted how many of a set's n-grams any other set holds too; a set with more
   than a quarter of its n-grams to itself cannot link (exact, no sampling).
3. The sets that are left are ordered by (document frequency, hash), the global
   n-gram order. Two linked sets share an n-gram of their prefixes, so pairs
   are looked for only in prefix buckets. That order is cut into fragments by
   frequency; overlaps are counted in each fragment and summed per pair.
4. A bucket is worked through by hubs: each member is compared with one hub,
   linked members become one component, and only members of different
   components are compared further, down to the last such pair. Thousands of
   near copies of one text cost a few comparisons each instead of all pairs,
   and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import shingles as S
from quire.llm.common import col, id_text, partitions, released, small, unclear_ids
from quire.llm.components import components
from quire.session import ship_package, stored
from quire.sources.papers import load_table

#: Bytes of hashes after which a map-side block ships its n-grams.
BLOCK_BYTES = 8 << 20
#: Hub rounds go on while the comparisons that are left exceed this multiple of
#: the rows of their buckets, and at most so often; then all that are left follow.
LAST_PAIRS = 256
HUB_ROUNDS = 3
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 6


def _sets(ids: pa.Array, texts: pa.Array, k: int):
    """(ids, size, keys, hashes, row) slice by slice; rows are positions in ids."""
    data, bounds = S.buffer_of(texts)
    for lo, hi in S.slices(bounds):
        inner = bounds[lo:hi + 1] - bounds[lo]
        h, row, _, _ = S.words(data[bounds[lo]:bounds[hi]], inner)
        s, own, _ = S.shingle_hashes(h, row, hi - lo, k)
        s, own = S.distinct(s, own)
        size, keys = S.set_keys(s, own, hi - lo)
        yield ids.slice(lo, hi - lo), size, keys, s, own


def _blocks(batches, k: int):
    """Parts of sets with about ``BLOCK_BYTES`` of hashes: ids, sizes, keys, hashes
    and rows of the n-grams of the probed half of the order; the others are not held."""
    parts, taken = [], 0
    for batch in batches:
        for ids, size, keys, s, row in _sets(batch.column(0), batch.column(1), k):
            taken += s.nbytes
            probed = s < np.uint64(1 << 63)
            parts.append((ids, size, keys, s[probed], row[probed].astype(np.int32)))
            if taken >= BLOCK_BYTES:
                yield parts
                parts, taken = [], 0
    if parts:
        yield parts


def _joined(parts):
    """The block of ``parts``, which are let go before it is worked on."""
    step = np.cumsum([0] + [len(p[1]) for p in parts]).astype(np.int32)
    ids, size, keys, s, row = zip(*parts)
    parts.clear()
    return (pa.concat_arrays(ids), np.concatenate(size), np.concatenate(keys), np.concatenate(s),
            np.concatenate([r + step[i] for i, r in enumerate(row)]))


def _probe(size, keys, s, row):
    """One copy of each set: (hash, row, whether another set of the block holds it)."""
    _, first = np.unique(keys[:, 0], return_index=True)
    one = np.zeros(len(size), dtype=bool)
    one[first] = True
    order = np.argsort(s, kind="stable")
    order = order[one[row[order]]]
    s, row = s[order], row[order]
    same = s[1:] == s[:-1]
    several = np.zeros(len(s), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    return s, row, several


def _describe(batches, k: int):
    """One row a text: id, set size, set key, number of n-grams probed."""
    for batch in batches:
        for ids, size, keys, s, row in _sets(batch.column(0), batch.column(1), k):
            probed = np.bincount(row[s < np.uint64(1 << 63)], minlength=len(size))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int32()), pa.array(keys[:, 0] | 1), pa.array(keys[:, 1]),
                 pa.array(probed, pa.int32())], ["_id", "n", "cls", "k2", "probed"])


def _ship(batches, k: int, bits: int):
    """One row a block and fragment: the block's n-grams, each shipped once
    however many of its sets hold it. ``owners`` are pairs (set key, id of the
    row that speaks for the set here); key 0 stands for several sets. What the
    block alone shows to be shared travels as a count."""
    for parts in _blocks(batches, k):
        yield _shipped(parts, bits)


def _shipped(parts, bits: int) -> pa.RecordBatch:
    ids, size, keys, s, row = _joined(parts)
    s, row, several = _probe(size, keys, s, row)
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = np.bincount(row[several], minlength=len(size))
    known = np.flatnonzero(seen)
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    s, row, several = s[first], row[first], several[first]
    owner = np.where(several, len(size), row)
    key = np.append(keys[:, 0] | 1, 0)
    who = np.append(ids, -1)
    frag = (s >> np.uint64(63 - bits)).astype(np.int64)
    low = ((s << np.uint64(1 + bits)) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((owner, frag))
    frag, low, owner = frag[order], low[order], owner[order]
    edges = np.searchsorted(frag, np.arange((1 << bits) + 1))
    out = ([], [], [], [], [], [])
    spread = np.array_split(known, 1 << bits)
    for f in range(1 << bits):
        lo, hi = edges[f], edges[f + 1]
        own, count = np.unique(owner[lo:hi], return_counts=True)
        for values, x in zip(out, (f, low[lo:hi].tobytes(),
                                   np.stack([key[own], who[own]], axis=1).tobytes(),
                                   count.astype(np.uint32).tobytes(),
                                   ids[spread[f]].tobytes(), seen[spread[f]].astype(np.int64).tobytes())):
            values.append(x)
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
        ["frag", "grams", "owners", "counts", "known", "seen"])


def _count_fragment(table: pa.Table) -> pa.Table:
    """How many n-grams of each speaker's set another set holds as well."""
    def joined(name, kind):
        return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    g = joined("grams", np.uint32)
    owners = joined("owners", np.int64).reshape(-1, 2)
    at = np.repeat(np.arange(len(owners)), joined("counts", np.uint32))
    order = np.lexsort((owners[at, 0], g))
    g, at = g[order], at[order]
    key, who = owners[at, 0], owners[at, 1]
    if len(g):
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        length = np.diff(np.append(begin, len(g)))
        shared = (key[begin] != key[begin + length - 1]) | np.logical_or.reduceat(key == 0, begin)
        who = who[np.repeat(shared, length) & (key != 0)]
    ids = np.concatenate([who, joined("known", np.int64)])
    counts = np.concatenate([np.ones(len(who), np.int64), joined("seen", np.int64)])
    ids, inverse = np.unique(ids, return_inverse=True)
    held = np.bincount(inverse, weights=counts, minlength=len(ids)).astype(np.int64)
    return pa.table({"_id": pa.array(ids, pa.int64()), "held": pa.array(held, pa.int64())})


def _grams(batches, k: int):
    """(cls, n, grams) of texts that stand for their class."""
    for batch in batches:
        want = batch.column(2).to_numpy()
        step = 0
        for ids, size, keys, s, row in _sets(batch.column(0), batch.column(1), k):
            ok = (keys[:, 0] | 1) == want[step:step + len(ids)]
            step += len(ids)
            bounds = np.concatenate(([0], np.cumsum(size)))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(s.view(np.int64)))
            rows = pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0] | 1), pa.array(size, pa.int32()), lists], ["cls", "n", "grams"])
            yield rows.filter(pa.array(ok))


def _least_shared(n, percent: int):
    """Overlap that a set of ``n`` n-grams needs with any set that it links to."""
    return F.ceil(n * F.lit(percent) / F.lit(100)).cast("long")


def _classes(docs: DataFrame, k: int, percent: int):
    """The texts' descriptions, and the classes of equal sets that may link."""
    spark = docs.sparkSession
    described = stored(docs.mapInArrow(
        lambda it: released(_describe(it, k)), "_id long, n int, cls long, k2 long, probed int"), "ngram-sets")
    bits = max(6, (partitions(docs) - 1).bit_length())
    held = (docs.mapInArrow(lambda it: released(_ship(it, k, bits)), "frag int, grams binary, owners binary, "
                            "counts binary, known binary, seen binary")
            .groupBy("frag").applyInArrow(_count_fragment, "_id long, held long")
            .groupBy("_id").agg(F.sum("held").alias("held")))
    # Every text of a class has the same counts; one of them spoke for it.
    classes = (described.where("n > 0").join(held, "_id", "left")
               .groupBy("cls").agg(F.min("_id").alias("first_id"), F.min("n").alias("n"),
                                   F.min("probed").alias("probed"), F.max("held").alias("held")))
    may = classes.where(F.coalesce("held", F.lit(0)) >=
                        F.col("probed") - (F.col("n") - _least_shared(F.col("n"), percent)))
    return described, stored(may.select("cls", "first_id"), "ngram-classes")


def _ordered(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cls, n, shared): the n-grams that other classes hold too, as (df, hash)
    in the global order; n-grams of one class alone come before all others and
    are only counted (n - size(shared))."""
    texts = (docs.join(small(classes, "ngram-texts"), F.col("_id") == F.col("first_id"))
             .select("_id", "_text", "cls"))
    sets = stored(texts.mapInArrow(lambda it: released(_grams(it, k)), "cls long, n int, grams array<long>")
                  .dropDuplicates(["cls"]), "ngram-grams")
    # A class holds an n-gram once, so one n-gram is a small part of the rows;
    # one exchange by n-gram serves the count and the join.
    rows = sets.select("cls", "n", F.explode("grams").alias("g")).repartition(partitions(docs), "g")
    df = rows.groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    return (rows.join(df, "g").groupBy("cls", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("shared")))


def _segments(ordered: DataFrame) -> DataFrame:
    """A row's n-grams cut into fragments. A fragment is a range of the global
    order, the frequencies between two powers of two; the last holds all that
    are more frequent."""
    rows = ordered.withColumn("frag", F.explode(F.sequence(F.lit(1), F.lit(FRAGMENTS))))
    inside = F.expr(f"filter(shared, x -> least({FRAGMENTS}, int(floor(log2(x.df)))) = frag)")
    return rows.withColumn("seg", inside.getField("g")).drop("shared").where(F.size("seg") > 0)


def _verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose partial overlaps add up to the threshold. Only
    n-grams of classes that occur in pairs are cut and moved."""
    pairs = small(pairs, "ngram-pairs")
    left = _segments(ordered.select(F.col("cls").alias("a"), F.col("n").alias("na"), "shared").join(pairs, "a"))
    hubs = small(pairs.select("b").distinct(), "ngram-hubs")
    right = _segments(ordered.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "shared")
                      .join(hubs, "b", "left_semi")).withColumnRenamed("seg", "sb")
    partial = (left.join(right, ["b", "frag"]).groupBy("a", "b", "na", "nb")
               .agg(F.sum(F.size(F.array_intersect("seg", "sb"))).alias("o")))
    return partial.where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o"))) \
        .select("a", "b", (F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("jaccard"))


def _prefix_members(ordered: DataFrame, percent: int) -> DataFrame:
    """(g, cls, n, own, pos) of the prefix n-grams; ``pos`` counts from 0 in the
    set's global order, ``own`` is the number of n-grams that it alone holds. Of n-grams that the same classes hold in their
    prefixes only the first in the order stays: the others show no new pair."""
    prefix = F.size("shared") - _least_shared(F.col("n"), percent) + 1
    rows = stored(
        ordered.select("cls", "n", F.size("shared").alias("m"),
                       F.posexplode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("i", "x"))
        .select("x.g", "x.df", "cls", "n", (F.col("n") - F.col("m")).alias("own"),
                (F.col("n") - F.col("m") + F.col("i")).alias("pos")), "ngram-prefixes")
    buckets = rows.groupBy("g").agg(F.bit_xor(F.xxhash64("cls")).alias("s1"),
                                    F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("s2"),
                                    F.count(F.lit(1)).alias("size"), F.min("df").alias("df"))
    first = (buckets.where("size > 1").groupBy("s1", "s2", "size")
             .agg(F.min(F.struct("df", "g")).alias("x")).select("x.g"))
    return stored(rows.join(first, "g").select("g", "cls", "n", "own", "pos"), "ngram-members")


def _may_link(x: str, y: str, percent: int):
    """Whether members x and y of a bucket can link if the bucket's n-gram is
    the first that they share: sizes alike, the n-gram within the short prefix
    of the smaller set, and enough n-grams behind it in both."""
    def c(side, name):
        return F.col(f"{side}.{name}")
    smaller = (c(x, "n") < c(y, "n")) | ((c(x, "n") == c(y, "n")) & (c(x, "cls") < c(y, "cls")))
    n1, n2 = F.least(c(x, "n"), c(y, "n")), F.greatest(c(x, "n"), c(y, "n"))
    p1 = F.when(smaller, c(x, "pos")).otherwise(c(y, "pos"))
    p2 = F.when(smaller, c(y, "pos")).otherwise(c(x, "pos"))
    whole = 100 + percent
    short = n1 - F.ceil(n1 * F.lit(2 * percent) / F.lit(whole)) + 1
    least = F.ceil((n1 + n2) * F.lit(percent) / F.lit(whole))
    return ((n1 * 100 >= n2 * percent) & (p1 < short) & (F.least(n1 - p1, n2 - p2) >= least))


def _hub_pairs(state: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each class with one hub of its buckets: the one it meets most often.

    A bucket's hub is a member of its main component: first the one with the
    fewest n-grams of its own, which edited copies have and their source lacks,
    later another one each turn."""
    order = F.col("own").cast("long") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    at = F.struct(order.alias("o"), "cls", "n", "pos", "comp")
    hubs = state.where("comp = main").groupBy("g").agg(F.min(at).alias("h")).select("g", "h.*").alias("h")
    meets = (state.alias("x").join(hubs, "g").where(F.col("x.comp") != F.col("h.comp"))
             .where(_may_link("x", "h", percent))
             .groupBy("x.cls", F.col("h.cls").alias("h")).agg(F.count(F.lit(1)).alias("times")))
    best = meets.groupBy("cls").agg(F.max(F.struct("times", "h")).alias("best"))
    return best.select(F.col("cls").alias("a"), F.col("best.h").alias("b"))


def _cross_pairs(state: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket's members that lie in different components: those
    outside the bucket's main component against all others."""
    x = state.where("comp <> main").alias("x")
    y = state.alias("y")
    both = x.join(y, "g").where(F.col("x.comp") != F.col("y.comp")) \
        .where((F.col("y.comp") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))) \
        .where(_may_link("x", "y", percent))
    return both.select(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")).distinct()


def _open_members(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members of buckets that hold several components, each with its component
    and the bucket's largest one."""
    if links is None:
        state = members.withColumn("comp", F.col("cls"))
    else:
        comp = components(links).withColumnRenamed("node", "cls")
        state = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("component", "cls")) \
            .drop("component")
    per = state.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"), F.max(-F.col("own")).alias("own"))
    main = (per.groupBy("g").agg(F.max(F.struct("c", "own", "comp")).alias("m"), F.count(F.lit(1)).alias("k"))
            .where("k > 1").select("g", F.col("m.comp").alias("main"), F.col("m.c").alias("most")))
    return stored(state.join(main, "g"), "ngram-open")


def link_classes(ordered: DataFrame, percent: int, last_pairs: int = LAST_PAIRS,
                 known: DataFrame | None = None) -> DataFrame:
    """Verified links that connect every two classes that links connect; with
    ``known`` links (a, b, jaccard) they begin from those and hold them too."""
    ordered = stored(ordered.where(F.size("shared") >= _least_shared(F.col("n"), percent)), "ngram-order")
    members = _prefix_members(ordered, percent)
    links, keep = known, ["g", "cls", "n", "own", "pos"]
    for turn in range(HUB_ROUNDS):
        state = _open_members(members, links)
        rows, cross = state.agg(F.count(F.lit(1)), F.sum(F.when(F.col("comp") != F.col("main"), F.col("most")))).first()
        if not rows:
            break
        last = turn and (cross <= last_pairs * rows or turn == HUB_ROUNDS - 1)
        pairs = _cross_pairs(state, percent) if last else _hub_pairs(state, turn, percent)
        found = _verified(pairs, ordered, percent)
        links = stored(found if links is None else links.unionByName(found), "ngram-links")
        if last:
            break
        members = state.select(*keep)
    if links is None:
        links = ordered.sparkSession.createDataFrame([], "a long, b long, jaccard double")
    return links


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
               percent: int = 75) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles``, ``class_id`` (key
    of its set of shingles), ``component_id`` (smallest id reachable by links).

    Words are runs other than ASCII white space, A-Z in lower case; a text's set
    holds its distinct ``k``-word shingles, or with fewer words the whole
    sequence. Two texts link when 100 * intersection >= ``percent`` * union.
    Null, empty and blank texts have an empty set, link with nothing and form
    their own component, also when ids repeat. Ids are integers; a row with a
    null id has null as component. Repeated rows fall into one class. An empty
    table gives an empty result; other columns are ignored.
    """
    ship_package(df.sparkSession)
    every = id_text(df, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    docs = every.where("_id is not null")
    described, classes = _classes(docs, k, percent)
    links = link_classes(_ordered(docs, classes, k), percent)
    comp = stored(components(links).join(classes.withColumnRenamed("cls", "node"), "node")
                  .select("node", "component"), "ngram-components")
    sizes = described.where("n > 0").groupBy("cls").agg(F.min("_id").alias("least"))
    per = (sizes.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
           .withColumn("component", F.coalesce("component", "cls")))
    least = per.groupBy("component").agg(F.min("least").alias("component_id"))
    class_ids = per.join(least, "component").select("cls", "component_id")
    out = described.join(class_ids, "cls", "left").select(
        F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("cls")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    missing = every.where("_id is null")
    nulls = missing.mapInArrow(lambda it: released(_describe(it, k)), described.schema).select(
        F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nulls)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(load_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one_of_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without those that a smaller id of their component
    stands for. Where ids repeat, rows are told apart by their sets."""
    out = ngram_join(df, id_col, text_col)
    unclear = unclear_ids(df, id_col).where("_unclear is not null")
    if not unclear.isEmpty():
        out = stored(out, "ngram-rows")
        rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "ngram-table")
        sets = id_text(rows.join(unclear, col(id_col) == F.col("_unclear"), "left_semi").select("_row", col(id_col), col(text_col)),
                       "_row", text_col).mapInArrow(lambda it: released(_describe(it, 5)), "_id long, n int, cls long, k2 long, probed int")
        gone = out.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"), "class_id").distinct()
        own = rows.select("_row", col(id_col).alias("_gone")).join(sets.where("n > 0").select(F.col("_id").alias("_row"), F.col("cls").alias("class_id")), "_row")
        told = own.join(gone, ["_gone", "class_id"], "left_semi").select("_row")
        clear = rows.join(gone.select("_gone").join(unclear, F.col("_gone") == F.col("_unclear"), "left_anti"),
                          col(id_col) == F.col("_gone"), "left_anti")
        return clear.join(told, "_row", "left_anti").select(*[col(c) for c in df.columns])
    gone = out.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return df.join(small(gone, "near-copies"), col(id_col) == F.col("_gone"), "left_anti")
