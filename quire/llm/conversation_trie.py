"""Operator 12: the prefix trie of rebuilt conversations, by monoid fingerprints.

A sequence of turns has the fingerprint (n, sum of t_i B^i mod p), and two
sequences compose to (n + m, H + B^n G); four bases make one of 124 bits. Every
conversation's own prefixes are summed once. A rebuilt conversation's prefix is
then the product of its base's head and a part of its own suffix, taken from
those sums by shifting with powers of B's inverse: no rebuilt text and no list
of turns is ever made, a prefix is a few numbers and a reference to the stored
turn it ends with.

Prefixes of one fingerprint are one node only if they verify: their last turns'
references must lead to stored turns of one content hash and their parents'
fingerprints must agree. By induction over the depth equal fingerprints are then
equal sequences. Should a node not verify, all is done again with other bases.

Sums over subtrees need no walk through the tree. Every node is owned by its
smallest member, so a conversation owns a stretch of its own path, down to its
end. A node lies under another exactly if its owner is a member there and it is
not higher; hence a subtree's sum is, over the members of its top, the sum of
what each owns from that depth down.
"""

from __future__ import annotations

import hashlib
import random
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quire.llm.common import col
from quire.llm.conversation_repair import CRC_TABLE, crc32_sql
from quire.operators.rows import with_row_index
from quire.session import ship_package, stored
from quire.sources.papers import load_table

PRIME = (1 << 31) - 1
LANES = 4
#: Heads are 0 to MOST_HEAD turns; conversations share a base in runs of BASES ids.
MOST_HEAD, BASES = 5, 100
#: Rows that one window sums at a time.
BLOCK = 1 << 16


def bases(seed: int) -> list[int]:
    draw = random.Random(seed)
    return [draw.randrange(1 << 20, PRIME) for _ in range(LANES)]


def power(base: int, exponent: str) -> str:
    """SQL of base ** exponent mod PRIME, by the exponent's bits."""
    out, b = "1L", base
    for k in range(31):
        out = f"({out} * if(({exponent} & {1 << k}L) <> 0, {b}L, 1L)) % {PRIME}L"
        b = b * b % PRIME
    return out


def running_sums(df: DataFrame, key: str, pos: str, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``df`` with ``sums`` (new name: column) over the rows of ``key`` up to
    each place ``pos``. Windows hold ``block`` rows at most; what lies before a
    block is added from the blocks' own totals."""
    df = df.withColumn("_block", F.floor(F.col(pos) / block))
    inner = Window.partitionBy(key, "_block").orderBy(pos)
    totals = df.groupBy(key, "_block").agg(*[F.sum(c).alias(c) for c in sums.values()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_of"),
                           *[F.sum(c).over(before).alias(f"_before_{n}") for n, c in sums.items()])
    out = df.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()})
    # only later blocks have anything before them
    later = totals.where(F.col(f"_before_{next(iter(sums))}").isNotNull())
    out = out.join(later, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")), "left")
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums}) \
        .drop("_block", "_key", "_of", *[f"_before_{n}" for n in sums])


def stored_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(``conv``, ``pos``, ``rn``, ``sha``, ``chars``): the turns in order, their
    texts left behind; ``rn`` is the reference to a stored turn."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = df.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv"), col(turn_col).alias("turn"), role.alias("role"), sha.alias("sha"),
        F.char_length(text).cast("long").alias("chars"))
    rows = with_row_index(turns.withColumn("_nth", F.monotonically_increasing_id()),
                          ["conv", "turn", "role", "sha", "_nth"], "rn")
    starts = rows.groupBy("conv").agg(F.min("rn").alias("start"))
    return stored(rows.join(starts, "conv").select("conv", (F.col("rn") - F.col("start")).alias("pos"), "rn", "sha", "chars"),
                  "trie-turns")


def rebuilt_prefixes(turns: DataFrame, seed: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(``conv``, ``depth``, ``f1``, ``f2``, parent's ``g1``, ``g2``, ``ref``,
    ``last``) of every prefix of every rebuilt conversation, and (``conv``,
    ``len``) of every conversation."""
    lanes, b = range(LANES), bases(seed)
    terms = turns.withColumns({f"t{i}": F.expr(f"pmod(xxhash64(sha, {i}, {seed}), {PRIME}L) * ({power(b[i], 'pos')}) % {PRIME}L")
                               for i in lanes})
    sums = running_sums(terms, "conv", "pos", {f"s{i}": f"t{i}" for i in lanes}, block)
    sums = sums.select("conv", "pos", "rn", *[(F.col(f"s{i}") % PRIME).alias(f"s{i}") for i in lanes],
                       *[F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(PRIME)).alias(f"q{i}") for i in lanes])
    sums = stored(sums, "trie-sums")
    # The first turns of a conversation (five at most): the heads that others take.
    head = F.sort_array(F.collect_list(F.when(F.col("pos") < MOST_HEAD, F.struct(
        "pos", "rn", *[f"s{i}" for i in lanes], *[f"q{i}" for i in lanes]))))
    convs = sums.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), head.alias("head"))
    convs = stored(convs.withColumns({
        "base": F.col("conv") - F.col("conv") % BASES,
        "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")}), "trie-heads")
    given = convs.select(F.col("conv").alias("_base"), F.col("head").alias("given"), F.col("n").alias("given_n"))
    convs = convs.join(given, F.col("base") == F.col("_base"), "left").select(
        "conv", "n", "h", F.least("h", F.coalesce("given_n", F.lit(0))).cast("int").alias("got"), "head", "given")

    def at(array: str, place: str, lane: int):
        return F.coalesce(F.expr(f"get({array}, {place} - 1).s{lane}"), F.lit(0))
    convs = convs.withColumn("len", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    joined = convs.select("conv", "h", "got", "len", *[at("given", "got", i).alias(f"b{i}") for i in lanes],
                          *[at("head", "h", i).alias(f"o{i}") for i in lanes])

    def pack(name: str, lane):
        return [F.expr(f"shiftleft({lane(2 * k)}, 31) + {lane(2 * k + 1)}").alias(f"{name}{k + 1}") for k in (0, 1)]
    heads = convs.where("got > 0").select("conv", "len", F.explode(F.expr("slice(given, 1, got)")).alias("e"))
    heads = heads.select("conv", (F.col("e.pos") + 1).alias("depth"), *pack("f", lambda i: f"e.s{i}"),
                         *pack("g", lambda i: f"e.q{i}"), F.col("e.rn").alias("ref"), "len")

    def moved(lane: int, of: str) -> str:
        back = [pow(pow(b[lane], PRIME - 2, PRIME), k, PRIME) for k in range(MOST_HEAD + 1)]
        shift = "get(array(" + ", ".join(f"{x}L" for x in back) + "), h - got)"
        return f"((b{lane} + {shift} * pmod({of}{lane} - o{lane}, {PRIME}L)) % {PRIME}L)"
    own = sums.join(joined, "conv").where("pos >= h").select(
        "conv", F.expr("pos - h + got + 1").alias("depth"), *pack("f", lambda i: moved(i, "s")),
        *pack("g", lambda i: moved(i, "q")), F.col("rn").alias("ref"), "len")
    rows = heads.unionByName(own).withColumn("last", F.col("depth") == F.col("len")).drop("len")
    return stored(rows, "trie-prefixes"), convs.select("conv", "len")


NODE = ["depth", "f1", "f2"]


def verified_nodes(prefixes: DataFrame, turns: DataFrame) -> DataFrame | None:
    """One row per node below the root, or None where a fingerprint stands for
    two different sequences."""
    refs = prefixes.groupBy(*NODE, "g1", "g2", "ref").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"))
    said = refs.join(turns.select(F.col("rn").alias("ref"), "sha", "chars"), "ref")
    proof = F.struct("g1", "g2", "sha")
    nodes = stored(said.groupBy(*NODE).agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min(proof).alias("lo"), F.max(proof).alias("hi"),
        F.max("chars").alias("chars")), "trie-nodes")
    if not nodes.where("lo <> hi").isEmpty():
        return None
    return nodes.select(*NODE, F.col("lo.g1").alias("g1"), F.col("lo.g2").alias("g2"), "n_convs", "conv_id",
                        ((F.col("n_convs") - 1) * F.col("chars")).alias("value"))


def _ends(batches):
    """(node, hash of its rows' comma-joined ids) of rows sorted by node and id;
    in memory are one hash state and one batch."""
    key, digest, out = None, None, []

    def table():
        return pa.RecordBatch.from_pylist(out, pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                                                          ("ends_sha256", pa.string())]))

    def close():
        out.append({"depth": key[0], "f1": key[1], "f2": key[2], "ends_sha256": digest.hexdigest()})
    for b in batches:
        for *node, conv in zip(*[b.column(c).to_pylist() for c in (*NODE, "conv")]):
            if node != key:
                if key is not None:
                    close()
                key, digest = node, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if len(out) >= 1024:
            yield table()
            out = []
    if key is not None:
        close()
        yield table()


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", seed: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``df``:
    ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A conversation c is rebuilt from the first h turns of conversation c - c %
    100 and its own turns after its first h, h = crc32(c) % 6. Turns are ordered
    by number, null first, turns of one number by role and content hash; repeated
    rows are turns of their own. Null roles and texts are empty; two turns are
    the same if their SHA-256 (of the role's length, role and text) is. Rows
    without a conversation id belong to no conversation and are left out. An
    empty table has no nodes; other columns are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    turns = stored_turns(df, conv_col, turn_col, role_col, text_col)
    for s in count(seed):
        prefixes, convs = rebuilt_prefixes(turns, s, block)
        nodes = verified_nodes(prefixes, turns)
        if nodes is not None:
            break
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids.where("depth > 0"), NODE, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    owned = nodes.select(F.col("conv_id").alias("conv"), "depth", "value", (F.col("n_children") == 0).cast("long").alias("leaf"))
    rows = prefixes.join(owned, ["conv", "depth"], "left").select(
        "conv", *NODE, (-F.col("depth")).alias("up"), F.coalesce("value", F.lit(0)).alias("value"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"))
    below = running_sums(rows, "conv", "up", {"saved": "value", "leaves": "leaf"}, block) \
        .groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = prefixes.where("last").select("conv", *NODE).unionByName(
        convs.where("len = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f1"),
                                      F.lit(0).cast("long").alias("f2")))
    ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv").mapInArrow(
        _ends, "depth long, f1 long, f2 long, ends_sha256 string")

    # The root: three sums over the nodes, two over the conversations.
    top = nodes.agg(F.count_if(F.col("depth") == 1), F.count_if(F.col("n_children") == 0), F.sum("value")).first()
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).first()
    first = spark.createDataFrame(
        [(0, 0, 0, root["conv_id"], None, root["n_convs"], top[0], top[1] or 1, top[2] or 0)] if root["n_convs"] else [],
        "depth long, f1 long, f2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long")
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"),
                        F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(below, NODE).join(over, ["depth", "g1", "g2"], "left")
    tree = tree.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"])).otherwise(F.col("parent_conv_id")))
    tree = tree.select(*first.columns).unionByName(first).join(ends, NODE, "left")
    return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load_table(spark, sf_dir, "conversations"))


SQL = {"op12_conversation_trie": f"""WITH {CRC_TABLE},
tn AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
th AS (SELECT c, turn, r, length(t) AS n, sha256(octet_length(encode(r)) || ':' || r || t) AS s FROM tn),
tl AS (SELECT c, list(s ORDER BY turn NULLS FIRST, r, s) AS l, list(n ORDER BY turn NULLS FIRST, r, s) AS n,
  c - c % 100 AS b FROM th GROUP BY c),
hs AS (SELECT tl.*, CAST({crc32_sql("CAST(c AS VARCHAR)")} % 6 AS BIGINT) AS h FROM tl, crct),
rb AS (SELECT x.c, list_concat(coalesce(y.l, [])[1:x.h], x.l[x.h + 1:len(x.l)]) AS l,
  list_concat(coalesce(y.n, [])[1:x.h], x.n[x.h + 1:len(x.n)]) AS n FROM hs x LEFT JOIN hs y ON y.c = x.b),
pr AS (SELECT c, l, n, unnest(range(0, len(l) + 1)) AS d FROM rb),
nd AS (SELECT d, l[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * any_value(n[d]) END AS v,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '') AS e FROM pr GROUP BY d, l[1:d]),
kd AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nd WHERE d > 0 GROUP BY ALL),
nk AS (SELECT nd.*, coalesce(kd.n_children, 0) AS n_children FROM nd LEFT JOIN kd ON kd.d = nd.d AND kd.k = nd.k),
up AS (SELECT unnest(range(0, d + 1)) AS a, k, v, n_children FROM nk),
sb AS (SELECT a AS d, k[1:a] AS k, CAST(sum(v) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM up GROUP BY a, k[1:a])
SELECT nk.conv_id, nk.d AS depth, p.conv_id AS parent_conv_id, nk.n_convs, nk.n_children, sb.n_leaves, sb.saved_tokens,
  sha256(nk.e) AS ends_sha256
FROM nk JOIN sb ON sb.d = nk.d AND sb.k = nk.k LEFT JOIN nd p ON p.d = nk.d - 1 AND p.k = nk.k[1:nk.d - 1]"""}
