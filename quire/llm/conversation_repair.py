"""Operator 11: conversation structure repair by a lightest-derivation agenda.

A repair is a derivation in a weighted hypergraph. Items are ``(entry state,
rows read, state)``; a deduction reads one row with an edit (keep, rerole,
delete), or inserts a turn, and adds to the item's value, the pair (cost,
audit): costs add up, audits append the edit's letter. Both functions are
superior (the new pair is never less, as costs are not negative and an audit is
less than what extends it) and monotone (pairs of one item that cost the same
are never prefixes of each other, since only inserts, which cost, read no row).
So the agenda pops items in order of their value and each popped value is final;
it ends when the goal item is popped.

A conversation is cut into spans of at most ``SPAN`` distinct rows; each span's
agenda runs from all four entry states. Spans are then the deductions of a
second hypergraph, joined ``FAN`` at a time until one is left, so that a
conversation that holds a third of all rows is shared out over many tasks. Texts
take no part in this. They move once, to be hashed in order beside the audit:
a stream with one hash state and one audit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quire.llm.common import SPACE, col
from quire.operators.rows import with_row_index
from quire.session import ship_package, stored
from quire.sources.papers import load_table

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Distinct rows whose agenda runs in one step, and spans joined in one step.
SPAN, FAN = 512, 64

#: States of the role pattern (s?(ua)+)?: nothing read, system read, user read,
#: assistant read. Each has one role that may come next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
GOAL = (START, ASSISTANT)
END = (START, -1, START)  # the goal item
LEGAL = {"su", "ua", "au"}
FINE, CUT, GONE = range(3)  # kinds of a row: whole, truncated, to be deleted


def lightest(starts, deductions, goal=None) -> dict:
    """Knuth's generalisation of Dijkstra's algorithm: the least (cost, audit)
    of every item that can be derived, or of all items up to ``goal``.

    ``deductions(item)`` gives (conclusion, cost, letters) of every deduction
    whose tail is ``item``; its function adds the cost and appends the letters.
    """
    agenda = [(0, "", item) for item in starts]
    final: dict = {}
    while agenda:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if item == goal:
            break
        for head, more, letters in deductions(item):
            if head not in final:
                heappush(agenda, (cost + more, audit + letters, head))
    return final


@lru_cache(maxsize=16384)
def row_edits(initial: str, kind: int, n: int) -> tuple:
    """For each state, the (state, cost, letters) of reading ``n`` rows alike."""
    if kind == GONE:
        return tuple(((q, DELETE * n, "D" * n),) for q in range(4))
    late = TRUNCATED if kind == CUT else 0
    out = []
    for q in range(4):
        ways = [(q, DELETE, "D"), (AFTER[q], REROLE + late, "R")]
        if initial == NEXT[q][0]:
            ways.append((AFTER[q], late, "K"))
        elif initial == "s" and q == START:
            ways.append((SYSTEM, late, "K"))
        out.append(tuple(ways))
    return tuple(out)


def span_moves(rows: tuple) -> tuple[list, list]:
    """Costs and audits of getting from every state (outer) to every state over
    ``rows`` of (initial, kind, n); -1 and empty where there is no way."""
    edits = [row_edits(*r) for r in rows]
    n = len(rows)

    def deductions(item):
        entry, i, q = item
        yield (entry, i, AFTER[q]), INSERT, "I"
        if i < n:
            for to, cost, letters in edits[i][q]:
                yield (entry, i + 1, to), cost, letters
    final = lightest([(p, 0, p) for p in range(4)], deductions)
    ends = [final.get((p, n, q), (-1, "")) for p in range(4) for q in range(4)]
    return [c for c, _ in ends], [a for _, a in ends]


_short_moves = lru_cache(maxsize=4096)(span_moves)


def _join_deductions(spans: list[dict], goal: bool = False):
    def deductions(item):
        entry, k, q = item
        if k < len(spans):
            costs, audits = spans[k]["costs"], spans[k]["audits"]
            for to in range(4):
                if costs[4 * q + to] >= 0:
                    yield (entry, k + 1, to), costs[4 * q + to], audits[4 * q + to]
        elif goal and q in GOAL:
            yield END, 0, ""
    return deductions


def repair(span: dict) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation's span."""
    if span["first"] is None:
        return 0, ""
    return lightest([(START, 0, START)], _join_deductions([span], True), END)[END]


NUMBERS = ("blank", "duplicate", "truncated", "illegal", "turns")


def make_span(rows) -> dict:
    """The span of sorted distinct rows (``turn, initial, blank, first, cut, n``)."""
    s = dict.fromkeys(NUMBERS, 0) | {"lo": None, "hi": None, "first": None, "last": None}
    steps = []
    for r in rows:
        n, initial = r["n"], r["initial"]
        if not n:
            continue
        if s["first"] is None:
            s["first"] = initial
        else:
            s["illegal"] += s["last"] + initial not in LEGAL
        s["last"] = initial
        s["illegal"] += n - 1  # copies stand side by side
        if r["turn"] is not None:
            s["turns"] += r["turn"] != s["hi"]
            s["lo"] = r["turn"] if s["lo"] is None else s["lo"]
            s["hi"] = r["turn"]
        if r["blank"]:
            s["blank"] += n
            steps.append((initial, GONE, n))
            continue
        whole = int(r["first"])
        s["duplicate"] += n - whole
        if whole:
            s["truncated"] += bool(r["cut"])
            steps.append((initial, CUT if r["cut"] else FINE, 1))
        if n > whole:
            steps.append((initial, GONE, n - whole))
    moves = _short_moves if len(steps) <= 16 else span_moves
    s["costs"], s["audits"] = moves(tuple(steps))
    return s


def join_spans(spans: list[dict]) -> dict:
    """The span of neighbouring spans, in order."""
    spans = [s for s in spans if s["first"] is not None] or spans[:1]
    if len(spans) == 1:
        return spans[0]
    out = dict(spans[0])
    for s in spans[1:]:
        for k in NUMBERS:
            out[k] += s[k]
        out["illegal"] += out["last"] + s["first"] not in LEGAL
        out["turns"] -= out["hi"] is not None and out["hi"] == s["lo"]
        out["lo"] = s["lo"] if out["lo"] is None else out["lo"]
        out["hi"] = out["hi"] if s["hi"] is None else s["hi"]
        out["last"] = s["last"]
    final = lightest([(p, 0, p) for p in range(4)], _join_deductions(spans))
    ends = [final.get((p, len(spans), q), (-1, "")) for p in range(4) for q in range(4)]
    out["costs"], out["audits"] = [c for c, _ in ends], [a for _, a in ends]
    return out


SPAN_FIELDS = ", ".join(f"{k} long" for k in NUMBERS) + \
    ", lo long, hi long, first string, last string, costs array<long>, audits array<string>"


def _span_batches(build, kind: str, names: list[str]):
    """A mapInArrow function: one span of every row's list ``parts``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                spans = [build(rows) for rows in part.column("parts").to_pylist()]
                cols = [part.column("conv"), part.column("seg")] + \
                    [pa.array([s[k] for s in spans], types[k]) for k in names]
                yield pa.RecordBatch.from_arrays(cols, ["conv", "seg", *names])
    types = {k: pa.int64() for k in (*NUMBERS, "lo", "hi")} | {"first": pa.string(), "last": pa.string()} | \
        {"costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
    return run, f"conv {kind}, seg long, {SPAN_FIELDS}"


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(``conv``, ``turn``, ``role``, ``text``, ``copies``): ``df`` damaged by
    crc32(`conv:turn`) % 20, nulls as one space: 0 leaves no copy, 1 empties the
    text, 2 takes out its sentence ends, 3 makes two copies, 4 makes it a user's."""
    def text(c):
        return F.coalesce(col(c).cast("string"), F.lit(" "))
    d = df.select(col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"),
                  text(role_col).alias("role"), text(text_col).alias("text"),
                  (F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20).alias("code"))
    code = F.col("code")
    return d.select(
        "conv", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"))


def conversation_spans(turns: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """One span per conversation of ``turns`` (columns of :func:`damage`)."""
    ends = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    narrow = turns.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), "copies",
                          (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"))
    # Map-side sums: rows alike are one row with a count.
    alike = narrow.groupBy("conv", "turn", "role", "sha").agg(
        F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # Range partitions in reading order: a long conversation lies in many.
    rows = with_row_index(alike, ["conv", "turn", "role", "sha"], "rn")
    firsts = rows.where("n > 0").groupBy("conv", "role", "sha").agg(F.min("rn").alias("rn")) \
        .select("rn", F.lit(True).alias("first"))
    rows = rows.join(firsts, "rn", "left").select(
        "conv", (F.col("rn") / span).cast("long").alias("seg"),
        F.struct("rn", "turn", F.substring("role", 1, 1).alias("initial"), "blank",
                 F.coalesce("first", F.lit(False)).alias("first"), "cut", "n").alias("part"))
    kind = turns.schema["conv"].dataType.simpleString()
    names = [*NUMBERS, "lo", "hi", "first", "last", "costs", "audits"]
    # At most ``span`` rows a group: they have neighbouring numbers.
    groups = rows.groupBy("conv", "seg").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    make, schema = _span_batches(make_span, kind, names)
    spans = stored(groups.mapInArrow(make, schema), "repair-spans")
    join, schema = _span_batches(join_spans, kind, names)
    while not spans.groupBy("conv").count().where("count > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("conv").orderBy("seg")) - 1
        near = spans.select("conv", (nth / fan).cast("long").alias("_to"), F.struct("seg", *names).alias("part"))
        groups = near.groupBy("conv", F.col("_to").alias("seg")).agg(F.sort_array(F.collect_list(
            F.struct("part.seg", "part"))).alias("parts")).select("conv", "seg", F.col("parts.part").alias("parts"))
        spans = stored(groups.mapInArrow(join, schema), "repair-spans")
    return spans


def _final(kind: str):
    def run(batches):
        for b in batches:
            spans = b.to_pylist()
            done = [repair(s) for s in spans]
            gaps = [0 if s["lo"] is None else s["hi"] - s["lo"] + 1 - s["turns"] for s in spans]
            cols = [b.column("conv"), pa.array(gaps, pa.int64())] + [b.column(k) for k in NUMBERS[:4]] + \
                [pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["conv", "gaps", *NUMBERS[:4], "cost", "audit"])
    return run, f"conv {kind}, gaps long, " + ", ".join(f"{k} long" for k in NUMBERS[:4]) + ", cost long, audit string"


class Walk:
    """The repaired turns of one conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield NEXT[self.state], ""
            self.state = AFTER[self.state]
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "K" and role[0] == "s":
            self.state = SYSTEM
        else:
            role = role if letter == "K" else NEXT[self.state]
            self.state = AFTER[self.state]
        yield role, text


def _in_order(turns: DataFrame, results: DataFrame) -> DataFrame:
    """Every conversation's result, then its rows in reading order, together in
    one partition: the only time that texts move."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema if f.name != "conv"]
    heads = results.select("*", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("turn", "long"), ("role", "string"), ("sha", "binary"), ("text", "string"), ("copies", "long"))])
    rows = turns.where("copies > 0").select(
        "conv", *none, F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), "text", "copies")
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "sha")


def _walks(batches):
    """(head, turns) of every conversation of a partition of :func:`_in_order`;
    ``turns`` has to be read before the next conversation."""
    def rows():
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                yield from b.slice(lo, 1024).to_pylist()
    stream, ahead = rows(), []

    def one(head):
        walk = Walk(head["audit"])
        for r in stream:
            if r["kind"] == 0:
                ahead.append(r)
                break
            for _ in range(r["copies"]):
                yield from walk.row(r["role"], r["text"])
        yield from walk.inserts()
    for head in stream:
        ahead.append(head)
        while ahead:
            head = ahead.pop()
            yield head, one(head)


def repair_results(turns: DataFrame) -> DataFrame:
    """(``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit``) of every conversation of ``turns``."""
    ship_package(turns.sparkSession)
    run, schema = _final(turns.schema["conv"].dataType.simpleString())
    return stored(conversation_spans(turns).mapInArrow(run, schema), "repair-results")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(``conv``, ``place``, ``role``, ``text``): the repaired conversations."""
    results = repair_results(turns)
    kind = turns.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), T.StructField("place", T.LongType()),
                        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def lines(batches):
        for head, said in _walks(batches):
            some = []
            for place, (role, text) in enumerate(said):
                some.append({"conv": head["conv"], "place": place, "role": role, "text": text})
                if len(some) == 256:
                    yield pa.RecordBatch.from_pylist(some, arrow)
                    some = []
            if some:
                yield pa.RecordBatch.from_pylist(some, arrow)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    return _in_order(turns, results.select("conv", "audit")).mapInArrow(lines, out)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: the columns of
    :func:`repair_results` and ``repaired_sha256``, of the repaired `role:text`
    lines.

    ``turns`` has ``conv``, ``turn``, ``role``, ``text`` and ``copies`` (how
    often the row stands there; 0: the conversation is known, the row is gone).
    Rows are read by turn, null first; rows of one turn by role and hash of the
    text, so repeated rows stand side by side and the later ones are duplicates.
    A null conversation id is a conversation of its own; null roles and texts
    have to be filled before (:func:`damage` does). Empty roles have no initial:
    they are reroled or deleted. A conversation without rows has zeros, an empty
    audit and the hash of the empty string; an empty table gives an empty result.
    """
    results = repair_results(turns)
    out = T.StructType([*results.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    names = results.columns

    def digests(batches):
        done: list[dict] = []
        for head, said in _walks(batches):
            digest, sep = hashlib.sha256(), b""
            for role, text in said:
                digest.update(sep + f"{role}:".encode() + text.encode())
                sep = b"\n"
            done.append({k: head[k] for k in names} | {"repaired_sha256": digest.hexdigest()})
            if len(done) == 256:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    return _in_order(turns, results).mapInArrow(digests, out)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damage(load_table(spark, sf_dir, "conversations")))
    return out.withColumnRenamed("conv", "conv_id")


# ---------------------------------------------------------------------------
# the same in DuckDB: a fold over the rows, four values a conversation
# ---------------------------------------------------------------------------

#: CRC-32 of an ASCII text: the table by its rule, then a byte at a time.
CRC_TABLE = ("crct AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 "
             "THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl FROM range(256) r(i))")


def crc32_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), "
            "lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)")


def _sql() -> str:
    def add(v: str, cost: str, letter: str) -> str:
        return (f"lpad(CAST(CAST(substr({v}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10) || '{letter}'")

    def keep(initial: str, *ways: str) -> str:
        return ", ".join(f"CASE WHEN a = '{initial}' THEN {w} END" for w in ways)
    closed = ("SELECT conv, k, v0, v1, v2, least(v3, " + add("v2", "5", "I") + ") AS v3 FROM (SELECT conv, k, v0, v1, least(v2, " +
              ", ".join(add(v, "5", "I") for v in ("v0", "v1", "v3")) + ") AS v2, v3 FROM {0})")
    whole = {q: f"least({', '.join(ways)})" for q, ways in {
        "v1": [add("v1", "2", "D"), keep("s", add("v0", "late", "K"))],
        "v2": [add("v2", "2", "D"), *[add(v, "1 + late", "R") for v in ("v0", "v1", "v3")],
               keep("u", *[add(v, "late", "K") for v in ("v0", "v1", "v3")])],
        "v3": [add("v3", "2", "D"), add("v2", "1 + late", "R"), keep("a", add("v2", "late", "K"))]}.items()}
    step = f"{add('v0', '2', 'D')} AS v0, " + ", ".join(
        f"CASE WHEN gone THEN {add(q, '2', 'D')} ELSE {whole[q]} END AS {q}" for q in ("v1", "v2", "v3"))
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    cut = r"NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z')"
    return f"""WITH RECURSIVE {CRC_TABLE},
cd AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
  {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code
  FROM conversations, crct),
dm AS (SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role0 END AS role,
  CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
  unnest(range(CASE WHEN code = 0 THEN 0 WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM cd),
od AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dm),
ft AS (SELECT conv, turn, role, text, i, left(role, 1) AS a, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
  CASE WHEN {blank} THEN 'b' WHEN nth > 1 THEN 'd' WHEN {cut} THEN 't' ELSE 'f' END AS fault FROM od),
rw AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS late FROM ft),
st AS (SELECT conv, 0 AS k, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2,
    CAST(NULL AS VARCHAR) AS v3 FROM (SELECT DISTINCT conv FROM rw)
  UNION ALL
  SELECT c.conv, c.k + 1, {step}
  FROM ({closed.format('st')}) c JOIN rw ON rw.conv IS NOT DISTINCT FROM c.conv AND rw.i = c.k + 1),
ls AS (SELECT conv, max(k) AS k FROM st GROUP BY conv),
en AS (SELECT c.conv, least(c.v0, c.v3) AS v FROM ({closed.format('st')}) c JOIN ls
  ON ls.conv IS NOT DISTINCT FROM c.conv AND ls.k = c.k),
le AS (SELECT conv, unnest(string_split(substr(v, 10), '')) AS l, unnest(range(length(v) - 9)) AS p FROM en WHERE length(v) > 9),
lp AS (SELECT *, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER w AS m
  FROM le WINDOW w AS (PARTITION BY conv ORDER BY p)),
ln AS (SELECT lp.conv, lp.p, lp.l, lp.m, rw.a, rw.role, rw.text FROM lp LEFT JOIN rw
  ON lp.l <> 'I' AND rw.conv IS NOT DISTINCT FROM lp.conv AND rw.i = lp.i WHERE lp.l <> 'D'),
sy AS (SELECT conv, coalesce(bool_or(m = 1 AND l = 'K' AND a = 's'), false) AS sys FROM ln GROUP BY conv),
ot AS (SELECT ln.conv, string_agg(CASE WHEN l = 'K' THEN role WHEN (m - CAST(sys AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM ln JOIN sy ON sy.conv IS NOT DISTINCT FROM ln.conv GROUP BY ln.conv),
ag AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal FROM rw GROUP BY conv)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(v, 1, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(v, 10), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN ag ON ag.conv IS NOT DISTINCT FROM d.conv_id
LEFT JOIN en ON en.conv IS NOT DISTINCT FROM d.conv_id LEFT JOIN ot ON ot.conv IS NOT DISTINCT FROM d.conv_id"""


SQL = {"op11_conversation_repair": _sql()}
