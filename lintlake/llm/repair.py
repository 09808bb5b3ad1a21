r"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation's rows, by turn, become the cheapest sequence whose role initials read `(s?(ua)+)?`. A node of the lattice is a number
of rows consumed and the last role given; an edge keeps a row (0), gives it another role (1), deletes it (2) or inserts an empty turn
(5). Blank rows and repeats of role and text must go; a truncated row that stays costs 5 more.

marked()     fault of each row, in columns of a fixed size: no text goes further.
pieces()     rows in order of conversation and turn over all tasks; each run of up to PIECE rows of one conversation is solved where it
             lies. A run that may be part of a longer conversation is solved from each role to each role, so that a conversation of any
             length is spread over tasks.
decisions()  joins a conversation's pieces by the same search over their ends, and places every kept row.
repaired()   the rows that stay, with their new roles and the inserted turns.

cheapest() is the search: a forward and a reverse heap advance in turn until their next keys exceed the best meeting; then every
crossing edge of that cost is looked at, and the smallest concatenated audit of all cheapest paths wins. Within one cost nodes are
settled by rows consumed, so a node's least audit is known when it is settled.

Defined results: null turns come first; rows of one turn are ordered by role, then by a digest of role and text; null roles and texts are
one space; the rows of a null id are one conversation; empty tables give empty results; columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import WORD, cut, small_batches

PIECE = 512
#: What comes after each state, with the role it gives: 0 nothing yet, 1 system, 2 user, 3 assistant.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

Node = tuple[int, int]
Edge = tuple[Node, int, str]


# ---------------------------------------------------------------- the search


def cheapest(sources: list[Node], targets: list[Node], out: Callable[[Node], list[Edge]], into: Callable[[Node], list[Edge]]) -> tuple[int, str] | None:
    """(cost, least audit) from any source to any target; None if there is no way. Edges of cost 0 must raise a node's first number."""
    sides, best = [], None
    for starts, edges, sign in ((sources, out, 1), (targets, into, -1)):
        sides.append((sign, edges, {n: 0 for n in starts}, {n: "" for n in starts}, [], set()))

    def settle(at: int, node: Node) -> None:
        nonlocal best
        sign, edges, cost, audit, heap, settled = sides[at]
        settled.add(node)
        other = sides[1 - at][2].get(node)
        if other is not None and (best is None or cost[node] + other < best):
            best = cost[node] + other
        for to, price, label in edges(node):
            total, said = cost[node] + price, audit[node] + label if sign > 0 else label + audit[node]
            known = cost.get(to)
            if known is None or total < known:
                cost[to], audit[to] = total, said
                heappush(heap, (total, sign * to[0], to))
            elif total == known and to not in settled and said < audit[to]:
                audit[to] = said

    for at, starts in ((0, sources), (1, targets)):
        for node in starts:
            settle(at, node)
    while sides[0][4] or sides[1][4]:
        ahead, behind = (heap[0][0] if heap else inf for heap in (sides[0][4], sides[1][4]))
        if best is not None and ahead + behind > best:
            break
        at = 0 if ahead <= behind else 1
        so_far, _, node = heappop(sides[at][4])
        if node not in sides[at][5] and so_far == sides[at][2][node]:
            settle(at, node)
    if best is None:
        return None
    (_, _, ahead, said, _, done), (_, _, behind, left, _, back) = sides
    met = [said[n] + left[n] for n in done & back if ahead[n] + behind[n] == best]
    for node in done:  # crossing edges
        met += [said[node] + label + left[to] for to, price, label in out(node) if to in back and ahead[node] + price + behind[to] == best]
    return best, min(met)


def lattice(codes: bytes) -> tuple[Callable, Callable]:
    """Edges out of and into a node; a code is 4 * (state that keeping the row gives, or 0) + 2 * must go + truncated."""
    n = len(codes)

    def step(row: int, state: int) -> list[tuple[int, int, str]]:
        """(state after, cost, label) of the edits of one row."""
        gives, must_go, more = codes[row] >> 2, codes[row] & 2, TRUNCATED * (codes[row] & 1)
        found = [(state, DELETE, "D")]
        if not must_go:
            if gives and (gives == NEXT[state] or (gives == 1 and state == 0)):
                found.append((gives, KEEP + more, "K"))
            found.append((NEXT[state], REROLE + more, "R"))
        return found

    def out(node: Node) -> list[Edge]:
        row, state = node
        edges = [((row, NEXT[state]), INSERT, "I")]
        return edges + [((row + 1, to), price, label) for to, price, label in step(row, state)] if row < n else edges

    def into(node: Node) -> list[Edge]:
        row, state = node
        edges = [((row, a), INSERT, "I") for a, b in NEXT.items() if b == state]
        if row:
            edges += [((row - 1, a), price, label) for a in NEXT for to, price, label in step(row - 1, a) if to == state]
        return edges

    return out, into


def solve(codes: bytes, sources: list[int], targets: list[int]) -> tuple[int, str] | None:
    out, into = lattice(codes)
    return cheapest([(0, s) for s in sources], [(len(codes), t) for t in targets], out, into)


def join_pieces(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """The same over pieces: an edge is the cheapest way through a piece from one state to another."""

    def out(node: Node) -> list[Edge]:
        k, state = node
        return [((k + 1, b), *found) for (a, b), found in tables[k].items() if a == state] if k < len(tables) else []

    def into(node: Node) -> list[Edge]:
        k, state = node
        return [((k - 1, a), *found) for (a, b), found in tables[k - 1].items() if b == state] if k else []

    return cheapest([(0, 0)], [(len(tables), t) for t in ENDS], out, into)


# ---------------------------------------------------------------- rows


def conversation_key(id_col: str) -> Column:
    """The id as a string that null has too."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))


def marked(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Written once: row, conv, turn, role, text, said (digest of role and text), initial, blank, open (ends without a mark), repeat (not the first of its conversation to say so)."""
    ordered = rows.select(
        conversation_key(id_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    kept = cut(ordered.select(F.monotonically_increasing_id().alias("row"), "*", said.alias("said"), F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(*".!?")).alias("open")))
    # rows that say the same differ in turn or not at all: the first turn, then the smallest row number
    first = kept.groupBy("conv", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(False).alias("again"))
    return kept.join(cut(first), "row", "left").select("*", F.coalesce("again", F.lit(True)).alias("repeat")).drop("again")


def _fault() -> Column:
    return F.when(F.col("blank"), "blank").when(F.col("repeat"), "duplicate").when(F.col("open"), "truncated")


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


PIECES = "conv string, part int, place int, n int, whole boolean, first string, last string, illegal long, rows array<long>, codes binary, ways array<struct<a: int, b: int, cost: long, audit: string>>"


def pieces(marks: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each run of a conversation's rows: its ends, illegal neighbours inside and cheapest ways through."""
    code = F.when(F.col("initial") == "s", 4).when(F.col("initial") == "u", 8).when(F.col("initial") == "a", 12).otherwise(0) + F.when(F.col("blank") | F.col("repeat"), 2).when(F.col("open"), 1).otherwise(0)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "said", "row"]
    rows = cut(marks.select("conv", "turn", "role", "said", "row", "initial", code.alias("code")))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "row", "initial", "code", F.spark_partition_id().alias("part"))

    def run(conv: str, part: int, place: int, got: list[tuple], whole: bool) -> dict:
        ids, initials, codes = zip(*got, strict=True)
        codes = bytes(codes)
        if whole:
            ways = [(0, -1, *solve(codes, [0], [*ENDS]))]
        else:
            ways = [(a, b, *found) for a in NEXT for b in NEXT if (found := solve(codes, [a], [b]))]
        illegal = sum(_illegal(a, b) for a, b in zip(initials, initials[1:], strict=False))
        return {"conv": conv, "part": part, "place": place, "n": len(ids), "whole": whole, "first": initials[0], "last": initials[-1], "illegal": illegal, "rows": list(ids), "codes": codes, "ways": [dict(zip(("a", "b", "cost", "audit"), w, strict=True)) for w in ways]}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, got, place, done = None, 0, [], 0, []
        fresh = False  # the run began inside this task, with another conversation before it
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for conv, row, initial, code in zip(batch["conv"], batch["row"], batch["initial"], batch["code"], strict=True):
                if conv != now or len(got) == piece:
                    if got:
                        done.append(run(now, part, place, got, fresh and conv != now))
                        place += 1
                    fresh = now is not None and conv != now
                    now, got = conv, []
                got.append((row, initial, code))
            if len(done) >= 256:
                yield pd.DataFrame(done)
                done = []
        if got:  # may go on in the next task
            done.append(run(now, part, place, got, False))
        if done:
            yield pd.DataFrame(done)

    return cut(sorted_rows.mapInPandas(work, PIECES))


ENDED = "conv string, cost long, audit string, illegal long, used array<struct<part: int, place: int, state: int, at: long, audit: string>>"


def decisions(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, cost, audit, illegal) for each conversation, and (conv, at, row, role, edit) for each turn of the repaired ones.

    row is null for an inserted turn, role is null where the row keeps its own.
    """

    def meet(conv: str, group: list[tuple]) -> tuple:
        tables = [{(w["a"], w["b"]): (w["cost"], w["audit"]) for w in p.ways} for p in group]
        if group[0].whole:
            ((cost, audit),) = tables[0].values()
        else:
            cost, audit = join_pieces(tables)
        illegal = sum(p.illegal for p in group) + sum(_illegal(a.last, b.first) for a, b in zip(group, group[1:], strict=False))
        used, start, state, at = [], 0, 0, 0
        for p in group:
            end, left = start, p.n
            while end < len(audit) and (left or audit[end] == "I"):  # inserts after a piece's last row are given to it
                left -= audit[end] != "I"
                end += 1
            said = audit[start:end]
            used.append({"part": p.part, "place": p.place, "state": state, "at": at, "audit": said})
            state, at, start = after(p.codes, said, state), at + len(said) - said.count("D"), end
        return conv, cost, audit, illegal, used

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group = None, []
        for batch in batches:
            done = []
            for p in batch.itertuples(index=False):
                if p.conv != now:
                    if group:
                        done.append(meet(now, group))
                    now, group = p.conv, []
                group.append(p)
            yield pd.DataFrame(done, columns=["conv", "cost", "audit", "illegal", "used"])
        if group:
            yield pd.DataFrame([meet(now, group)], columns=["conv", "cost", "audit", "illegal", "used"])

    sorted_parts = parts.drop("rows").repartition("conv").sortWithinPartitions("conv", "part", "place")
    ended = cut(sorted_parts.mapInPandas(work, ENDED))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            placed = []
            for conv, rows, codes, used in zip(batch["conv"], batch["rows"], batch["codes"], batch["used"], strict=True):
                placed += [(conv, used["at"] + k, *turn) for k, turn in enumerate(turns(rows.tolist(), codes, used["audit"], used["state"]))]
            yield pd.DataFrame(placed, columns=["conv", "at", "row", "role", "edit"]).astype({"row": "Int64"})

    chosen = ended.select("conv", F.explode("used").alias("used"))
    spread = parts.select("part", "place", "rows", "codes").join(chosen.select("conv", "used", "used.part", "used.place"), ["part", "place"]).select("conv", "rows", "codes", "used")
    return ended.drop("used"), spread.mapInPandas(place, "conv string, at long, row long, role string, edit string")


def turns(rows: list[int], codes: bytes, audit: str, state: int) -> Iterator[tuple[int | None, str | None, str]]:
    """(row, new role, edit) of the turns that a piece's audit leaves."""
    at = 0
    for edit in audit:
        if edit != "D":
            state = codes[at] >> 2 if edit == "K" else NEXT[state]
            yield (None if edit == "I" else rows[at]), (None if edit == "K" else ROLES[state]), edit
        at += edit != "I"


def after(codes: bytes, audit: str, state: int) -> int:
    """The state that a piece's audit leaves behind."""
    at = 0
    for edit in audit:
        if edit != "D":
            state = codes[at] >> 2 if edit == "K" else NEXT[state]
        at += edit != "I"
    return state


def repaired(marks: DataFrame, placed: DataFrame) -> DataFrame:
    """(conv, at, role, text, edit): the turns of the repaired conversations in order of at."""
    own = marks.select("row", F.col("role").alias("own"), F.col("text").alias("own_text"))
    return placed.join(own, "row", "left").select("conv", "at", F.coalesce("role", "own").alias("role"), F.coalesce("own_text", F.lit("")).alias("text"), "edit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text` of all turns, joined by newlines. A hash runs in order: a conversation passes through one task, which holds a batch of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["conv", "sha256"])
            done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["conv", "sha256"])

    with small_batches(turns.sparkSession):
        return cut(turns.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "role", "text").mapInArrow(work, "conv string, sha256 string"))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(report, turns). report: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation; turns as of repaired().

    conv is conversation_key() of the id.
    """
    marks = marked(rows, id_col, turn_col, role_col, text_col)
    ended, placed = decisions(pieces(marks, piece))
    fault = _fault()
    counts = marks.groupBy("conv").agg(
        *[F.count_if(fault == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
    )
    report = counts.join(ended, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, cut(repaired(marks, placed))


#: The digests from the rows, in DuckDB: the search is a recursion over rows that keeps the least (cost, audit) of each state.
REPAIR_SQL = r"""
WITH RECURSIVE
bit AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
z AS (SELECT o.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM o, bit),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS nth
      FROM z WHERE d <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), nth) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, nth) > 1 AS again,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS cut_off FROM m),
f AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN cut_off THEN 'truncated' ELSE '' END AS fault,
             CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS gives,
             left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM r),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (0, 3, 2), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2),
                              (2, 0, 2), (2, 1, 3), (2, 2, 2), (2, 3, 3), (3, 0, 3), (3, 1, 2), (3, 2, 3), (3, 3, 2)) AS x(q, added, q2)),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '000000000' AS best FROM n
  UNION ALL
  SELECT conv_id, i + 1, q, min(lpad(CAST(CAST(best[1:9] AS BIGINT) + price AS VARCHAR), 9, '0') || best[10:] || label)
  FROM (
    SELECT p.conv_id, p.i, e.q, p.best, 5 * added + e.price AS price, repeat('I', added) || e.label AS label
    FROM dp p JOIN ins USING (q) JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1,
    LATERAL (SELECT q2 AS q, 2 AS price, 'D' AS label
             UNION ALL SELECT gives, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K'
                       WHERE fault NOT IN ('blank', 'duplicate') AND ((gives = 1 AND q2 = 0) OR (gives = 2 AND q2 <> 2) OR (gives = 3 AND q2 = 2))
             UNION ALL SELECT CASE WHEN q2 = 2 THEN 3 ELSE 2 END, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R' WHERE fault NOT IN ('blank', 'duplicate')) AS e
  ) GROUP BY conv_id, i, q
),
done AS (SELECT dp.conv_id AS conv_id, min(lpad(CAST(CAST(best[1:9] AS BIGINT) + 5 * added AS VARCHAR), 9, '0') || best[10:] || repeat('I', added)) AS best
         FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins USING (q) WHERE q2 IN (0, 3) GROUP BY dp.conv_id),
e AS (SELECT conv_id, CAST(best[1:9] AS BIGINT) AS cost, best[10:] AS audit FROM done),
u AS (SELECT conv_id, p, audit[p] AS edit, p - length(replace(audit[1:p], 'I', '')) AS inserted, length(replace(audit[1:p], 'D', '')) AS given FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM e)),
w AS (SELECT u.*, f.role, f.text, f.gives FROM u LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.i = u.p - u.inserted AND u.edit <> 'I' WHERE u.edit <> 'D'),
h AS (SELECT conv_id, coalesce(max(CASE WHEN given = 1 AND edit = 'K' AND gives = 1 THEN 1 ELSE 0 END), 0) AS has_system FROM w GROUP BY conv_id),
y AS (SELECT w.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (given - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha
      FROM w JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY w.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM a.conv_id
"""
