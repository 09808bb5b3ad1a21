"""Lines with lexer state, and the tree of spans that braces make.

lex()         every line with its `code`: the same text with the insides of strings, templates, regular expressions and comments
              blanked out, so that a brace, a keyword or a name in it is one of the program; and the head of every brace.
segments()    the lines cut at their braces. A piece lies in one span, so what is found in it has that span's ancestors.
spans()       one row for each pair of braces: place, level, kind, name, parameters and what lies inside.

A lexer is a state machine, and its transitions compose: a file is cut into blocks of lines that are read by any task. Only files longer
than a block need a first pass, which reads each of their blocks from every state at once (runs that meet go on as one) and then hands
the states along. After that all blocks are read alike.

Nothing is joined by ranges. A brace's partner is the next brace of its level; sums over a subtree are differences of two running
sums; how deep a piece lies in spans of a kind is a running count of such spans opened and closed before it.

Lines: repo, path, line_no, text. Strings and regular expressions end with their line; an interpolation that goes on in the next line
keeps its braces' count up to three, and a template inside it ends with its line. A head keeps its last 400 characters. Null text is an
empty line; rows that repeat a line number are read one after another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lintlake.operators.scratch import deal, settle

FILE = ["repo", "path"]
BLOCK = 4096
#: Lines that a task of the lexer sorts and reads, on average.
TASK = 1 << 16
HEAD = 400
#: 0 code, 1-3 code inside `${` with so many braces open, 4-7 a block comment in those, 8 a template.
STATES = 9
TEMPLATE = 8
#: What ends a run of plain code.
MARK = re.compile(r"//|/\*|/|'(?:[^'\\]|\\.)*'?|\"(?:[^\"\\]|\\.)*\"?|[`{}]")
REGEX = re.compile(r"/(?![*/])((?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+)/[a-z]*")
BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+*%<>~^-]|\b(?:return|typeof|case|in|of))\s*$")
IN_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{)|\\$)*")
PUNCTUATION = re.compile(r"[;{}()]")


# ---------------------------------------------------------------- the lexer


def lex_line(text: str, state: int) -> tuple[str, int]:
    """The line's code and the state after it. The code has the text's length."""
    if state == 0 and not MARK.search(text):
        return text, 0
    out: list[str] = []
    nested = [state % 4] if 0 < state < 8 and state % 4 else []  # braces open in each interpolation round this place
    mode = "template" if state == TEMPLATE else "comment" if state >= 4 else "code"
    at, end = 0, len(text)
    while at < end:
        if mode == "comment":
            to = text.find("*/", at)
            out.append(" " * ((end if to < 0 else to + 2) - at))
            at = end if to < 0 else to + 2
            mode = "comment" if to < 0 else "code"
            continue
        if mode == "template":
            to = IN_TEMPLATE.match(text, at).end()
            out.append(" " * (to - at))
            at = to
            if at < end and text[at] == "`":
                out.append("`")
                at, mode = at + 1, "code"
            elif at < end:
                out.append("  ")
                at, mode = at + 2, "code"
                nested.append(1)
            continue
        found = MARK.search(text, at)
        if not found:
            out.append(text[at:])
            break
        out.append(text[at : found.start()])
        at, token = found.start(), found.group()
        if token == "//":
            out.append(" " * (end - at))
            break
        if token == "/*":
            out.append("  ")
            at, mode = at + 2, "comment"
        elif token == "/":
            literal = REGEX.match(text, at) if BEFORE_REGEX.search("".join(out)) else None
            size = literal.end() - at if literal else 1
            out.append(("/" + " " * len(literal[1]) + "/").ljust(size) if literal else "/")
            at += size
        elif token == "`":
            out.append("`")
            at, mode = at + 1, "template"
        elif token in "{}":
            nested[-1:] = [nested[-1] + (1 if token == "{" else -1)] if nested else []
            if nested and nested[-1] == 0:
                nested.pop()
                out.append(" ")
                mode = "template"
            else:
                out.append(token)
            at += 1
        else:
            closed = len(token) > 1 and token[-1] == token[0]
            out.append(token[0] + " " * (len(token) - 1 - closed) + token[0] * closed)
            at += len(token)
    outer = min(nested[0], 3) if nested else 0
    if mode == "template":
        return "".join(out), outer or TEMPLATE
    return "".join(out), outer + 4 * (mode == "comment")


class Reader:
    """Reads lines one after another; what it carries from one to the next is small and can be handed to another task."""

    def __init__(self, carried: str | None = None):
        self.state, self.tail, self.raw, self.depth, self.open = json.loads(carried)[:5] if carried else (0, "", "", 0, [])
        self.missed = 0  # closing braces whose partners lie before the first line

    def carried(self) -> str:
        return json.dumps([self.state, self.tail, self.raw, self.depth, self.open[-64:], self.missed])

    def line(self, text: str) -> tuple[str, list[str | None], list[str | None]]:
        """code, and for each brace what stands before it in its statement (null for a closing one), as code and as text."""
        code, self.state = lex_line(text, self.state)
        heads, raws, at = [], [], 0
        for found in PUNCTUATION.finditer(code):
            sign = found.group()
            if sign in "()":
                self.depth = max(0, self.depth + (1 if sign == "(" else -1))
                continue
            if sign == ";" and self.depth:
                continue
            before, raw = self.tail + code[at : found.start()], self.raw + text[at : found.start()]
            at = found.end()
            if sign == "{":
                heads.append(before[-HEAD:].strip())
                raws.append(raw[-HEAD:].strip())
                self.open.append((before[-HEAD:], raw[-HEAD:], self.depth))
            elif sign == "}":
                heads.append(None)
                raws.append(None)
            self.tail, self.raw, self.depth = "", "", 0
            self.missed += sign == "}" and not self.open
            if sign == "}" and self.open:  # what was begun in brackets goes on behind the brace
                before, raw, depth = self.open.pop()
                if depth:
                    self.tail, self.raw, self.depth = before + "{}", raw + "{}", depth
        self.tail, self.raw = (self.tail + code[at:] + " ")[-HEAD:], (self.raw + text[at:] + " ")[-HEAD:]
        return code, heads, raws


def block_ends(texts: list[str]) -> list[str]:
    """What is carried out of a block of lines, for each state at its start. A run that meets the first one ends like it."""
    first, seen = Reader(), []
    for text in texts:
        first.line(text)
        seen.append(first.carried())
    ends = [seen[-1]]
    for state in range(1, STATES):
        run = Reader(json.dumps([state, "", "", 0, [], 0]))
        for text, other in zip(texts, seen, strict=True):
            run.line(text)
            if run.state == json.loads(other)[0] and run.carried() == other:
                ends.append(seen[-1])
                break
        else:
            ends.append(run.carried())
    return ends


def _files(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of equal keys that follow one another, batch by batch."""
    for batch in batches:
        if len(batch):
            changes = (batch[keys] != batch[keys].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(changes, sort=False):
                yield tuple(rows[keys].iloc[0]), rows


def _starts(lines: DataFrame, n: int) -> DataFrame:
    """(repo, path, block, carried) for each block but the first of the files that have several; n is the number of lines."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, texts = None, []
        for key, rows in _files(batches, [*FILE, "block"]):
            if key != now and texts:
                yield pd.DataFrame([(*now, block_ends(texts))], columns=[*FILE, "block", "ends"])
                texts = []
            now = key
            texts += rows["text"].tolist()
        if texts:
            yield pd.DataFrame([(*now, block_ends(texts))], columns=[*FILE, "block", "ends"])

    def hand_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, carried = None, None
        for batch in batches:
            out = []
            for repo, path, block, ends in zip(batch["repo"], batch["path"], batch["block"], batch["ends"], strict=True):
                if (repo, path) != now:
                    now, carried = (repo, path), Reader().carried()
                state, _, _, _, before, _ = json.loads(carried)
                *rest, inside, missed = json.loads(ends[state])
                carried = json.dumps([*rest, (before[: max(0, len(before) - missed)] + inside)[-64:], 0])
                out.append((repo, path, block + 1, carried))
            yield pd.DataFrame(out, columns=[*FILE, "block", "carried"])

    long = deal(lines.where("block > 0").select(*FILE), n, *FILE, each=TASK).distinct()
    held = deal(lines, n, *FILE, each=TASK).join(long.hint("shuffle_hash"), FILE)  # a semi join would go below the deal
    placed = deal(held, n, *FILE, "block", each=TASK).sortWithinPartitions(*FILE, "block", "line_no")
    each = settle(placed.select(*FILE, "block", "text").mapInPandas(ends, "repo string, path string, block int, ends array<string>"))
    return deal(each, n, *FILE, each=TASK).sortWithinPartitions(*FILE, "block").mapInPandas(hand_on, "repo string, path string, block int, carried string")


def lex(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(repo, path, line_no, text, code, heads, raws): heads and raws have an entry for each brace of the code; written once.

    Blocks are dealt out as many lines to a task for every size of table. Where no file is longer than a block, the first pass is left out.
    """
    rows = lines.select(
        F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.col("line_no").cast("int").alias("line_no"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.floor((F.col("line_no") - 1) / block).cast("int"))
    n, last = rows.agg(F.count(F.lit(1)), F.max("block")).first()
    met = rows.withColumn("carried", F.lit(None).cast("string"))
    if last:
        met = met.unionByName(_starts(rows, n).select(*FILE, F.lit(-1).alias("line_no"), F.lit("").alias("text"), "block", "carried"))
    placed = deal(met, n, *FILE, "block", each=TASK).sortWithinPartitions(*FILE, "block", "line_no")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader = None, Reader()
        for batch in batches:
            out = []
            for repo, path, line, text, part, carried in zip(*(batch[c] for c in (*FILE, "line_no", "text", "block", "carried")), strict=True):
                if (repo, path, part) != now:
                    now, reader = (repo, path, part), Reader()
                if carried is not None:
                    reader = Reader(carried)
                else:
                    out.append((repo, path, line, text, *reader.line(text)))
            yield pd.DataFrame(out, columns=["repo", "path", "line_no", "text", "code", "heads", "raws"])

    return settle(placed.mapInPandas(read, "repo string, path string, line_no int, text string, code string, heads array<string>, raws array<string>"))


# ---------------------------------------------------------------- spans

#: Kind of a span by its head; the first that matches. Fixed patterns, read alike by both engines.
KINDS = [
    ("arrow", r"=>$"),
    ("class", r"\bclass\b[^(){};=]*$"),
    ("interface", r"\b(?:interface|namespace)\s+\w[^(){};=]*$"),
    ("enum", r"\benum\s+\w+$"),
    ("catch", r"^catch\b"),
    ("finally", r"^finally$"),
    ("try", r"\btry$"),
    ("else", r"\belse$"),
    ("function", r"\bfunction\b\s*\*?\s*\w*\s*(?:<[^>]*>)?\s*\(.*\)[^=]*$"),
    ("loop", r"(?:\b(?:for|while)\b\s*(?:await\s*)?\(.*\)|\bdo)$"),
    ("if", r"\bif\s*\(.*\)$"),
    ("switch", r"\bswitch\s*\(.*\)$"),
    ("names", r"\b(?:const|let|var|import|export)(?:\s+\w+\s*,|\s+type)?$"),
    ("object", r"(?:[=(,:\[?&|]|\breturn|\bdefault|\bin|\bof)$"),
    ("method", r"^[^=]*\w\s*(?:<[^>]*>)?\(.*\)\s*(?::[^=]*)?$"),
]
CALLED = r"([\w$.]+)\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*$"
PARAMETERS = r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)\s*(?::[^=(){}]*)?\s*(?:=>)?$"
ARROW_NAME = r"(\w+)\s*(?::[^=]*)?[:=]\s*(?:async\s*)?(?:\((?:[^()]|\([^()]*\))*\)|\w+)\s*(?::[^=]*)?=>$"
METHOD_NAME = r"([#\w$]+)\s*(?:<[^>]*>)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^=]*)?$"
#: What is counted in each span: name, pattern. Decisions are what cyclomatic complexity counts.
COUNTED = {
    "decisions": r"(?:^|[^.\w$])(?:if|for|while|case|catch)\b|&&|\|\||\s\?\s",
    "joins": r"&&|\|\|",
    "awaits": r"\bawait\b",
    "promises": r"\bPromise\.",
    "exits": r"\b(?:break|return|throw)\b",
    "throws": r"\bthrow\b",
    "returns": r"\breturn\b",
    "branches": r"\b(?:if|switch)\b",
    "defaults": r"\bdefault\s*:",
    "expects": r"\bexpect\s*\(",
    "asserts": r"\b(?:expect|assert|should|verify|check)\s*[(.]",
    "resources": r"openSync|createReadStream|createWriteStream|readFileSync|writeFileSync|createConnection|connect\s*\(|beginTransaction|acquire|pool\.query|fs\.open",
    "calls": r"\w\s*\(|\bnew\s|\bawait\b|\w\[",
    "tests": r"\b(?:it|test)\s*\(",
    "console": r"\bconsole\.(?:log|error|warn|info|debug)\s*\(",
    "statements": r";",
    "narrowing": r"\binstanceof\b|\btypeof\b|\bisError\b",
    "signs": r"\S",
}
#: What adds to cognitive complexity, 1 and a point for each branch round it.
BRANCHES = r"(?:^|[^.\w$])(?:if|for|while|switch|catch)\b|\s\?\s"
#: Opening braces that are counted in each span: name, condition on the span that opens.
OPENED = {
    "methods": "kind = 'method'",
    "test_spans": "called IN ('it', 'test')",
    "error_tests": r"called IN ('it', 'test') AND rlike(raw, '(?i)\\b(?:error|fail|throw|reject|invalid|null|undefined|edge|boundary|empty|negative|overflow|timeout|exception|wrong|bad|missing)')",
}
#: How deep a piece lies in spans of a sort: name, condition on a span.
DEPTHS = {
    "loops": "kind = 'loop'",
    "lists": "called_last IN ('forEach', 'map', 'reduce', 'flatMap')",
    "filters": "called_last = 'filter'",
    "counted_loops": "kind = 'loop' AND NOT rlike(head, 'do$|for\\\\s+await')",
    "functions": "kind IN ('function', 'method', 'arrow')",
    "async_functions": "is_async AND kind IN ('function', 'method', 'arrow')",
    "classes": "kind = 'class'",
    "tries": "kind = 'try'",
    "handlers": "kind IN ('try', 'catch', 'finally')",
    "nested": "kind IN ('if', 'loop', 'switch', 'try')",
    "weights": "kind IN ('if', 'else', 'loop', 'switch', 'catch')",
    "timers": "called_last IN ('setTimeout', 'setInterval')",
    "in_tests": "called IN ('it', 'test')",
    "callbacks": "called <> '' AND (kind = 'arrow' OR kind = 'function')",
    "scrolls": "contains(raw, 'scroll') AND called_last = 'addEventListener'",
}
PLACE = ["line_no", "part"]


def _first(rules: list[tuple[str, str]], column: str, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.col(column).rlike(pattern), name).otherwise(out)
    return out


def segments(lexed: DataFrame) -> DataFrame:
    """(repo, path, line_no, part, code, brace, head, raw): the pieces between braces, each with the brace that ends it, if one does."""
    pieces = lexed.select(*FILE, "line_no", "heads", "raws", F.regexp_extract_all("code", F.lit("([{}])"), F.lit(1)).alias("braces"), F.posexplode(F.split("code", "[{}]", -1)).alias("part", "code"))
    return pieces.select(*FILE, "line_no", "part", "code", F.get("braces", F.col("part")).alias("brace"), F.get("heads", F.col("part")).alias("head"), F.get("raws", F.col("part")).alias("raw"))


def described(pieces: DataFrame) -> DataFrame:
    """Opening braces' kind, name, call that they are an argument of, parameters; null for others."""
    opens = F.col("brace") == "{"
    called = F.when(F.col("head").rlike(r"(?:=>|\bfunction\b.*)$"), F.regexp_extract("head", CALLED, 1)).otherwise("")
    kind = _first(KINDS, "head", "block")
    inside = F.regexp_extract("head", PARAMETERS, 1)
    single = F.regexp_extract("head", r"(?:^|[(,=:\s])(\w+)\s*=>$", 1)
    flat = F.regexp_replace(F.regexp_replace(F.when((F.col("kind") == "arrow") & (inside == "") & (single != ""), single).otherwise(inside), r"\([^()]*\)", ""), r"<[^<>]*>|\[[^\[\]]*\]", "")
    name = (
        F.when(F.col("kind") == "function", F.regexp_extract("head", r"\bfunction\b\s*\*?\s*(\w+)", 1))
        .when(F.col("kind") == "arrow", F.regexp_extract("head", ARROW_NAME, 1))
        .when(F.col("kind").isin("class", "interface", "enum"), F.regexp_extract("head", r"\b(?:class|interface|namespace|enum)\s+(\w+)", 1))
        .when(F.col("kind") == "method", F.regexp_extract("head", METHOD_NAME, 1))
    )
    named = F.col("kind").isin("function", "method", "arrow")
    return (
        pieces.withColumn("kind", F.when(opens, kind))
        .withColumn("called", F.when(opens, called))
        .withColumn("called_last", F.when(opens, F.substring_index("called", ".", -1)))
        .withColumn("name", F.when(opens, F.coalesce(name, F.lit(""))))
        .withColumn("is_async", F.when(opens, F.col("head").rlike(r"\basync\b")))
        .withColumn("parameters", F.when(opens & named, F.filter(F.transform(F.split(flat, ","), lambda p: F.trim(p)), lambda p: p != "")))
    )


def tree(lexed: DataFrame, counts: bool = True) -> DataFrame:
    """The segments with level and running counts (without those of COUNTED and OPENED if counts is False); written once.

    Columns of DEPTHS say in how many open spans of that sort the segment lies; level, how many spans of any kind. Lines are dealt out by
    file, as many to a task for every size of table; a brace hands its partner the sorts of its span as bits, not its texts.
    """
    step = F.when(F.col("brace") == "{", 1).when(F.col("brace") == "}", -1).otherwise(0)
    before = W.partitionBy(*FILE).orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1)
    until = W.partitionBy(*FILE).orderBy(*PLACE).rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = deal(lexed.select(*FILE, "line_no", "code", "heads", "raws"), lexed.count(), *FILE)
    branches = F.regexp_count("code", F.lit(BRANCHES))
    # counted where the parameters are: one projection of small methods, which the JVM compiles; fused into the sorts below they make one that it does not
    numbers = {n: F.regexp_count("code", F.lit(p)) for n, p in COUNTED.items()} | {"branching": branches} if counts else {}
    pieces = described(segments(lines)).select("*", *[c.alias(f"n_{n}") for n, c in numbers.items()]).withColumn("level", F.coalesce(F.sum(step).over(before), F.lit(0)))
    # a brace and its partner are neighbours among the braces of one level; segments that end a line keep a level of their own
    pair = F.when(F.col("brace") == "{", F.col("level") + 1).when(F.col("brace") == "}", F.col("level"))
    partner = W.partitionBy(*FILE, "pair", F.col("brace").isNull()).orderBy(*PLACE)
    sorts = sum((F.when(F.expr(test), 1 << k).otherwise(0) for k, test in enumerate(DEPTHS.values())), F.lit(0))
    marked = pieces.withColumn("pair", pair).withColumn("sorts", F.when(F.col("brace") == "{", sorts).otherwise(0))
    closing = F.when((F.col("brace") == "}") & (F.lag("brace").over(partner) == "{"), F.lag("sorts").over(partner)).otherwise(0)
    matched = marked.withColumn("closes", closing)
    counted = [F.sum(f"n_{n}").over(until).cast("long").alias(f"all_{n}") for n in numbers]
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(1)
    turns = [F.coalesce(F.sum(bit("sorts", k) - bit("closes", k)).over(before), F.lit(0)).cast("int").alias(name) for k, name in enumerate(DEPTHS)]
    if not counts:
        return settle(matched.select("*", *turns).drop("sorts", "closes"))
    more = {"weight": F.col("n_branching") * (F.col("weights") + 1)} | {n: F.when(F.col("brace") == "{", F.expr(test).cast("int")).otherwise(0) for n, test in OPENED.items()}
    return settle(matched.select("*", *counted, *turns).select("*", *[F.sum(c).over(until).cast("long").alias(f"all_{n}") for n, c in more.items()]).drop("sorts", "closes", *[f"n_{n}" for n in numbers]))


def spans(nodes: DataFrame, counts: bool = True) -> DataFrame:
    """One row for each opening brace of tree(): its place and its partner's, level, kind and names, depths at it, and counts inside (unless counts is False).

    A brace without a partner ends nowhere: its end and counts are null. next_kind and after_kind are the kinds of the next two spans of its level.
    """
    braces = deal(nodes.where("brace IS NOT NULL"), nodes.count(), *FILE, each=1 << 17)
    w = W.partitionBy(*FILE, "pair").orderBy(*PLACE)
    numbers = [*COUNTED, "branching", "weight", *OPENED] if counts else []
    ahead = F.lead(F.struct("brace", *PLACE, *[f"all_{n}" for n in numbers])).over(w)
    kinds = [F.lead("kind", 2).over(w).alias("next_kind"), F.lead("kind", 4).over(w).alias("after_kind")]
    seen = braces.select("*", ahead.alias("end"), *kinds).where("brace = '{'").withColumn("end", F.when(F.col("end.brace") == "}", F.col("end")))
    inside = [(F.col(f"end.all_{n}") - F.col(f"all_{n}")).alias(n) for n in numbers]
    return seen.select(
        *FILE, F.col("line_no").alias("start"), F.col("part").alias("start_part"), F.col("end.line_no").alias("end"), F.col("end.part").alias("end_part"),
        "level", "kind", "name", "called", "called_last", "is_async", "parameters", "head", "raw", "next_kind", "after_kind",
        *[F.col(d).alias(f"at_{d}") for d in DEPTHS], *inside,
    )


def cognitive() -> Column:
    """Branches inside a span, each with what it is nested in there, and a point for each logical join."""
    return F.col("weight") - F.col("at_weights") * F.col("branching") + F.col("joins")


def functions(nodes: DataFrame) -> DataFrame:
    """Functions, methods and arrow functions with a body: repo, path, kind, name, start, end, parameters, complexity, cognitive.

    complexity is 1 and a point for each decision inside; cognitive counts nesting from the function's own body.
    """
    bodies = spans(nodes).where("kind IN ('function', 'method', 'arrow') AND end IS NOT NULL")
    return bodies.select(*FILE, "kind", "name", "start", "end", F.size("parameters").alias("parameters"), (F.col("decisions") + 1).alias("complexity"), cognitive().alias("cognitive"))
