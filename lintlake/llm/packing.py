"""Best-fit-decreasing packing of tokenised documents into sequences.

pieces()  tokenises whole texts in Arrow batches and cuts only what is longer than a sequence.
Plan      best fit decreasing over all documents at once. Documents of one length are alike, so bins are kept as
          runs of bins with equal free room, and a segment tree over the free room finds the tightest room that
          holds a length in logarithmic time; a run takes many documents of that length in one step. The plan needs
          only the number of documents of each length (at most `capacity` numbers) and is the one that placing
          document after document would give.
pack()    numbers the documents of each length in parallel and reads each one's bin and offset from the plan.

Defined results: null and empty texts are one end token; repeated rows are packed once each; a null id is an id like
any other; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.llm.common import cut, text_batches

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


#: Lower-case letters from ASCII to Latin Extended-A; for texts of these, ASCII and their capitals the words below are exact.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
#: What the vocabulary's own pre-tokenizer splits lower-cased text into, for such texts.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]|<\\|")


#: A text that a fast path must encode like the tokenizer before it is trusted.
PROBE = "It's THE 'tis don't we'll naïve ÉCOLE, œuvre ſtraße: 1234 a_b*** #&%$! end."


def byte_letters() -> dict[int, str]:
    """Code point -> its UTF-8 bytes as the letters that byte-level vocabularies write them in.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    other = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {point: "".join(letter[b] for b in chr(point).encode()) for point in range(33, 0x180)}


class WordTokenizer:
    """Token ids of texts, by remembered words where that is exact and by the tokenizer itself elsewhere.

    A text of OTHER's complement is lower-cased and split by WORDS, and each new word goes to the vocabulary's merges alone; this
    is used only if it gives the tokenizer's own ids for PROBE. Words that were not used for `remember` new ones are forgotten.
    """

    def __init__(self, path: str, end_id: int = 0, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, byte_letters()
        self.end = np.array([end_id], "<u4").tobytes()
        self.remember, self.young, self.old = remember, {}, {}
        self.fast = self._by_words(PROBE) == self._whole(PROBE)

    def _word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("I", [t.id for t in self.merges.tokenize(word.translate(self.letters))]).tobytes()
        if len(self.young) >= self.remember:
            self.young, self.old = {}, self.young
        self.young[word] = found
        return found

    def _by_words(self, text: str) -> bytes:
        words = WORDS.findall(text.lower())
        parts = list(map(self.young.get, words))
        if None in parts:
            for n, part in enumerate(parts):
                if part is None:
                    parts[n] = self._word(words[n])
        return b"".join(parts)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        found = self._by_words(text) if self.fast and not OTHER.search(text) else self._whole(text)
        return np.frombuffer(found + self.end, "<u4")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """docs with an array of (piece, start, length, ids_crc32)."""

    text_batches(docs.sparkSession)

    @F.pandas_udf(PIECES)
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = WordTokenizer(tokenizer_path, end_id)
        for texts in batches:
            out = []
            for text in texts:
                ids = tokenizer.ids(text)
                parts = [(at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
                out.append([{"piece": k, "start": at, "length": len(p), "ids_crc32": zlib.crc32(p.tobytes())} for k, (at, p) in enumerate(parts)])
            yield pd.Series(out)

    # marked so that Spark does not evaluate it a second time to filter out empty arrays before they are exploded
    return docs.withColumn(out_col, cut_up.asNondeterministic()(F.col(text_col)))


class _Rooms:
    """Segment tree over free room 0..capacity: which rooms have open bins, and the tightest that holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, start: int, count: int) -> None:
        if room and count:
            self.runs.setdefault(room, []).append((start, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def _mark(self, room: int, value: bool) -> None:
        at = room + self.size
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first, bin, per_bin, offset): document number n >= first of a length, up to the next row's first,
    goes into bin + (n - first) // per_bin at offset + length * ((n - first) % per_bin)."""
    rooms, rows, bins = _Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, start, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                start, count = rooms.take(room)
            per = room // length
            full = min(count, left // per)
            if full:
                rows.append((length, first, start, per, capacity - room))
                first, left = first + full * per, left - full * per
                rooms.put(room - per * length, start, full)
            if full < count:
                some = min(left, per)  # under per, or nothing: a bin that is not filled up
                if some and some < per:
                    rows.append((length, first, start + full, per, capacity - room))
                    first, left = first + some, 0
                    rooms.put(room - some * length, start + full, 1)
                    full += 1
                rooms.put(room, start + full, count - full)
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, rows_per_unit: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    known = pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer_path, capacity, end_id)
    flat = cut(known.select("id", F.inline("pieces")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(61)).cast("int")))
    counts = {r["length"]: r["n"] for r in flat.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    units = sum(counts.values()) // rows_per_unit + 1
    dealt = flat.withColumn("unit", F.pmod(F.xxhash64("id", "piece", "salt"), F.lit(units)))
    before = W.partitionBy("length").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "unit").agg(F.count(F.lit(1)).alias("n")).select("length", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = (
        dealt.withColumn("nth", F.row_number().over(W.partitionBy("length", "unit").orderBy("id", "piece")))
        .join(starts, ["length", "unit"])
        .withColumn("number", (F.col("base") + F.col("nth") - 1).cast("long"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        rows = steps.value[np.lexsort((steps.value[:, 1], steps.value[:, 0]))]
        at = np.searchsorted((rows[:, 0] << 48) + rows[:, 1], (length.to_numpy() << 48) + number.to_numpy(), "right") - 1
        _, first, start, per, offset = rows[at].T
        n = number.to_numpy() - first
        return pd.DataFrame({"sequence_id": start + n // per, "offset": offset + length.to_numpy() * (n % per)})

    return numbered.withColumn("place", place("length", "number")).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
