"""Substring deduplication by hashed units.

Units are the lines of a text, and the sentences of a line that has several; sentences of fewer than MIN_WORDS
words that follow one another are one unit. A unit is normalised (lower case, blanks collapsed, outer
punctuation dropped) and digested to 128 bits; those of fewer than MIN_WORDS words are left alone, as they meet
by chance. Digests are grouped over all documents, the earliest occurrence by (doc_id, start, end) is kept, and
every other one is a repeat. Repeats that follow one another in a text, with no other unit between them, are a run; runs
of at least RUN words are removed, with their units' offsets in the original text retained. Shorter ones, single
lines that many clean documents have, stay unless `run` is lowered.

Units are cut once and written. Those whose half digest occurs once go first; the rest is written, grouped by whole
digests with sums on the map side, and joined with the groups again, all by plain shuffles that can be split, so a line that a third of all documents has is no single
task's. Offsets are code points, ends exclusive. Defined results: a null or empty text has no units; of repeated rows
all but one are removed unit by unit, for an occurrence is that of a row; rows without a doc_id come last; other columns
are ignored; an empty table gives none.

repeated_units leaves short lines, runs inside a longer sentence and scripts without blanks. repeated_passages adds
two kinds of pieces for them. Lines: every whole line that isn't blank, whatever its length. Windows: SPAN tokens in
a row, across lines and sentences, where a token is a word or, in scripts without blanks, a character; of each
AHEAD windows in a row the one of least hash is taken, so that every shared run of SPAN + AHEAD - 1 = 51 tokens has
a window that is the same on both sides, and those taken within a run leave no gap between them. Repeated pieces of any
kind that overlap or follow one another without a token between them are a run there, and those of runs of at least
`run` tokens are removed: with 1 every repeated line is, with RUN short lines that clean documents have stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch, slices, text_chunks
from fidelis.llm.hashing import U, _power, mix

MIN_WORDS, RUN = 6, 15
PIECES = "row long, doc_id long, start long, end long, words int, h1 long, h2 long, kind int, nth int"
_NAMES = ["row", "doc_id", "start", "end", "words", "h1", "h2", "kind", "nth"]
KINDS = ("unit", "line", "window")
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_LINE = re.compile(r"[^\n]+")
_END = re.compile(r"[.!?]+(?=\s)")
_OUTER = " \t\r\f\v.,;:!?\"'()[]{}<>|*#%&$-"

SPAN = AHEAD = 26
#: Thai, Lao, Myanmar, Khmer, kana, Han and their extensions: each character is a token.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF))
_BLANK, _ALONE = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
_BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True
for _a, _b in _UNSPACED:
    _ALONE[_a : _b + 1] = True


def normalise(part: str) -> str:
    return " ".join(part.lower().strip(_OUTER).split())


def units(text: str, least: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit) of the units of each line that have enough words, without outer blanks."""
    for line in _LINE.finditer(text):
        body, at, run = line[0], 0, None
        found: list[tuple[int, int]] = []
        for cut in [m.end() for m in _END.finditer(body)] + [len(body)]:
            part = body[at:cut]
            if kept := part.strip():
                start = line.start() + at + part.index(kept[0])
                end = start + len(kept)
                if normalise(kept).count(" ") + 1 >= least:
                    found += [run, (start, end)] if run else [(start, end)]
                    run = None
                else:
                    run = (run[0] if run else start, end)
            at = cut
        for start, end in [*found, run] if run else found:
            unit = normalise(text[start:end])
            if unit.count(" ") + 1 >= least:
                yield start, end, unit


def _batch(part: pa.RecordBatch, where: np.ndarray, digests: np.ndarray, kind: int, nth: np.ndarray | None = None) -> pa.RecordBatch:
    """Pieces: where has the row's number in the part, start, end and words of each."""
    at, n = pa.array(where[:, 0]), len(where)
    numbers = [pa.array(np.ascontiguousarray(x)) for x in (where[:, 1], where[:, 2], where[:, 3].astype(np.int32), digests[:, 0].astype(np.int64), digests[:, 1].astype(np.int64))]
    order = pa.array(np.zeros(n, np.int32) if nth is None else nth)
    return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *numbers, pa.array(np.full(n, kind, np.int32)), order], _NAMES)


def _hashed(part: pa.RecordBatch, found: Iterator[tuple[int, int, int, str]], kind: int, tokens: Tokens | None = None, at: int = 0) -> pa.RecordBatch:
    """Pieces of (row's number, start, end, normalised text), with their place among their row's.

    Given the tokens of the texts from row `at` on, the place is that of the first token, and words are tokens.
    """
    where, digests, nth, last = [], [], [], (-1, -1)
    salt = KINDS[kind].encode() if kind else b""
    for i, start, end, piece in found:
        last = (i, last[1] + 1 if last[0] == i else 0)
        nth.append(last[1])
        where.append((i, start, end, piece.count(" ") + 1))
        digests.append(md5(salt + piece.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
    h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)
    held, order = np.array(where, np.int64).reshape(-1, 4), np.array(nth, np.int32)
    if tokens:
        order, held[:, 3] = _places(tokens, held[:, 0] - at, held[:, 1], held[:, 2])
    return _batch(part, held, h, kind, order)


def _pieces(batches: Iterator[pa.RecordBatch], least: int, passages: bool) -> Iterator[pa.RecordBatch]:
    """Units and, for passages, lines and windows. Only those of one kind have digests in common."""
    for part in slices(batches):
        texts = [t or "" for t in part.column(2).to_pylist()]
        if not passages:
            yield _hashed(part, ((i, *u) for i, t in enumerate(texts) for u in units(t, least)), 0)
            continue
        for a, b in text_chunks(texts, 1 << 17):
            tokens = _tokens(texts[a:b])
            for kind, cut in enumerate((units, lines)):
                yield _hashed(part, ((i, *u) for i in range(a, b) for u in cut(texts[i], least)), kind, tokens, a)
            doc, start, end, h1, h2 = windows(texts[a:b], tokens)
            where, digests = np.column_stack((doc + a, start, end, np.full(len(doc), SPAN))), np.column_stack((h1.view(np.int64), h2.view(np.int64)))
            yield _batch(part, where, digests, 2, _places(tokens, doc, start, end)[0])


def _repeats(rows: DataFrame, scratch: Scratch, least: int, passages: bool) -> DataFrame:
    """Occurrences past the first of each digest, of rows (row, doc_id, text), with the first one's place, and its end, own_end, if it is of the same row."""
    pieces = scratch.write(rows.mapInArrow(lambda it: _pieces(it, least, passages), PIECES), "pieces")
    # Most pieces occur once: those go by half a digest and a count, before anything wider is shuffled.
    twice = pieces.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    found = scratch.write(pieces.join(twice, "h1", "left_semi").select(*_NAMES), "twice")
    scratch.drop(pieces)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "end", "row")
    shared = scratch.write(found.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("occurrences")).where("occurrences > 1"), "shared")
    again = found.join(shared, ["h1", "h2"]).where("row <> first.row or start <> first.start")
    own_end = F.when(F.col("row") == F.col("first.row"), F.col("first.end")).alias("own_end")
    # Digests stay numbers, and the first one's place is flat, until they have been shuffled to their rows.
    return again.select(*_NAMES, F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), own_end, "occurrences")


def _digest() -> Column:
    return F.lower(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))).alias("digest")


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with numbers; what is made of them is written at once, so that they are drawn once."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _units_of(rows: DataFrame, scratch: Scratch, least: int, run: int) -> DataFrame:
    found = _repeats(rows, scratch, least, False)
    island = F.col("nth") - F.row_number().over(Window.partitionBy("row").orderBy("nth"))
    found = found.withColumn("island", island)
    return found.withColumn("run_words", F.sum("words").over(Window.partitionBy("row", "island"))).where(F.col("run_words") >= run)


def repeated_units(docs: DataFrame, least: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """Every occurrence to remove: doc_id, start, end, words, digest, the kept one's first_doc_id and first_start, occurrences, and the words of its run."""
    found = _units_of(_numbered(docs), Scratch(docs.sparkSession, "units"), least, run)
    return found.select("doc_id", "start", "end", "words", _digest(), "first_doc_id", "first_start", "occurrences", "run_words")


def lines(text: str, least: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, line in lower case with blanks collapsed) of the lines that aren't blank and aren't one unit as they are."""
    for line in _LINE.finditer(text):
        if not (kept := line[0].strip()):
            continue
        start = line.start() + line[0].index(kept[0])
        if _END.search(kept) or normalise(kept).count(" ") + 1 < least:
            yield start, start + len(kept), " ".join(kept.lower().split())


def _lower(text: str) -> str:
    """In lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _tokens(texts: list[str]) -> Tokens:
    """Code points of the texts in lower case, each with a line break after it; the tokens' starts and ends; the texts' lengths with the break."""
    each = np.array([len(t) + 1 for t in texts], np.int64)
    chars = np.frombuffer("".join(f"{_lower(t)}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    full, alone = ~_BLANK[chars], _ALONE[chars]
    apart = np.concatenate(([True], ~full[:-1] | ~full[1:] | alone[:-1] | alone[1:], [True]))
    return chars, np.flatnonzero(full & apart[:-1]), np.flatnonzero(full & apart[1:]) + 1, each


def _places(tokens: Tokens, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each piece's first token in its text, and how many it has."""
    _, starts, _, each = tokens
    text = np.cumsum(each) - each
    first, last = (np.searchsorted(starts, text[doc] + x) for x in (start, end))
    return (first - np.searchsorted(starts, text)[doc]).astype(np.int32), last - first


def windows(texts: list[str], tokens: Tokens | None = None) -> tuple[np.ndarray, ...]:
    """Text number, start, end and two hashes of the windows taken."""
    chars, starts, ends, each = tokens or _tokens(texts)
    n = len(starts) - SPAN + 1
    if n < AHEAD:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    sums = np.concatenate(([U(0)], np.cumsum(mix(chars.astype(np.uint64)) * _power(len(chars), "up"), dtype=np.uint64)))
    words = mix((sums[ends] - sums[starts]) * _power(len(chars), "down")[starts], 1)
    of = np.repeat(np.arange(len(texts)), each)[starts]

    def hashed(salt: int) -> np.ndarray:
        total = np.concatenate(([U(0)], np.cumsum(mix(words, salt) * _power(len(words), "up"), dtype=np.uint64)))
        return mix((total[SPAN:] - total[:-SPAN]) * _power(len(words), "down")[:n], salt)

    h = hashed(41)
    whole = np.flatnonzero(of[: n - AHEAD + 1] == of[SPAN + AHEAD - 2 :])
    at = np.unique(whole + np.lib.stride_tricks.sliding_window_view(h, AHEAD).argmin(axis=1)[whole])
    # Of equal windows in a row no more than keep one in each AHEAD.
    same = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (of[at[1:]] == of[at[:-1]])) + 1
    drop, run = np.zeros(len(at), bool), set(same.tolist())
    last = -1
    for i in same.tolist():
        if not drop[i - 1]:
            last = i - 1
        if i + 1 in run and at[i + 1] - at[last] <= AHEAD:
            drop[i] = True
    at = at[~drop]
    first = np.cumsum(each) - each
    doc = of[at]
    return doc, starts[at] - first[doc], ends[at + SPAN - 1] - first[doc], h[at], hashed(42)[at]


def _passages_of(rows: DataFrame, scratch: Scratch, least: int, run: int) -> DataFrame:
    """What an occurrence has in common with the kept one of its own row stays."""
    found = _repeats(rows, scratch, least, True)
    # A run's tokens are those that its pieces cover; a piece that starts past all before it opens one.
    order = Window.partitionBy("row").orderBy("nth", "words", "start", "end", "kind")
    until = F.col("nth") + F.col("words")
    covered = F.coalesce(F.max(until).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    found = found.withColumn("covered", covered).withColumn("island", F.sum((F.col("nth") > F.col("covered")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.greatest(F.lit(0), until - F.greatest("nth", "covered"))
    found = found.withColumn("run_words", F.sum(own).over(Window.partitionBy("row", "island"))).where(F.col("run_words") >= run)
    return found.withColumn("start", F.greatest("start", "own_end")).where("start < end")


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, run: int = 1) -> DataFrame:
    """Every occurrence of a unit, line or window to remove, as repeated_units has them, with its kind; words are tokens."""
    found = _passages_of(_numbered(docs), Scratch(docs.sparkSession, "passages"), least, run)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.select("doc_id", "start", "end", "words", kind.alias("kind"), _digest(), "first_doc_id", "first_start", "occurrences", "run_words")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pieces, at = [], 0
            for span in sorted(spans or [], key=lambda s: (s["start"], s["end"])):
                pieces.append(text[at : max(at, span["start"])])
                at = max(at, span["end"])
            out.append(None if text is None else "".join(pieces) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], ["doc_id", "text", "removed"])


def remove_units(docs: DataFrame, least: int = MIN_WORDS, run: int | None = None, passages: bool = False) -> DataFrame:
    """doc_id, the text without its repeats, and these with their original offsets, for each row of docs; run: RUN for units, else 1."""
    scratch = Scratch(docs.sparkSession, "removal")
    rows = scratch.write(_numbered(docs), "rows")
    found = _passages_of(rows, scratch, least, run or 1) if passages else _units_of(rows, scratch, least, RUN if run is None else run)
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    joined = rows.join(spans, "row", "left")
    return joined.select("doc_id", "text", "removed").mapInArrow(_without, "doc_id long, text string, removed array<struct<start:long,end:long>>")
