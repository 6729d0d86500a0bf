"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams of lower-cased letters, hashed to BINS, for every language over all its labelled rows.
A model has MOST languages at most, a documented parameter: those with most labelled rows, ties by name. So what a task
and the driver hold is bounded, whatever a dirty column has for labels: MOST times BINS numbers. A document is a mixture: each word comes from one language, with the document's proportions. These are
estimated by expectation-maximisation; the language set is grown in order of proportion for as long as the
log-likelihood gains more than PENALTY * log(1 + words) for each language added.

Defined results: `und`, with score 0, for a null text, one without a letter, and any text where nothing was
learned; a repeated row is predicted again; other columns are kept by predict, which refuses a table that has a column
of the names it adds; an empty table gives none. Rows without a language or text teach nothing. Equal likelihoods go to
the language whose name comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm.common import free_names, slices, text_chunks

BITS = 15
BINS = 1 << BITS
MOST = 256
#: Characters whose trigrams are summed at once; a piece of text ends at a blank, so only a longer word makes it longer.
PIECE = 1 << 18
PENALTY, ROUNDS, SMOOTH, FAINT = 4.0, 6, 0.5, 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes that belong to words: ASCII letters, and all bytes of other scripts; the rest become a blank.
_KEEP = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)
PREDICTION = ("lang_pred", "score", "languages")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blanked bytes, a hash bin for the trigram that starts at each byte but the last two, and the texts' starts."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = _KEEP[np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8)]
    wide = buf.astype(np.uint32)
    code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    bins = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return buf, bins, np.cumsum([0, *(len(r) + 2 for r in raw)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, 2000):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            held = sums.setdefault(lang, np.zeros(BINS, np.int64))
            for a, b in text_chunks(own):
                held += np.bincount(_grams(own[a:b])[1], minlength=BINS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bin", "n"])


class LanguageModel:
    """Languages in order, and for each the log-probabilities of the bins."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        if not self.languages:
            return [(UNKNOWN, 0.0, "")] * len(texts)
        got = [self._words(t) for t in texts] if max(map(len, (t for t in texts if t)), default=0) > PIECE else [self._words_of(texts)]
        word, size = (np.concatenate(x) for x in zip(*got, strict=True))
        some = np.flatnonzero(size)
        out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
        if len(some):
            share, chosen = self._mixtures(word, size[some])
            best = np.where(chosen, share, -1).argmax(axis=1)
            for row, d in enumerate(some.tolist()):
                text = texts[d]
                if text and _LETTER.search(text):
                    names = sorted(((-float(share[row, x]), self.languages[x]) for x in np.flatnonzero(chosen[row])))
                    out[d] = (self.languages[best[row]], min(1.0, max(0.0, float(share[row, best[row]]))), ",".join(f"{n}:{-s:.3f}" for s, n in names))
        return out

    def _words(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """_words_of one text, by pieces that end at blanks."""
        parts, at, text = [], 0, text or ""
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                after = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                end = cut + 1 if cut >= at else min(after, default=len(text) - 1) + 1
            parts.append(self._words_of([text[at:end]])[0])
            at = end
        word = np.concatenate(parts) if parts else np.empty((0, len(self.languages)))
        return word, np.array([len(word)])

    def _words_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of the words in each language, one text after another, and the texts' numbers of words."""
        buf, bins, doc_at = _grams(texts)
        blank = buf == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        # A word's trigrams: those that start at the blank before it up to the one that ends with the blank after.
        word = np.empty((len(starts), len(self.languages)), np.float64)
        for i in range(len(self.languages)):
            sums = np.concatenate(([0.0], np.cumsum(self.table[i][bins], dtype=np.float64)))
            word[:, i] = sums[ends - 1] - sums[starts - 1]
        edge = np.searchsorted(starts, doc_at[:-1] + 1)
        return word, np.diff(np.append(edge, len(starts)))

    @staticmethod
    def _em(like: np.ndarray, first: np.ndarray, size: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Proportions after ROUNDS of expectation-maximisation; like: each word's likelihoods, its largest 1."""
        for _ in range(ROUNDS):
            got = like * np.repeat(share, size, axis=0)
            got /= np.maximum(got.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(got, first, axis=0) / size[:, None]
        return share

    def _mixtures(self, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions in the chosen language set of each document, and the set."""
        first = np.cumsum(size) - size
        top = word.max(axis=1, keepdims=True)
        like = np.exp(word - top)
        full = self._em(like, first, size, np.full((len(size), word.shape[1]), 1.0 / word.shape[1]))
        alone = np.add.reduceat(word, first, axis=0)
        best = alone.argmax(axis=1)
        chosen = np.zeros(full.shape, bool)
        chosen[np.arange(len(size)), best] = True
        share, fit = full.copy(), alone.max(axis=1)
        order = np.argsort(-np.where(chosen, 2, full), axis=1, kind="stable")
        todo = np.arange(len(size))
        for k in range(1, word.shape[1]):
            todo = todo[full[todo, order[todo, k]] >= FAINT]
            if not len(todo):
                break
            rows = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in todo])
            n = size[todo]
            at = np.cumsum(n) - n
            allowed = np.zeros((len(todo), word.shape[1]))
            np.put_along_axis(allowed, order[todo, : k + 1], 1.0, axis=1)
            start = full[todo] * allowed + 1e-9 * allowed
            got = self._em(like[rows], at, n, start / start.sum(axis=1, keepdims=True))
            mixed = np.log(np.maximum((like[rows] * np.repeat(got, n, axis=0)).sum(axis=1), 1e-300)) + top[rows, 0]
            gain = np.add.reduceat(mixed, at) - fit[todo]
            better = gain > PENALTY * np.log1p(n)
            todo, got, gain = todo[better], got[better], gain[better]
            share[todo], fit[todo] = got, fit[todo] + gain
            chosen[todo, order[todo, k]] = True
        return share, chosen


def learn(rows: DataFrame, most: int = MOST) -> LanguageModel:
    """The model of all rows (lang, text) that have both, of the `most` languages with most rows."""
    rows = rows.where("lang is not null and text is not null").select("lang", "text")
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    languages = sorted(r["lang"] for r in common.collect())
    if not languages:
        return LanguageModel([], np.empty((0, BINS), np.float32))
    counts = rows.where(F.col("lang").isin(languages)).mapInArrow(_count, "lang string, bin int, n long")
    got = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), BINS), SMOOTH)
    table[np.searchsorted(languages, got["lang"].to_numpy()) if len(got) else [], got["bin"].to_numpy()] += got["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast, text_at: int, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(text_at).to_pylist()
        for a, b in text_chunks(texts, PIECE):
            got = list(zip(*model.value.predict(texts[a:b]), strict=True))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.string())], [*part.schema.names, *names])


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = PREDICTION) -> DataFrame:
    """docs (text and whatever else, but no column of these names) with the language, its score and the chosen set."""
    free_names(docs, *names)
    kinds = (T.StringType(), T.DoubleType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _predict(it, shared, at, names), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: learned from the rows that are not held out, predicted for all."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    named = predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
