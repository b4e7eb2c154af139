"""Language identification, word first.

Words are runs of letters and combining marks, lower-cased. Every word that the model knows votes with its log frequency
in each language. An unseen word backs off to its character n-grams (code points, word ends included): the longest
length of which it has a known n-gram decides, and shorter ones are used only where no longer one is known. Votes add up
over the whole text.

The model is learned from a bounded sample: about ``sample`` documents a language, chosen by a hash of doc_id. Words
and n-grams are counted on the executors; what reaches the driver is bounded by the size of the model: the ``max_words``
commonest words of the sample in all their languages (others are unseen words), and the n-gram table.

Cases. A text that is null or has no letter is ``und`` with score 0; without any labelled row all is ``und``. A null
doc_id is not held out, and its row is predicted but not learned from. Ties go to the language that sorts first. Repeated
rows, and rows that share a doc_id, are judged each for itself. Texts may be of any length and are read whole. Other
columns pass unread through ``identify``; those with the names of the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 3_000
MAX_WORDS = 300_000
LENGTHS = (5, 4, 3, 2, 1)
SLOTS = 1 << 17
UNDETERMINED = "und"

@functools.cache
def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter or a combining mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased rows, offsets); a space stands before and after each row, so that n-grams at word
    ends have room."""
    low = pc.utf8_lower(column.fill_null(""))
    low = pc.binary_join_element_wise(" ", low, " ", "")
    buf, off = C.buffer_of(low.combine_chunks() if isinstance(low, pa.ChunkedArray) else low)
    head = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[head].astype(np.uint32)
    more = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    out = lead.copy()
    for size, least, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        own = np.flatnonzero((lead >= least) & (lead < (0x100 if size == 4 else least + (0x100 - least) // 2)))
        value = lead[own] & mask
        for k in range(1, size):
            value = value << 6 | more[head[own] + k]
        out[own] = value
    return out, np.searchsorted(head, off)


def _words(points: np.ndarray, off: np.ndarray):
    letter = _letters()
    s, e, first = C.word_spans(points, off, letter)
    h = C.prefix_hash(C.mix(np.where(letter[points], points, 32).astype(np.uint64) + np.uint64(1)))
    return s, e, first, h


def _grams(h: np.ndarray, s: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of the n-grams of words, a space at either end included."""
    s, e = s - 1, e + 1
    m = np.maximum(e - s - n + 1, 0)
    word = np.repeat(np.arange(len(s)), m)
    at = np.arange(int(m.sum())) - (np.cumsum(m) - m)[word] + s[word]
    return (C.span_hash(h, at, at + n) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64), word


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, key, count): words (n = 0) by hash and n-grams by slot."""
    for batch in batches:
        for part in C.slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                rows = part.filter(pa.array(langs == lang))
                s, e, _, h = _words(*_points(rows.column("text")))
                for n in (0, *LENGTHS):
                    key = C.span_hash(h, s, e).view(np.int64) if n == 0 else _grams(h, s, e, n)[0]
                    key, count = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(key), pa.string()), "n": pa.array(np.full(len(key), n, np.int32)), "key": pa.array(key), "count": pa.array(count, pa.int64())})


class Model:
    """Log frequencies by language of known words and of n-gram slots."""

    def __init__(self, langs: list[str], lang: np.ndarray, n: np.ndarray, key: np.ndarray, count: np.ndarray):
        self.langs = langs
        k = len(langs)
        w = n == 0
        words, inverse = np.unique(key[w], return_inverse=True)
        table = np.zeros((len(words), k))
        np.add.at(table, (inverse, lang[w]), count[w])
        self.votes = self._log(table).astype(np.float32)
        self.shift = np.uint64(64 - max(10, (4 * max(1, len(words)) - 1).bit_length()))
        slots = 1 << int(64 - self.shift)
        self.slot_key, self.slot_row = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.probes = 1
        todo, hashes = np.arange(len(words)), words.view(np.uint64)
        at = (hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slot_row[at[todo]] < 0
            take = todo[free][np.unique(at[todo[free]], return_index=True)[1]]
            self.slot_key[at[take]], self.slot_row[at[take]] = hashes[take], take
            todo = np.setdiff1d(todo, take)
            if len(todo):
                at[todo] = (at[todo] + 1) % slots
                self.probes += 1
        self.grams = {}
        for length in LENGTHS:
            g = n == length
            table = np.zeros((SLOTS, k))
            np.add.at(table, (key[g], lang[g]), count[g])
            self.grams[length] = (table.sum(1) > 0, (self._log(table) / length).astype(np.float32))

    @staticmethod
    def _log(table: np.ndarray) -> np.ndarray:
        kinds = max(1, int((table.sum(1) > 0).sum()))
        return np.log((table + 0.5) / (table.sum(0) + 0.5 * kinds))

    def row_of(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for _ in range(self.probes):
            row = self.slot_row[at[left]]
            hit = (row >= 0) & (self.slot_key[at[left]] == h[left])
            out[left[hit]] = row[hit]
            left = left[~hit & (row >= 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) % len(self.slot_row)
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(votes by row and language, words by row)."""
        s, e, first, h = _words(*_points(column))
        row = self.row_of(C.span_hash(h, s, e))
        votes = np.zeros((len(s), len(self.langs)), np.float32)
        votes[row >= 0] = self.votes[row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for n in LENGTHS:
            if not len(left):
                break
            seen, table = self.grams[n]
            slot, word = _grams(h, s[left], e[left], n)
            known = seen[slot]
            slot, word = slot[known], word[known]
            if len(word):
                head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                votes[left[word[head]]] = np.add.reduceat(table[slot], head, axis=0)
                left = np.delete(left, word[head])
        total = np.concatenate([np.zeros((1, votes.shape[1])), np.cumsum(votes, axis=0, dtype=np.float64)])
        return total[first[1:]] - total[first[:-1]], np.diff(first)


def fit(docs: DataFrame, sample: int = SAMPLE, max_words: int = MAX_WORDS) -> Model:
    """docs (doc_id, text, lang): rows to learn from."""
    rows = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    share = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], *(np.zeros(0, np.int64) for _ in range(4)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang in langs:
        chosen = chosen | ((F.col("lang") == lang) & (draw <= F.lit(int((1 << 20) * min(1, sample / share[lang])))))
    counts = rows.where(chosen).select("text", "lang").mapInArrow(_counted, "lang string, n int, key long, count long")
    counts = counts.groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    counts = C.staged(counts, "language-counts")
    words = counts.where("n = 0")
    top = words.groupBy("key").agg(F.sum("count").alias("_n")).orderBy(F.desc("_n"), "key").limit(max_words).select("key")
    got = counts.where("n > 0").union(words.join(top, "key", "left_semi").select(*counts.columns)).toArrow()
    lang = np.searchsorted(np.array(langs), np.array(got.column("lang").to_pylist())) if got.num_rows else np.zeros(0, np.int64)
    return Model(langs, lang, got.column("n").to_numpy(), got.column("key").to_numpy(), got.column("count").to_numpy())


def identify(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score; other columns pass unread."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop(*into).withColumns({into[0]: F.lit("").cast("string"), into[1]: F.lit(0.0)})
    schema = out.schema
    for name in into:
        schema[name].nullable = True

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                text = part.column("text")
                told, score = [UNDETERMINED] * len(text), np.zeros(len(text))
                if own.langs:
                    votes, n = own.score(text)
                    # As words aren't independent, evidence grows with the root of their number.
                    z = (votes - votes.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
                    best = votes.argmax(1)
                    letters = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_pylist()
                    for i in np.flatnonzero(letters):
                        told[i], score[i] = own.langs[best[i]], p[i, best[i]]
                cols = [part.column(c) for c in schema.names if c not in into]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(told, pa.string()), pa.array(score)], names=schema.names)

    return out.mapInArrow(judge, schema)


def held_out(folds: int, fold: int):
    """False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(4, 2)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
