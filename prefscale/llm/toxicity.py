"""Toxicity with noisy-channel deobfuscation.

Disguised words (digits and signs for letters, letters drawn out, letters set apart) are restored first. The possible
readings of such a word form a lattice: each sign may stand for itself or for letters, a run of one letter for one or
two of it, a separator for nothing, a space between spaced letters for nothing or a word break. A Viterbi search picks
the likeliest path under a character trigram model of the corpus and the costs of the channel; a digit at an end of a
word without signs inside stands for itself at little cost, the less the longer the number (mp3, 4th). The restored text is then scored by words and
word beginnings that are significantly commoner in toxic documents, and the log of their summed evidence is mapped to a
probability.

Trigrams are counted over all texts given to ``fit``; the model keeps the ``max_grams`` commonest. The classifier is
learned from a bounded sample of labelled rows: all of them up to ``max_rows``, beyond that a share chosen by a hash of
doc_id; all features that are significant in that sample are kept.

Cases. A null or empty text has no evidence and gets the score of such. A null doc_id is not held out, has no label, and
its row is scored. Repeated rows, and rows that share a doc_id, are judged each for itself; a doc_id with several labels
is toxic if one says so, and is learned from once. Without labels of both kinds every score is 0. Texts may be of any length and are
read whole. Readings of equal likelihood: the first of the lattice. Other columns pass unread; one with the name of the
score is replaced by ``judged`` and passes in ``without_toxic``. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_ROWS = 30_000
#: Size of the character model.
MAX_GRAMS = 1_000_000
CACHE_WORDS = 100_000

# Fixed values of the channel: what a sign may stand for, and the cost of each departure in nats.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = ".-_*~'"
COST_SIGN = 1.0
COST_DOUBLE = 1.5
COST_RUN = 0.5
COST_GAP = 0.5
COST_BREAK = 0.5
COST_SELF = 6.0
COST_HEAD = 3.0
COST_TAIL = 2.0
FLOOR = math.log(1e-6)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True
_EDGE = ".,;:?!\"'()[]{}<>«»“”‘’¡¿…"
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in _EDGE if ord(c) < 128]] = True


# ---------------------------------------------------------------- channel


class CharModel:
    """Interpolated character trigrams over words, ^ before and $ after."""

    def __init__(self, counts: dict[str, int]):
        self.tri: dict[str, float] = {}
        uni, bi, ctx1, ctx2 = Counter(), Counter(), Counter(), Counter()
        for g, n in counts.items():
            uni[g[2]] += n
            bi[g[1:]] += n
            ctx1[g[1]] += n
            ctx2[g[:2]] += n
        total = sum(uni.values()) or 1
        self.uni = {c: n / total for c, n in uni.items()}
        self.bi = {g: n / ctx1[g[0]] for g, n in bi.items()}
        self.tri = {g: n / ctx2[g[:2]] for g, n in counts.items()}

    def log(self, a: str, b: str, c: str) -> float:
        p = 0.7 * self.tri.get(a + b + c, 0.0) + 0.2 * self.bi.get(b + c, 0.0) + 0.1 * self.uni.get(c, 0.0)
        return math.log(p) if p > 1e-6 else FLOOR


def _is_sign(c: str) -> bool:
    return c in LEET and not c.isalpha()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of the word, its readings and their costs. A sign that stands for itself is read as its run; a space
    between spaced letters is nothing or a word break."""
    out: list[list[tuple[str, float]]] = []
    runs = [m[0] for m in re.finditer(r"(.)\1*", word, re.S)]
    inner = [k for k, run in enumerate(runs) if not _is_sign(run[0])]
    lo, hi = (inner[0], inner[-1]) if inner else (0, 0)
    plain = not any(_is_sign(run[0]) for run in runs[lo : hi + 1]) and " " not in word
    for at, run in enumerate(runs):
        c, k = run[0], len(run)
        if c == " ":
            out.append([("", 0.0), (" ", COST_BREAK)])
            continue
        if c in SEPARATORS and 0 < len(out):
            out.append([("", COST_GAP)])
            continue
        sign = _is_sign(c)
        readings = [(x, COST_SIGN) for x in LEET.get(c, "")] if sign else [(c, 0.0), *((x, COST_SIGN) for x in LEET.get(c, ""))]
        if k == 1:
            arcs = readings
        elif k == 2:
            arcs = [(x * 2, cost) for x, cost in readings] + [(x, cost + COST_DOUBLE) for x, cost in readings]
        else:
            arcs = [(x, cost + COST_RUN) for x, cost in readings] + [(x * 2, cost + COST_RUN) for x, cost in readings]
        if sign:
            edge = COST_HEAD / lo**2 if at < lo else COST_TAIL / (len(runs) - 1 - hi) ** 2 if at > hi else COST_SELF
            arcs = [*arcs, (run, edge if plain and c.isdigit() else COST_SELF)]
        out.append(arcs)
    return out


def decode(word: str, model: CharModel) -> str:
    """The likeliest reading of a disguised word; a word without a letter to read stays."""
    # Texts are chains of (chain before, reading): spaced runs can be long.
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    for arcs in lattice(word):
        step: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in best.items():
            for reading, cost in arcs:
                x, y, s = a, b, score - cost
                if reading == " " or reading and _is_sign(reading[0]):  # letters after a break or a sign start anew
                    s += model.log(x, y, "$") if reading == " " and y != "^" else 0.0
                    x = y = "^"
                else:
                    for c in reading:
                        s += model.log(x, y, c)
                        x, y = y, c
                if (x, y) not in step or step[x, y][0] < s:
                    step[x, y] = (s, (text, reading))
        # States are the last two letters: at most a few for each run, whatever the word's length.
        best = step
    end = max(((s + (model.log(a, b, "$") if b != "^" else 0.0), t) for (a, b), (s, t) in best.items()), key=lambda x: x[0])[1]
    out = []
    while end is not None:
        end, reading = end
        out.append(reading)
    return "".join(reversed(out)) or word


def _disguised(low: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges [i, j) to restore: single words with signs beside letters, drawn-out letters or letters between
    separators; and three or more words of one letter or sign in a row, one letter at least among them. Punctuation
    may open the first of such a row and close the last."""
    letter, sign, sep = _LETTER[low], _SIGN[low], _SEP[low]
    odd = np.zeros(len(low) + 1, np.int32)
    flag = sign.copy()
    flag[2:] |= (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:] & (low[2:] < 128)
    if len(low) > 2:
        flag[1:-1] |= sep[1:-1] & letter[:-2] & letter[2:]
    np.cumsum(flag, out=odd[1:])
    letters = np.concatenate(([0], np.cumsum(letter, dtype=np.int32)))
    candidates = np.flatnonzero((odd[e] > odd[s]) & (letters[e] > letters[s]))
    out = [(int(i), int(i) + 1) for i in candidates]
    if not len(s):
        return out
    m = e - s
    wide = (m == 2) & (low[s] >= 0xC3) & letter[s]
    euro = (m == 3) & (low[s] == 0xE2) & (low[np.minimum(s + 1, e - 1)] == 0x82) & (low[e - 1] == 0xAC)
    one = (m == 1) & (letter[s] | sign[s]) | wide | euro
    # A letter or sign (its length) with a mark before or after it.
    head = (m == 2) & _MARK[low[s]] & (letter[e - 1] & (low[e - 1] < 128) | sign[e - 1])
    size = np.where(low[s] >= 0xC3, 2, 1)
    body = (letter[s] & (low[s] < 0xE0)) | sign[s]
    marks = np.concatenate(([0], np.cumsum(_MARK[low], dtype=np.int32)))
    tail = body & (m > size) & (m <= size + 3) & (marks[e] - marks[np.minimum(s + size, e)] == m - size) & ~head
    one |= head | tail
    starts = np.zeros(len(s), bool)
    starts[first[:-1][first[:-1] < len(s)]] = True
    starts |= head
    starts[1:] |= tail[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], one.view(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = [a, *(np.flatnonzero(starts[a + 1 : b]) + a + 1).tolist(), b]
        out += [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if y - x >= 3 and letters[e[y - 1]] > letters[s[x]]]
    return sorted(out, key=lambda x: (x[0], -x[1]))


def restore(column: pa.Array, model: CharModel, known: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as (bytes, offsets) with disguised words restored."""
    low = pc.utf8_lower(column.fill_null(""))
    buf, off = C.buffer_of(low)
    if not len(buf):
        return buf, off
    s, e, first = C.word_spans(buf, off, C.SPACE_WORD)
    spans = _disguised(buf, s, e, first)
    if not spans:
        return buf, off
    raw, at, parts, shift = buf.tobytes(), 0, [], np.zeros(len(off), np.int64)
    row = np.searchsorted(first, [i for i, _ in spans], side="right") - 1
    for (i, j), r in zip(spans, row.tolist()):
        if s[i] < at:
            continue
        word = " ".join(raw[s[k] : e[k]].decode() for k in range(i, j))
        # A sign that stands alone is a letter of its run, not a mark.
        lead = word[0] if j > i + 1 and word[0] in LEET and word[1] == " " else ""
        last = word[-1] if j > i + 1 and word[-1] in LEET and word[-2] == " " else ""
        word = lead + word[len(lead) : len(word) - len(last)].strip(_EDGE) + last
        got = known.get(word)
        if got is None:
            if len(known) >= CACHE_WORDS:
                known.clear()
            got = known[word] = decode(word, model) if word else word
        new = got.encode()
        parts += [raw[at : s[i]], new]
        at = int(e[j - 1])
        shift[r + 1 :][:1] += len(new) - (at - int(s[i]))
    parts.append(raw[at:])
    return np.frombuffer(b"".join(parts), np.uint8), off + np.cumsum(shift)


# ---------------------------------------------------------------- evidence


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of words and of word beginnings of four to six bytes."""
    s, e, first = C.word_spans(buf, off, _LETTER)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = C.prefix_hash(buf)
    rows, keys = [row], [C.span_hash(h, s, e)]
    for n in (4, 5, 6):
        long = e - s > n
        rows.append(row[long])
        keys.append(C.span_hash(h, s[long], s[long] + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(keys)


_WORD = re.compile(r"[^\W\d_]+")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams of the plain words."""
    for part in (p for batch in batches for p in C.slices(batch, "text", 8 << 20)):
        words, n = Counter(), Counter()
        for text in part.column("text").to_pylist():
            words.update(_WORD.findall((text or "").lower()))
        for w, k in words.items():
            w = f"^^{w}$"
            for i in range(len(w) - 2):
                n[w[i : i + 3]] += k
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})


class Model:
    def __init__(self, chars: CharModel, keys: np.ndarray, weights: np.ndarray):
        self.chars, self.keys, self.weights = chars, keys, weights
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(keys >> np.uint64(48)).astype(np.int64)] = True
        self.slope, self.bias = 1.0, 0.0
        self.known: dict[str, str] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def evidence(self, column: pa.Array) -> np.ndarray:
        """log(1 + the sum of the weights of the distinct features) of each row: the first sign of toxicity counts most."""
        out = np.zeros(len(column))
        if not len(self.keys):
            return out
        row, key = features(*restore(column, self.chars, self.known))
        near = self.bitmap[(key >> np.uint64(48)).astype(np.int64)]
        row, key = row[near], key[near]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        if hit.any():
            both = np.unique(np.stack([row[hit], at[hit]], 1), axis=0)
            np.add.at(out, both[:, 0], self.weights[both[:, 1]])
        return np.log1p(out)

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(column) + self.bias))) if self.slope else np.zeros(len(column))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_grams: int = MAX_GRAMS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): the rows to learn from."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1, max_rows / max(n, 1))))
    rows = docs.select("doc_id", "text").where(draw).join(known.where(draw), "doc_id").dropDuplicates(["doc_id"])
    rows = C.staged(rows.select("text", F.col("toxic").cast("int")), "toxicity-sample")
    grams = docs.select("text").mapInArrow(_trigrams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    chars = CharModel({r.g: r.n for r in grams.orderBy(F.desc("n"), "g").limit(max_grams).collect()})
    empty = Model(chars, np.zeros(0, np.uint64), np.zeros(0))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        empty.slope = 0.0
        return empty
    shared = spark.sparkContext.broadcast(empty)

    def found(batches):
        cache: dict[str, str] = {}
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                row, key = features(*restore(part.column("text"), shared.value.chars, cache))
                toxic = part.column("toxic").to_numpy()[row]
                for y in (0, 1):
                    own = np.unique(np.stack([row[toxic == y].view(np.uint64), key[toxic == y]], 1), axis=0)[:, 1]
                    k, c = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "y": pa.array(np.full(len(k), y, np.int32)), "n": pa.array(c, pa.int64())})

    df = rows.mapInArrow(found, "key long, y int, n long").groupBy("key")
    df = df.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))
    df = C.staged(df, "toxicity-features")
    kinds = df.count()
    # Log-likelihood ratio against chance, at a level of one false feature over all together.
    share = n1 / (n1 + n0)
    tot, lift = F.col("n1") + F.col("n0"), (F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1))
    part = lambda c, p: F.when(c > 0, c * F.log(c / (tot * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("n1"), share) + part(F.col("n0"), max(1 - share, 1e-9)))
    strong = df.where((lift > 3) & (ratio > 2 * math.log(max(kinds, 2)))).select("key", F.log(lift).alias("w"))
    # Bounded by the words of the sample.
    got = strong.toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(chars, keys[order], got.column("w").to_numpy()[order])
    shared = spark.sparkContext.broadcast(model)

    def weighed(batches):
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                x = np.round(shared.value.evidence(part.column("text")), 2)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x), "y": part.column("toxic")})

    got = rows.mapInArrow(weighed, "x double, y int").groupBy("x", "y").agg(F.count("*").alias("n")).toPandas()
    model.slope, model.bias = _logistic(got.x.to_numpy(), got.y.to_numpy(), got.n.to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps on weighted rows, with a small penalty on the slope for separable rows."""
    a, b = 0.1, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + 0.1 * a, (n * (p - y)).sum() + 0.01 * b])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-6)), float(b)


# ---------------------------------------------------------------- operator


def judged(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """docs with the score of each text. Only texts go to the workers, and only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.score(p.column(0)) for p in C.slices(batch, "text", 1 << 20))]))

    return docs.withColumn(into, score(F.col("text")))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches the threshold. A text without evidence stays, whatever the share of toxic
    rows among the labels."""
    name = C.free_name(docs, "_toxicity")
    bare = float(model.score(pa.array([""]))[0])
    return judged(docs, model, name).where((F.col(name) < threshold) | (F.col(name) <= bare)).drop(name)


def held_out():
    """False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of the contract: rows whose crc32(doc_id) mod 5 is 0 are held out."""
    return fit(docs.where(~held_out()), labels.where(~held_out()), max_rows)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text"), learned(docs, labels), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
