"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two words counts the subsequences of three characters that they
share, ends of words counting as characters. An occurrence that spans g
characters more than three weighs DECAY to the power of g; beyond MOST_GAPS it
weighs nothing. Gapped and stretched insults, and those with inserted
characters, so keep most of their kernel value. Before that, punctuation
inside words is dropped, digits and signs that stand for letters are replaced,
and single letters in a row are joined into a word.

The kernel space is approximated by Nyström features: kernel values with
landmark words, whitened by the landmarks' own kernel matrix. A linear SVM
over them is trained on labelled documents as bags of words: a toxic document
has at least one toxic word, others have none; which one, is found in rounds,
beginning with words that are more frequent in toxic documents. As the kernel
is a finite sum over subsequences, the trained machine is one table of weights
by subsequence, so scoring is a pass over the text. A document's score is the
logistic regression of the margins of its TOP most toxic words, over the whole
text: one clear word is enough, and several that are less clear are, too.

Training takes at most MOST_PER_CLASS labelled documents of each class, by
hash of their ids, of at most LONGEST bytes; scoring covers every document and
its whole text. Characters beyond ASCII are one to three of 32 more letters, by
their UTF-8 bytes.

Defined results: null and empty texts get the score of a text without any
word; without labelled documents of both classes every score is the share of
toxic ones, or 0; null labels and labels of unknown documents are ignored;
repeated rows are scored each; an empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .encoding import release

#: Training documents of a class, and bytes of the longest that is trained on: with both, what the driver collects is bounded.
MOST_PER_CLASS, LONGEST = 1_500, 32 << 10
#: Extra characters that an occurrence may span, and what each one costs.
MOST_GAPS, DECAY = 2, 0.6
#: Landmarks that speak for toxicity at most, and background landmarks.
SPEAKING, BACKGROUND = 64, 64
#: Least z-score of a word that starts as a toxic one.
LEAST_Z = 3.0
#: Share of the greatest z-score from which a word is toxic in all rounds, if it is twice the least score too.
CLEAR = 0.5
CLEAR_WEIGHT = 4.0
#: Words of other documents to train on.
OTHER_WORDS = 10_000
ROUNDS = 3
#: Words of a document that its score goes by, and the least margin that counts.
TOP, FLOOR = 4, -1.0
#: Weight of toxic words with an inserted letter, against that of the words themselves.
STRETCHED = 0.5

LETTERS = "abcdefghijklmnopqrstuvwxyz"
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
END, OTHERS, OTHER_CODES = 0, 27, 32
SIZE = DROPPED = OTHERS + OTHER_CODES


def _codes() -> np.ndarray:
    table = np.full(256, DROPPED, dtype=np.uint8)
    table[list(b" \t\n\r\x0b\x0c")] = END
    table[0] = END
    # Of UTF-8 sequences the first byte goes, and the others are letters by their lower bits: those of European scripts have one each.
    table[128:192] = OTHERS + np.arange(64) % OTHER_CODES
    table[192:] = DROPPED
    for i, c in enumerate(LETTERS):
        table[[ord(c), ord(c.upper())]] = i + 1
    for sign, letter in STAND_INS.items():
        table[ord(sign)] = LETTERS.index(letter) + 1
    return table


CODES = _codes()
#: (j, k): offsets of the second and third character of an occurrence, within what may be spanned.
SHAPES = [(j, k) for k in range(2, 3 + MOST_GAPS) for j in range(1, k)]
WIDEST = 2 + MOST_GAPS


def normalise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts, each between ends of words, and where each text begins."""
    gap = b"\0" * (WIDEST + 1)
    joined = np.frombuffer(gap + b"".join(t + gap for t in texts) + gap, dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + len(gap) for t in texts)])[:-1]
    codes = CODES[joined]
    keep = codes != DROPPED
    begins = np.concatenate([[0], np.cumsum(keep)])[begins]
    codes = codes[keep]
    inner = codes != END
    single = np.zeros(len(codes), dtype=bool)
    single[1:-1] = inner[1:-1] & ~inner[:-2] & ~inner[2:]
    glue = np.zeros(len(codes), dtype=bool)
    glue[1:-1] = single[:-2] & single[2:]
    if glue.any():
        begins = begins - np.concatenate([[0], np.cumsum(glue)])[begins]
        codes = codes[~glue]
    return codes, begins


def occurrences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: subsequence numbers by place of their first character, whether each lies in one word, and weight."""
    n = len(codes) - WIDEST
    wide = codes.astype(np.int32)
    inside = [np.ones(n, dtype=bool)]
    for k in range(1, WIDEST):
        inside.append(inside[-1] & (codes[k : n + k] != END))
    first = wide[:n] * (SIZE * SIZE)
    for j, k in SHAPES:
        yield first + wide[j : n + j] * SIZE + wide[k : n + k], inside[k - 1], DECAY ** (k - 2)


def self_kernel(length: np.ndarray) -> np.ndarray:
    """The kernel of a word with itself, taking its subsequences as different: by number of letters."""
    total = np.zeros(len(length))
    for _, k in SHAPES:
        total += DECAY ** (2 * (k - 2)) * np.maximum(0, length + 2 - k)
    return np.maximum(total, 1.0)


def word_margins(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin (their leading end), and their weighted sums, normalised."""
    n = len(codes) - WIDEST
    sums = np.zeros(n, dtype=np.float32)
    for number, inside, weight in occurrences(codes):
        value = table[number]
        value *= inside
        value *= np.float32(weight)
        sums += value
    ends = np.flatnonzero(codes[:n] == END)
    if not len(ends):
        return ends, np.zeros(0)
    words = np.add.reduceat(sums, ends)
    lengths = np.diff(np.append(ends, n)) - 1
    return ends[lengths > 0], (words / np.sqrt(self_kernel(lengths)))[lengths > 0]


def document_margins(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """The TOP largest margins of words of each text, from the largest on; FLOOR where there are none, or less."""
    codes, begins = normalise(texts)
    places, margins = word_margins(codes, table)
    margins = margins + bias
    high = margins > FLOOR
    owner, margins = np.searchsorted(begins, places[high], side="right") - 1, margins[high]
    order = np.lexsort((-margins, owner))
    owner, margins = owner[order], margins[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.full((len(texts), TOP), FLOOR)
    out[owner[rank < TOP], rank[rank < TOP]] = margins[rank < TOP]
    return out


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, as codes."""
    codes, begins = normalise(texts)
    edges = [*begins, len(codes)]
    data = codes.tobytes()
    return [[w for w in data[a:b].split(b"\0") if w] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def features(words: list[bytes]) -> np.ndarray:
    """A row of normalised subsequence weights for each word."""
    out = np.zeros((len(words), SIZE**3), dtype=np.float32)
    for i, word in enumerate(words):
        codes = np.frombuffer(b"\0" + word + b"\0" * (WIDEST + 1), dtype=np.uint8)
        for number, inside, weight in occurrences(codes):
            keep = inside[: len(word) + 1]
            np.add.at(out[i], number[: len(word) + 1][keep], weight)
        out[i] /= np.sqrt(self_kernel(np.array([len(word)])))[0]
    return out


def sparse_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() as lists: where each word's entries begin, subsequence numbers, and their weights; numbers may repeat."""
    begins, numbers, weights = [], [], []
    for word in words:
        begins.append(sum(map(len, numbers[-len(SHAPES) :])) + begins[-1] if begins else 0)
        codes = np.frombuffer(b"\0" + word + b"\0" * (WIDEST + 1), dtype=np.uint8)
        scale = np.sqrt(self_kernel(np.array([len(word)])))[0]
        for number, inside, weight in occurrences(codes):
            keep = inside[: len(word) + 1]
            numbers.append(number[: len(word) + 1][keep])
            weights.append(np.full(int(keep.sum()), weight / scale))
    return np.array(begins), np.concatenate(numbers), np.concatenate(weights)


def compact(begins: np.ndarray, numbers: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur, and a dense row over them for each word."""
    known, places = np.unique(numbers, return_inverse=True)
    out = np.zeros((len(begins), len(known)))
    np.add.at(out, (np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(numbers)))), places), weights)
    return known, out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.shift, -500, 500)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.probability(document_margins(texts, self.table, self.bias))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) * weight.sum() / 100
    penalty[-1, -1] *= 1e-3
    active = np.ones(len(x), dtype=bool)
    for _ in range(25):
        xs, ys, ws = x[active], y[active], weight[active]
        w = np.linalg.solve(penalty + (xs * ws[:, None]).T @ xs, xs.T @ (ws * ys))
        new = y * (x @ w) < 1
        if (new == active).all():
            break
        active = new
    return w


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none of them negative, and shift of the logistic regression of y (0 or 1) on rows of margins."""
    used = np.ones(margins.shape[1], dtype=bool)
    while True:
        x = np.hstack([margins[:, used], np.ones((len(margins), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + 1e-3 * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all() or used.sum() == 1:
            slopes = np.zeros(margins.shape[1])
            slopes[used] = np.maximum(w[:-1], 1e-6)
            return slopes, float(w[-1])
        used[np.flatnonzero(used)[int(np.argmin(w[:-1]))]] = False


def train(toxic: list[bytes], other: list[bytes], toxic_share: float) -> Model:
    """The machine from texts of both classes; toxic_share is the class's share among all labelled documents."""
    empty = np.zeros(SIZE**3, dtype=np.float32)
    constant = lambda p: Model(empty, 0.0, np.zeros(TOP), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    if not toxic or not other:
        return constant(toxic_share)
    sizes = [len(toxic), len(other)]
    # In how many texts each word is.
    counts = [Counter(), Counter()]
    for side, count in zip((toxic, other), counts, strict=True):
        for i in range(0, len(side), 100):
            for words in words_of(side[i : i + 100]):
                count.update(sorted(set(words)))

    def z(word: bytes) -> float:
        a, b = counts[0][word], counts[1][word]
        p = (a + b) / sum(sizes)
        return (a / sizes[0] - b / sizes[1]) / np.sqrt(p * (1 - p) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)

    scored = sorted(((z(w), w) for w, n in counts[0].items() if n >= 3), reverse=True)
    speaking = [w for s, w in scored[: 4 * SPEAKING] if s >= LEAST_Z]
    clear = [w for s, w in scored[:SPEAKING] if s >= max(2 * LEAST_Z, CLEAR * scored[0][0])]
    rng = np.random.default_rng(7)
    vocabulary = sorted(counts[1])
    others = [vocabulary[i] for i in rng.permutation(len(vocabulary))[:OTHER_WORDS]] or [b"\1"]
    if not speaking:
        return constant(toxic_share)
    # Frequent words of other documents must be among those trained on.
    others = list(dict.fromkeys([w for w, _ in counts[1].most_common(OTHER_WORDS // 10)] + others))
    others = [w for w in others if w not in set(speaking)]
    landmarks = speaking[:SPEAKING] + others[:: max(1, len(others) // BACKGROUND)][:BACKGROUND]
    known, base = compact(*sparse_features(landmarks))
    values, vectors = np.linalg.eigh(base @ base.T)
    keep = values > 1e-6 * values.max()
    column = np.full(SIZE**3, len(known), dtype=np.int32)
    column[known] = np.arange(len(known))
    rows = np.vstack([base.T, np.zeros((1, len(landmarks)))]).astype(np.float32)
    whiten = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T

    def project(words: list[bytes]) -> np.ndarray:
        out = []
        for i in range(0, len(words), 256):
            begins, numbers, weights = sparse_features(words[i : i + 256])
            out.append(np.add.reduceat(rows[column[numbers]] * weights[:, None], begins) @ whiten)
        return np.concatenate(out)

    def stretched(word: bytes) -> list[bytes]:
        """The word with one letter inserted at each inner place."""
        return [word[:i] + bytes([1 + (7 * i + 23 * word[i]) % 26]) + word[i:] for i in range(1, len(word))] if len(word) > 3 else []

    other_x = project(others)
    witnesses = sorted(speaking)
    for _ in range(ROUNDS):
        variants = sorted({v for word in witnesses for v in stretched(word)})
        x = np.concatenate([project(witnesses + variants), other_x])
        y = np.concatenate([np.ones(len(witnesses) + len(variants)), -np.ones(len(others))])
        share = np.array([CLEAR_WEIGHT if word in clear else 1.0 for word in witnesses])
        weight = np.concatenate([share * len(others) / share.sum(), np.full(len(variants), STRETCHED * len(others) / max(1, len(variants))), np.ones(len(others))])
        w = svm(x, y, weight)
        table = empty.copy()
        table[known] = base.T @ whiten @ w[:-1]
        found: Counter = Counter()
        for i in range(0, len(toxic), 100):
            codes, begins = normalise(toxic[i : i + 100])
            places, margins = word_margins(codes, table)
            owner = np.searchsorted(begins, places, side="right") - 1
            data = codes.tobytes()
            best: dict[int, tuple[float, int]] = {}
            for o, m, p in zip(owner.tolist(), (margins + w[-1]).tolist(), places.tolist(), strict=True):
                if m > 0 and m > best.get(o, (0, 0))[0]:
                    best[o] = (m, p)
            found.update(data[p + 1 : data.find(b"\0", p + 1)] for _, p in best.values())
        # A word that speaks clearly stays, though others of its documents may speak louder.
        new = sorted({word for word, n in found.items() if n >= 2 and z(word) > 1} | set(clear))
        if new == witnesses:
            break
        witnesses = new
    margins = np.concatenate([document_margins(side[i : i + 100], table, float(w[-1])) for side in (toxic, other) for i in range(0, len(side), 100)])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(other))])
    share = np.concatenate([np.full(len(toxic), toxic_share / len(toxic)), np.full(len(other), (1 - toxic_share) / len(other))]) * len(y)
    slopes, shift = calibrate(margins, y, share)
    return Model(table, float(w[-1]), slopes, shift)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on labels(doc_id, toxic), which may be any part of the labels."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    rows, positive = known.agg(F.count("*"), F.sum((F.col("_toxic") > 0).cast("int"))).first()
    order = [F.xxhash64(F.lit(6), "doc_id"), F.col("doc_id")]
    chosen = known.filter("_toxic > 0").orderBy(*order).limit(MOST_PER_CLASS).union(known.filter("_toxic <= 0").orderBy(*order).limit(MOST_PER_CLASS))
    # Two numbers for each of twice MOST_PER_CLASS documents.
    fitting = docs.select("doc_id", "text").filter(F.octet_length("text") <= LONGEST)
    texts = fitting.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    sides = [[r["text"].encode() for r in texts if (r["_toxic"] > 0) is side] for side in (True, False)]
    return train(*sides, toxic_share=(positive or 0) / rows if rows else 0.0)


def _scores(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
    scores = np.zeros(len(texts))
    begin = size = 0
    for i, t in enumerate([*map(len, texts), 1 << 40]):
        if size and size + t > 1 << 21:
            scores[begin:i] = model.score(texts[begin:i])
            begin, size = i, 0
        size += t + 1
    return scores


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches the threshold) for each row."""

    shared.bound_batches(docs.sparkSession)

    def score_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score_partition, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows that score the threshold or more."""

    shared.bound_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, model) < threshold))

    return docs.mapInArrow(keep, docs.schema)
