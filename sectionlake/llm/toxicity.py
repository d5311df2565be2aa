"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionlake.llm.token_counts import slices
from sectionlake.session import ship_package

#: Subsequences of so many letters; a letter between them, in either string, costs the factor GAP.
LENGTH, GAP = 4, 0.8
#: The kernel of two words is this power of the normalised subsequence kernel, so that words in common letters alone count for little.
POWER = 4
#: A word has at least this share of a landmark's letters in common with it, in order, or counts nothing.
COMMON = 0.75
#: Longer words are scored by windows of so many letters that overlap by half.
WINDOW = 24
#: A sentence has at most so many words; a longer one is several.
SENTENCE = 64
#: The bounded sample for fitting: labelled documents of each class, and the most characters of one.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 600, 1_200, 12_000
THRESHOLD = 0.3
#: A landmark stands in toxic documents at so many times the rate of clean ones.
LIFT = 4.0
#: So much of the toxic sample counts with a letter put into its toxic words, when scores are calibrated.
DISGUISED = 0.3
#: The lengths of landmarks.
PIECES = (4, 6, 8)
#: The longest word that may be a landmark as a whole.
LONGEST = 15
#: Words whose scores a worker remembers.
MOST_WORDS = 700_000
#: A word adds at most so much to its sentence, so that a word as the labels have it says little more than a disguised one.
MOST_VALUE = 2.0
_APART = re.compile(r"[\W_]+")


def letters(word: str) -> str:
    """What a word is compared by: its letters and digits in lower case behind a mark of its start."""
    return "^" + (word if word.isalnum() else _APART.sub("", word))


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def subsequence_kernel(codes: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """The gap-weighted subsequence kernel of many words (rows of letter codes, padded by 0) with one string."""
    return _kernel(codes[:, :, None] == landmark[None, None, :])


def own_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself."""
    return _kernel((codes[:, :, None] == codes[:, None, :]) & (codes != 0)[:, :, None])


def _kernel(same: np.ndarray) -> np.ndarray:
    """The kernel of pairs of strings from where their letters are equal: (pair, place in the first, place in the second).

    Common subsequences of LENGTH letters count GAP to the number of letters between theirs, in both
    strings together. Pairs step through the recursion together, a letter of the first at a time.
    """
    n, width, m = same.shape
    decay = np.triu(GAP ** np.maximum(0, np.arange(m)[None, :] - np.arange(m)[:, None] - 0.0)).astype(np.float32)
    later = np.zeros((m, m), dtype=np.float32)  # from the place of a match to those after it
    later[:, 1:] = decay[:, :-1]
    # run[i][:, k]: subsequences of i letters so far, weighed up to the place before k in the second string and the present one in the first.
    run = [np.ones((n, m), dtype=np.float32)] + [np.zeros((n, m), dtype=np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(n, dtype=np.float32)
    for j in range(width):
        met = [np.where(same[:, j], r, 0) for r in run]
        total += met[-1].sum(axis=1)
        for i in range(LENGTH - 1, 0, -1):
            run[i] *= GAP
            run[i] += met[i - 1] @ later
    return total


@dataclass
class Model:
    """Landmarks, their weights (Nystroem's map and the machine's normal in one), and the calibration."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    prior: float
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros(1024, dtype=np.float32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1024, dtype=bool))
    single: np.ndarray = field(default_factory=lambda: np.zeros(1024, dtype=bool))

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("landmarks", "weights", "bias", "curve", "prior")}

    def __setstate__(self, state):
        self.__init__(**state)

    def learn(self, words: list[str]) -> None:
        """Score new words and remember them."""
        first = len(self.known)
        forms = [letters(w) for w in words]
        new = list(set(forms))  # many words differ only in the signs around them
        value = dict(zip(new, (word_features(new, self.landmarks) @ self.weights).tolist()))
        values = [value[f] for f in forms]
        if first + len(words) > len(self.scores):
            size = 2 * (first + len(words))
            self.scores, self.ends, self.single = (np.concatenate([a[:first], np.zeros(size - first, a.dtype)]) for a in (self.scores, self.ends, self.single))
        span = slice(first, first + len(words))
        self.scores[span] = np.clip(values, -4, MOST_VALUE)
        self.ends[span] = [w[-1] in ".!?" for w in words]
        self.single[span] = [len(w) == 1 and w.isalpha() for w in words]
        self.known.update(zip(words, range(first, first + len(words))))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each whole text: the machine's value of its most toxic sentence, its positive words' values summed (log), and their share."""
        split = [t.lower().split() for t in texts]
        out = np.tile([self.bias, 0.0, 0.0], (len(texts), 1))
        flat = [w for words in split for w in words]
        if not flat:
            return out
        seen = set(flat)
        if len(self.known) + len(seen) > MOST_WORDS:
            self.known.clear()
        if new := [w for w in seen if w not in self.known]:
            self.learn(new)
        ids = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        values = self.scores[ids].astype(np.float64)
        sizes = np.array([len(words) for words in split])
        has = np.flatnonzero(sizes)
        begin = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
        head = np.zeros(len(flat), dtype=bool)
        head[begin] = True
        self._spelled(flat, ids, values, head)
        head[1:] |= self.ends[ids[:-1]]
        at = np.flatnonzero(head)
        place = np.arange(len(flat)) - np.repeat(at, np.diff(np.append(at, len(flat))))
        starts = np.flatnonzero(place % SENTENCE == 0)
        sums = np.add.reduceat(values, starts)
        total = np.add.reduceat(np.maximum(values, 0), begin)
        out[has, 0] += np.maximum.reduceat(sums, np.searchsorted(starts, begin))
        out[has, 1] = np.log1p(total)
        out[has, 2] = np.minimum(5.0, 50 * total / sizes[has])
        return out

    def _spelled(self, flat: list[str], ids: np.ndarray, values: np.ndarray, head: np.ndarray) -> None:
        """Words spelled letter by letter: runs of single letters count as one word, at their first letter."""
        one = self.single[ids]
        if one.sum() < LENGTH:
            return
        edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
        at, spelled = [], []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            cuts = [a, *(a + 1 + np.flatnonzero(head[a + 1 : b])).tolist(), b]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo >= LENGTH:
                    at.append(lo)
                    spelled.append(letters("".join(flat[lo:hi])))
        if spelled:
            values[at] += np.clip(word_features(spelled, self.landmarks) @ self.weights, -4, MOST_VALUE)

    def probability(self, texts: list[str]) -> np.ndarray:
        """The calibrated probability of each whole text."""
        if not self.landmarks:
            return np.full(len(texts), self.prior)
        return logistic(self.evidence(texts), self.curve)


def logistic(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -60, 60)))


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letter codes of words of at most `width` letters, padded by 0."""
    raw = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32).reshape(len(words), width)


def word_features(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The word kernel with each landmark: the subsequence kernel, normalised by both strings' own, to the power POWER.

    It is 0 where a word and a landmark have no common subsequence of the share COMMON of the
    landmark's letters (LENGTH at least). Words (letters only) beyond WINDOW take the most of their windows.
    """
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    marks = [_codes([x], len(x))[0] for x in landmarks]
    norms = [float(own_kernel(m[None, :])[0]) ** 0.5 for m in marks]
    parts, owner = [], []
    for i, w in enumerate(words):
        if len(w) >= LENGTH:
            for part in windows(w):
                parts.append(part)
                owner.append(i)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    alphabet = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint32)
    # For each landmark and letter (the last row: any other one): the places of the letter in the landmark, as bits.
    places = [np.array([*(int(sum(1 << i for i in np.flatnonzero(m == a))) for a in alphabet), 0], dtype=np.uint16) for m in marks]
    least = [max(LENGTH, int(np.ceil(COMMON * len(m) - 1e-9))) for m in marks]
    held = np.array([[int((m == a).sum()) for m in marks] for a in alphabet]).reshape(len(alphabet), len(marks))
    for low in range(0, len(order), 4096):
        at = order[low : low + 4096]
        codes = _codes([parts[i] for i in at.tolist()], int(sizes[at[-1]]))
        of = np.array([owner[i] for i in at.tolist()])
        near = np.minimum(np.searchsorted(alphabet, codes), max(0, len(alphabet) - 1))
        letter = np.where(alphabet[near] == codes, near, len(alphabet)).T
        norm = np.zeros(len(at), dtype=np.float32)  # of the words that some landmark needs it for
        # First by letters alone: so many letters of a word are in a landmark.
        counts = np.zeros((len(at), len(alphabet) + 1), dtype=np.int16)
        for here in letter:
            counts[np.arange(len(at)), here] += 1
        shared = np.zeros((len(at), len(marks)), dtype=np.float32)
        for times in range(1, int(held.max(initial=0)) + 1):
            shared += (counts[:, :-1] >= times).astype(np.float32) @ (held >= times).astype(np.float32)
        for k, mark in enumerate(marks):
            able = np.flatnonzero(shared[:, k] >= least[k])
            if len(able):
                able = able[_longest_common(places[k][letter[:, able]], len(mark)) >= least[k]]
            if not len(able):
                continue
            new = able[norm[able] == 0]
            for some in np.array_split(new, 1 + len(new) // 1024):
                norm[some] = np.sqrt(own_kernel(codes[some]))
            np.maximum.at(out[:, k], of[able], subsequence_kernel(codes[able], mark) / (norm[able] * norms[k]))
    return np.power(out, POWER, out=out)


def _longest_common(met: np.ndarray, size: int) -> np.ndarray:
    """The longest common subsequence of words with a string of `size` letters, all words a letter at a time by bits.

    Below LENGTH the kernel is zero. met[j] has, of each word's letter j, its places in the string.
    """
    whole = np.uint16((1 << size) - 1)
    open_ = np.full(met.shape[1], whole, dtype=np.uint16)
    for here in met:
        used = open_ & here
        open_ = ((open_ + used) | (open_ - used)) & whole
    return size - np.bitwise_count(open_).astype(np.int64)


def sentences(text: str) -> list[list[str]]:
    """Words by sentence, a sentence ending at a word with . ! or ? behind it, or after SENTENCE words."""
    out, now = [], []
    for w in text.lower().split():
        now.append(w)
        if w[-1] in ".!?" or len(now) == SENTENCE:
            out.append(now)
            now = []
    return [*out, now] if now else out


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """Words and pieces of them (of the lengths PIECES) that far more toxic documents hold than clean ones.

    A piece must stand in 2 % of the toxic documents (3 at least), at LIFT times the clean rate. The
    next piece is the one with the largest sum, over the toxic documents that hold it, of 1/2 to the
    number of pieces chosen there before, times the log of its lift; the longer one among equals.
    Pieces that contain a chosen one, or lie in it, go.
    """

    def pieces(words: set[str]) -> set[str]:
        whole = {w for w in words if LENGTH < len(w) <= LONGEST}
        return whole | {w[i : i + n] for w in words for n in PIECES for i in range(len(w) - n + 1)}

    least = max(3, len(toxic) // 50)
    # Counts by hash first, so that only pieces that may be frequent are ever kept.
    rough = np.zeros(1 << 22, dtype=np.int32)
    for words in toxic:
        np.add.at(rough, _buckets(pieces(words)), 1)
    often: Counter[str] = Counter()
    for words in toxic:
        own = list(pieces(words))
        often.update([own[i] for i in np.flatnonzero(rough[_buckets(own)] >= least).tolist()])
    held: dict[str, list[int]] = {p: [] for p, n in often.items() if n >= least}
    for d, words in enumerate(toxic):
        for p in pieces(words) & held.keys():
            held[p].append(d)
    usual: Counter[str] = Counter()
    for words in clean:
        usual.update(pieces(words) & held.keys())
    lift = {p: len(ds) / len(toxic) / ((usual[p] + 0.5) / len(clean)) for p, ds in held.items()}
    able = {p: np.array(held[p]) for p in held if lift[p] >= LIFT}
    weight = np.ones(len(toxic))
    chosen: list[str] = []
    while able and len(chosen) < most:
        gains = {p: (float(weight[ds].sum()) * np.log(lift[p]), len(p), p) for p, ds in able.items()}
        best = max(gains, key=gains.__getitem__)
        if gains[best][0] < least / 4:
            break
        weight[able[best]] /= 2
        chosen.append(best)
        able = {p: ds for p, ds in able.items() if p not in best and best not in p}
    return chosen


def _buckets(pieces) -> np.ndarray:
    return np.fromiter(map(hash, pieces), dtype=np.int64, count=len(pieces)) & ((1 << 22) - 1)


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Normal and bias of a linear support vector machine with squared hinge loss, by Newton's steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-9
    w = np.zeros(z.shape[1])
    inside = np.ones(len(z), dtype=bool)
    for _ in range(25):
        own, c = z[inside], cost[inside]
        w = np.linalg.solve(np.diag(keep) + (own * c[:, None]).T @ own, (own * c[:, None]).T @ y[inside])
        now = y * (z @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and offset of a logistic curve over a document's evidence, with Platt's smoothed targets."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    b = np.zeros(z.shape[1])
    for _ in range(200):
        p = logistic(x, b)
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(h, z.T @ (weight * (p - target)) + keep * b)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def disguised(text: str, model: Model) -> str:
    """A text whose toxic words have an unrelated letter put into them, at a place that the word and its number in the text choose."""
    seen = 0

    def hide(m: re.Match) -> str:
        nonlocal seen
        word = m[0]
        at = model.known.get(word.lower())
        if len(word) < LENGTH or at is None or model.scores[at] < 0.5:
            return word
        seen += 1
        chance = zlib.crc32(f"{word} {seen}".encode())
        place = 1 + chance % (len(word) - 1)
        return word[:place] + chr(97 + (chance >> 16) % 26) + word[place:]

    model.evidence([text])
    return re.sub(r"\S+", hide, text)


def fit(toxic: list[str], clean: list[str], prior: float, most_landmarks: int = 48, most_sentences: int = 30_000, rounds: int = 3) -> Model:
    """Fit on labelled documents, whose sentences take their labels by multiple-instance learning.

    All sentences of clean documents are clean. Of a toxic document, those that hold a landmark are
    toxic in the first round; later those with a positive value and the one of the highest value. The
    last round and the calibration see every toxic document once more with disguised words, so that
    the machine's margin keeps such words apart from clean ones.
    """
    if not toxic or not clean:
        return Model([], np.zeros(0), 0.0, np.zeros(4), prior)
    words = [[{letters(w) for w in t.lower().split()} for t in side] for side in (toxic, clean)]
    landmarks = choose_landmarks(*words, most_landmarks)
    if not landmarks:
        return Model([], np.zeros(0), 0.0, np.zeros(4), prior)
    gram = word_features(landmarks, landmarks).astype(np.float64)
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    project = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ axes.T
    known: dict[str, np.ndarray] = {}

    def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, owner = [], []
        new = sorted({letters(w) for t in texts for w in t.lower().split()} - known.keys())
        known.update(zip(new, word_features(new, landmarks)))
        for d, t in enumerate(texts):
            for s in sentences(t):
                rows.append(np.sum([known[letters(w)] for w in s], axis=0))
                owner.append(d)
        return np.array(rows).reshape(-1, len(landmarks)) @ project, np.array(owner, dtype=np.int64)

    xt, ot = features(toxic)
    xc, _ = features(clean)
    if len(xc) > most_sentences:  # those that say most: the largest ones, and an even choice of the rest
        size = np.argsort(-np.abs(xc).sum(axis=1), kind="stable")
        rest = size[most_sentences // 2 :]
        xc = xc[np.concatenate([size[: most_sentences // 2], rest[:: max(1, len(rest) * 2 // most_sentences)]])]
    positive = np.abs(xt).max(axis=1) >= 0.5
    w, b = np.zeros(len(landmarks)), 0.0
    hidden: list[str] = []
    xh = np.zeros((0, len(landmarks)))
    for n in range(rounds + 1):
        if n == rounds:  # once more with disguised words, in the sentences that are toxic
            model = Model(landmarks, project @ w, b, np.zeros(4), prior)
            hidden = [disguised(t, model) for t in toxic]
            xh = features(hidden)[0]
            xh = xh[positive] if len(xh) == len(positive) else xh[:0]
        x = np.vstack([xt[positive], xh, xc])
        y = np.concatenate([np.ones(len(x) - len(xc)), -np.ones(len(xc))])
        cost = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) / len(y) * 100
        w, b = squared_hinge(x, y, cost)
        value = xt @ w + b
        best = np.full(len(toxic), -np.inf)
        np.maximum.at(best, ot, value)
        positive = (value > 0) | (value >= best[ot])
    model = Model(landmarks, project @ w, b, np.zeros(4), prior)
    told = np.vstack([model.evidence(toxic), model.evidence(hidden), model.evidence(clean)])
    y = np.concatenate([np.ones(2 * len(toxic)), np.zeros(len(clean))])
    share = np.concatenate([np.full(len(toxic), 1 - DISGUISED), np.full(len(toxic), DISGUISED)]) * prior / len(toxic)
    weight = np.concatenate([share, np.full(len(clean), (1 - prior) / len(clean))]) * len(y)
    model.curve = calibrate(told, y, weight)
    return model


def held_out(key: Column) -> Column:
    """The rows that fitting never sees: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled documents that aren't held out.

    The sample takes the keys with the least hashes, SAMPLE_TOXIC and SAMPLE_CLEAN of them, with
    texts of 1 to SAMPLE_CHARS characters. A key with several labels is toxic if one says so; null
    keys, labels and texts are left out. Without labels of both kinds the model gives every text the
    share of toxic labels (0 without labels).
    """
    told = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_y"))
    n, ones = told.agg(F.count("*"), F.sum("_y")).first()
    prior = float(ones or 0) / n if n else 0.0
    order = F.xxhash64(F.col("_k"))
    sides = []
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        ids = told.where(F.col("_y") == y).select(F.col(key).alias("_k")).orderBy(order, "_k").limit(2 * most)
        texts = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).where(F.length("_t").between(1, SAMPLE_CHARS))
        texts = texts.join(F.broadcast(ids), "_k", "left_semi").orderBy(order, "_k", "_t").limit(most)  # at most 2,400 ids
        sides.append([r[0] for r in texts.select("_t").collect()])  # at most `most` texts of SAMPLE_CHARS
    return fit(*sides, prior)


def toxicity_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score (0 to 1) of every whole text: the calibrated value of its most toxic sentence.

    No shuffle; a task streams slices of about a MB of text, remembers the scores of a bounded number
    of words, and can be run again at any time. Null and empty texts score as a text without words.
    Repeated rows come out as often as they are there; an empty table gives no rows. Only the key and
    the text are read.
    """

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                scores = model.probability([t or "" for t in piece.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores)], names=[key, "score"])

    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with the columns they came with."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 1 << 20, batch.schema.get_field_index(text)):
                texts = piece.column(piece.schema.get_field_index(text)).cast(pa.string())
                yield piece.filter(pa.array(model.probability([t or "" for t in texts.to_pylist()]) < threshold))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op5_string_kernel(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity_scores(docs, model)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_string_kernel": op5_string_kernel}
ORACLE_SQL: dict[str, str] = {}
