"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel of two words is over their common subsequences of ORDER letters
within a span of SPAN: each occurrence counts DECAY to the power of its span, so
an insult with gaps or inserted characters still shares most of its
subsequences with the plain one.  Landmarks are words; the Nystroem map of the
landmarks turns a word into a vector, and a linear support vector machine on
those vectors is trained on labelled texts as bags of words: of toxic texts
the telling words count, and the same with a letter put in, of clean texts every
word does, those that the machine takes for toxic most.  As the map and the machine are linear in the kernel, the
decision of a word is a sum over its subsequences of weights that the landmarks
give, divided by the word's own norm; only those weights travel to the tasks.

Decisions are taken of all words of a text, lower-cased, with common letter
look-alikes replaced and everything but letters dropped, of runs of single
letters joined up, and of the overlapping windows of long words.  A logistic
curve, fitted on the training texts, of how far the highest is above zero and of
the mean of the TOP highest different ones turns them into a score: one clear
insult is enough, and a clean word that looks a little like one is not.

Training uses the labelled rows with crc32(doc_id) mod 4 <> 2, of which at most
MAX_DOCS of each label (those with the lowest hash of doc_id); labels, lang,
source and doc_id are never inputs of a score.

Defined results: null and empty texts score as a text without a word; repeated
rows score alike; of labelled documents with one doc_id one is trained on; without labels of both kinds every score is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from heapq import nlargest
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

ORDER, SPAN, DECAY = 4, 6, 0.7
WINDOW, STEP = 12, 4
MAX_DOCS = 3000
MAX_WORDS = 4000  # clean words to train on: the commonest, and as many of any kind
CANDIDATES = 200
LANDMARKS = 128
HARD_ROUNDS, HARD_WORDS = 3, 1000
SIGNIFICANT = 18.0  # of a log-likelihood ratio, one degree of freedom
PURITY = 0.03
FROM = 0.3
TOP = 3  # highest decisions of a text that are averaged
CACHE = 600_000  # tokens, and words, whose decisions a worker remembers, some 150 MB together

# Characters that stand in for letters.
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")
_EDGE = ".,;:!?\"'()[]{}<>-_*#%&|/\\~`´‘’“”«»…+="
_SINGLES = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


Letters = tuple[str, ...]


def _occurrences(word: Sequence) -> list[tuple]:
    """The letters of each subsequence of the word, by their positions."""
    found: list[Letters] = []
    for first in range(len(word) - ORDER + 1):
        part = word[first : first + SPAN]
        found += islice(combinations(part, ORDER), comb(len(part) - 1, ORDER - 1))  # those with its first letter
    return found


@functools.cache
def _counts(length: int) -> list[float]:
    """What each of them counts."""
    found = []
    for first in range(length - ORDER + 1):
        for more in combinations(range(first + 1, min(length, first + SPAN)), ORDER - 1):
            found.append(DECAY ** (more[-1] - first + 1))
    return found


@functools.cache
def _plain_norm(length: int) -> float:
    return sum(v * v for v in _counts(length)) ** 0.5


def _norm(occurrences: list[Letters], length: int) -> float:
    if len(set(occurrences)) == len(occurrences):
        return _plain_norm(length)
    own: dict[Letters, float] = defaultdict(float)
    for k, v in zip(occurrences, _counts(length), strict=True):
        own[k] += v
    return sum(v * v for v in own.values()) ** 0.5


def subsequences(word: str) -> dict[Letters, float]:
    """The word's place in the kernel's space, of length 1 (empty if it is too short)."""
    occurrences = _occurrences(word)
    norm = _norm(occurrences, len(word))
    found: dict[Letters, float] = defaultdict(float)
    for k, v in zip(occurrences, _counts(len(word)), strict=True):
        found[k] += v / norm
    return dict(found)


def windows_of(word: str) -> list[str]:
    if len(word) <= WINDOW + 2:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW + STEP, STEP)]


def letters(token: str) -> str:
    """Of a lower-case token: look-alikes replaced, all but letters dropped."""
    if token.isalpha():
        return token
    token = token.strip(_EDGE)
    if any(map(str.isalpha, token)):
        token = token.translate(LOOK_ALIKE)
    return "".join(filter(str.isalpha, token))


def tokens_of(text: str) -> set[str]:
    text = text.lower()
    found = set(text.split())
    found.update("".join(x.split()) for x in _SINGLES.findall(text))
    return found


def words_of(text: str) -> set[str]:
    return {w for t in tokens_of(text) for w in windows_of(letters(t)) if len(w) >= ORDER}


@functools.cache
def _places(length: int) -> np.ndarray:
    """The positions of each of a word's occurrences, in the order of _counts."""
    return np.array(_occurrences(range(length)), np.int64).reshape(-1, ORDER)


def _norms(letters: np.ndarray) -> np.ndarray:
    """Of words (rows of letter numbers) of one length."""
    length = letters.shape[1]
    keys = letters[:, _places(length)] @ (1 << 16 * np.arange(ORDER, dtype=np.uint64))
    order = np.argsort(keys, axis=1, kind="stable")
    keys, counts = np.take_along_axis(keys, order, axis=1), np.array(_counts(length))[order]
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    starts = np.flatnonzero(fresh)
    sums = np.add.reduceat(counts.ravel(), starts)
    return np.sqrt(np.bincount(starts // keys.shape[1], sums * sums, len(keys)))


class _Decisions(dict):
    """token -> the highest decision of its windows, learnt for many tokens at once."""

    def __init__(self, weights: dict[Letters, float], bias: float):
        self.bias, self.words = bias, {}  # words: the same by the letters of a token
        known = sorted({c for k in weights for c in k})
        self.code = np.zeros(max(map(ord, known), default=0) + 2, np.int64)  # 0: a letter of no weight
        for i, c in enumerate(known):
            self.code[ord(c)] = i + 1
        self.size = len(known) + 1
        ends = [[(self.code[ord(k[i])], self.code[ord(k[i + 1])]) for k in weights] for i in (0, 2)]
        index = [{pair: i + 1 for i, pair in enumerate(dict.fromkeys(pairs))} for pairs in ends]
        self.rows, self.columns = (np.zeros(self.size * self.size, np.int64) for _ in index)  # of the first two letters, of the last two
        for at, found in zip((self.rows, self.columns), index, strict=True):
            for (x, y), i in found.items():
                at[x * self.size + y] = i
        self.table = np.zeros((len(index[0]) + 1, len(index[1]) + 1))
        for first, last, w in zip(*ends, weights.values(), strict=True):
            self.table[index[0][first], index[1][last]] = w

    def of_words(self, words: list[str]) -> dict[str, float]:
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        found: dict[str, float] = {}
        for length, alike in by_length.items():
            for at in range(0, len(alike), 20_000):
                some = alike[at : at + 20_000]
                points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
                code = self.code[np.minimum(points, len(self.code) - 1)][:, _places(length)]
                which = self.table[self.rows[code[..., 0] * self.size + code[..., 1]], self.columns[code[..., 2] * self.size + code[..., 3]]]
                total = which @ np.array(_counts(length))
                met = np.flatnonzero(which.any(axis=1))
                if len(met):
                    _, letters = np.unique(points[met], return_inverse=True)
                    total[met] /= _norms(letters.reshape(-1, length).astype(np.uint64))
                found.update(zip(some, (total + self.bias).tolist(), strict=True))
        return found

    def learn(self, tokens: set[str]) -> None:
        new = {t: letters(t) for t in tokens if t not in self}
        if len(self) + len(new) > CACHE or len(self.words) > CACHE:
            self.clear()
            self.words.clear()
            new = {t: letters(t) for t in tokens}
        parts = {w: [x for x in windows_of(w) if len(x) >= ORDER] for w in set(new.values()) if w not in self.words}
        decided = self.of_words(list({x for found in parts.values() for x in found}))
        self.words.update((w, max(map(decided.__getitem__, found), default=self.bias)) for w, found in parts.items())
        self.update((t, self.words[w]) for t, w in new.items())


_decisions: dict[int, _Decisions] = {}  # of one model, the last


def decision(weights: dict[Letters, float], bias: float):
    """An Arrow UDF: text -> the TOP highest different decisions of its words, highest first."""
    mark = hash((bias, tuple(weights.items())))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def decide(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if mark not in _decisions:
            _decisions.clear()
            _decisions[mark] = _Decisions(weights, bias)
        known = _decisions[mark]
        for batch in texts:
            out: list[list[float]] = []
            for at in range(0, len(batch), 256):
                found = [tokens_of(t.as_py() or "") for t in batch.slice(at, 256)]
                known.learn(set().union(*found))
                out += (nlargest(TOP, set(map(known.__getitem__, x))) for x in found)
            yield pa.array(([*f, *[bias] * (TOP - len(f))] for f in out), pa.list_(pa.float64()), size=len(batch))

    return decide


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word or '~' piece of one, toxic texts, clean texts) of a task's texts."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            words = words_of(text.as_py() or "")
            found = words | {"~" + w[i : i + ORDER] for w in words for i in range(len(w) - ORDER + 1)}
            seen[0 if toxic.as_py() else 1].update(found)
    words = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(words), 50_000):
        some = words[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string()), *(pa.array([c[w] for w in some], pa.int64()) for c in seen)], ["word", "toxic", "clean"]
        )


def _ratio(n_toxic: int, n_clean: int):
    """The log-likelihood ratio of a word's counts, 0 unless it is next to absent from clean texts."""
    a, b, n, m = F.col("toxic"), F.col("clean"), F.lit(float(n_toxic)), F.lit(float(n_clean))
    ea, eb = n * (a + b) / (n + m), m * (a + b) / (n + m)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return F.when(a / n * PURITY > b / m, 2 * (part(a, ea) + part(b, eb))).otherwise(0.0)


def inserted(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter put in, and with one doubled."""
    at, letter = int(rng.integers(1, len(word))), chr(97 + int(rng.integers(26)))
    return [word[:at] + letter + word[at:], word[:at] + word[at - 1] + word[at:]]


def _fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 0.2, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps with halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-6]
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float((ridge * w * w).sum() / 2 + c * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w))
        active = x[slack > 0]
        hessian = np.diag(ridge) + 2 * c * (active * weight[slack > 0, None]).T @ active
        move = np.linalg.solve(hessian, ridge * w - 2 * c * x.T @ (weight * y * slack))
        size = 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w, before = w - size * move, now
        now = loss(w)
        if before - now < 1e-6 * max(1.0, now):
            break
    return w[:-1], float(w[-1])


def _distinct(words: Iterable[str], most: int, chosen: list[dict[Letters, float]]) -> list[dict[Letters, float]]:
    """The words' places, in order, passing over those that are close to one already chosen."""
    chosen, start = list(chosen), len(chosen)
    for w in words:
        s = subsequences(w)
        if len(chosen) - start == most:
            break
        if all(sum(v * t.get(k, 0.0) for k, v in s.items()) < 0.85 for t in chosen):
            chosen.append(s)
    return chosen


def fit_words(toxic: dict[str, float], hard_words: list[str], clean_words: list[str]) -> tuple[dict[Letters, float], float]:
    """The weights of subsequences and the bias, from telling words with their evidence and from words of clean texts (the hard ones most)."""
    toxic_words = list(toxic)
    rng = np.random.default_rng(3)
    chosen = _distinct([*hard_words, *clean_words], LANDMARKS // 2, _distinct(toxic_words, LANDMARKS // 2, []))
    keys = {k: i for i, k in enumerate(dict.fromkeys(k for s in chosen for k in s))}
    marks = np.zeros((len(keys), len(chosen)))
    for j, s in enumerate(chosen):
        for k, v in s.items():
            marks[keys[k], j] = v
    values, vectors = np.linalg.eigh(marks.T @ marks)
    good = values > 1e-3
    nystroem = vectors[:, good] / np.sqrt(values[good])  # from a word's kernels with the landmarks to its vector

    def kernels(word: str) -> np.ndarray:
        met = [(keys[k], v) for k, v in subsequences(word).items() if k in keys]
        return np.array([v for _, v in met]) @ marks[[k for k, _ in met]] if met else np.zeros(len(chosen))

    altered = [v for w in toxic_words for v in inserted(w, rng)]
    x = np.array([kernels(w) for w in [*toxic_words, *altered, *clean_words, *hard_words]]) @ nystroem
    y = np.r_[np.ones(len(toxic_words) + len(altered)), -np.ones(len(clean_words) + len(hard_words))]
    telling = np.array([toxic[w] for w in toxic_words])
    weight = np.r_[10 * telling, np.repeat(telling, 2), np.full(len(clean_words), 1.0), np.full(len(hard_words), 20.0)]
    w, bias = _fit_svm(x, y, weight)
    per_key = marks @ (nystroem @ w)
    return {k: float(per_key[i]) for k, i in keys.items()}, bias


def evidence(decisions: Column) -> list[Column]:
    """What the curve is over: the highest above zero, and the mean."""
    return [F.greatest(decisions[0], F.lit(0.0)), F.aggregate(decisions, F.lit(0.0), lambda a, x: a + x) / TOP]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and offset of the logistic curve, by Newton steps on softened labels."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(theta))
        theta = theta - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * theta)
    return tuple(map(float, theta))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, candidates: int = CANDIDATES, max_words: int = MAX_WORDS,
          hard_words: int = HARD_WORDS, hard_rounds: int = HARD_ROUNDS, rows: Column | None = None) -> tuple | None:
    """Weights, bias, slopes, offset; None without labels of both kinds.

    Trained on the labelled documents that `rows` tells (default: all but the held-out ones), at most max_docs of each
    label, one for each doc_id; a doc_id that has both labels counts as toxic.  Of their words, at most `candidates`
    telling ones, telling pieces and rare words around these each, max_words clean ones, and hard_words more of the
    hardest clean ones in each of hard_rounds go into the machine.
    """
    scratch = Scratch(docs.sparkSession)
    rows = ~held_out() if rows is None else rows
    labels = labels.where(rows & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = labels.where("toxic = 1").orderBy(*order).limit(max_docs).unionAll(labels.where("toxic = 0").orderBy(*order).limit(max_docs))
    some = F.broadcast(some)  # 2 * max_docs rows of two numbers
    texts = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = scratch.cut(texts.select("text", "toxic"), "texts")
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    counts = texts.mapInArrow(_word_counts, "word string, toxic bigint, clean bigint")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = scratch.cut(counts.withColumn("ratio", _ratio(n[1], n[0])), "counts")

    def top(df: DataFrame, name: str, most: int) -> dict:
        """word -> value of the rows (word, value) with the highest values, chosen in the executors, highest first."""
        found = scratch.cut(df.orderBy(F.desc("value"), "word").limit(most), name).collect()
        return {r["word"]: r["value"] for r in sorted(found, key=lambda r: (-r["value"], r["word"]))}

    whole, value = ~F.startswith("word", F.lit("~")), lambda c: counts.select("word", c.alias("value"))
    telling = value(F.col("ratio")).where(F.col("value") >= SIGNIFICANT)
    words = {w: min(10.0, ratio / SIGNIFICANT) for w, ratio in top(telling.where(whole), "telling", candidates).items()}
    pieces = [w[1:] for w in top(telling.where(~whole), "pieces", candidates)]
    if pieces:  # words too rare to be told by themselves, around a piece that is
        around = F.greatest(*[F.contains("word", F.lit(p)).cast("int") for p in pieces], F.lit(0)) == 1
        rare = top(counts.where((F.col("clean") == 0) & whole & around).select("word", F.col("toxic").alias("value")), "rare", candidates)
        words = dict.fromkeys(rare, 0.5) | words
        words = dict(sorted(words.items(), key=lambda x: -x[1]))
    often = counts.where(whole & (F.col("clean") > 0)).select("word", F.col("clean").alias("value"))
    clean = [*top(often, "often", max_words // 2), *top(often.select("word", F.xxhash64("word").alias("value")), "any", max_words // 2)]
    if not words:
        return None
    hard: list[str] = []
    for i in range(hard_rounds):  # clean words that the machine takes for toxic are trained on with more weight
        weights, bias = fit_words(words, hard, clean)
        worst = often.select("word", decision(weights, bias)("word")[0].alias("value")).where("value > -0.5")
        hard = list(dict.fromkeys([*(w for w in top(worst, f"hard{i}", hard_words) if w not in words), *hard]))
    weights, bias = fit_words(words, hard, clean)
    found = texts.select(decision(weights, bias)("text").alias("f"), "toxic")
    found = found.select(*evidence(F.col("f")), "toxic").toPandas().to_numpy(dtype=float)  # 2 * max_docs rows
    scratch.clear()
    return weights, bias, *_fit_curve(found[:, :-1], found[:, -1])


def score_toxicity(docs: DataFrame, model: tuple | None, carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Every row (its carried columns) with held_out, score, predicted."""
    carry = [c for c in carry if c not in ("held_out", "score", "predicted")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), held_out().alias("held_out"), "text")
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        weights, bias, *slopes, offset = model
        rows = rows.withColumn("f", decision(weights, bias)("text"))
        x = sum((e * slope for e, slope in zip(evidence(F.col("f")), slopes, strict=True)), F.lit(offset))
        rows = rows.withColumn("score", 1 / (1 + F.exp(-x)))
    return rows.select(*[F.col("row")[c].alias(c) for c in carry], "held_out", "score", (F.col("score") >= FROM).cast("int").alias("predicted"))
