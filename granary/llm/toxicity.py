"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks (operator 6).

Units are the words of a text, also those spelled with blanks between their letters ("w o r d"). The kernel of two
units counts the three-letter subsequences that they share, each weighted by DECAY for every letter that it skips, so
inserted characters and changed endings leave most of it. Landmarks are units mined from labelled texts; a unit's
features are its kernels with the landmarks, whitened (Nyström). Linear machines with squared hinge loss are trained on
units: those of toxic texts whose strings lean to toxic texts, against units of clean texts, twice, the second time
against the clean units that the first machine finds worst. One machine takes strings that lean by being there at all,
the other strings that lean by being there often: words that clean texts hold too, now and then, and toxic ones again
and again. A text has two features, the first machine's output for its worst unit and the share of its words that the
second one finds, summed over the whole text. Logistic regression over texts that the machines weren't fitted on sets
each on a scale from 0 to 1 (the share over those texts that the worst unit doesn't give away), and the score is the
higher one.

Since features are linear in the subsequence counts, a machine folds into one weight for each of SPACE hashed
subsequences, and scoring a unit costs some lookups however many landmarks there are. Scores of words are remembered
in bounded memory; scoring needs no shuffle. Training takes a bounded sample of labelled rows (see `train`).

Defined results: null and empty texts get the score of a text without units; without labels of both classes every
score is 0; repeated rows each give their row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.batches import map_texts, released, remembered, slices
from granary.llm.byte_bpe import Pieces
from granary.session import materialize

DECAY, REACH = 0.7, 6
SPACE = 1 << 16
LANDMARKS = 128
#: Training takes so many units of each kind (see `_machine`).
UNITS = 4000
#: A unit is taken for toxic if two of its strings lean so far: as a share of the furthest lean for strings that are
#: there at all; or, if lower, as log odds for strings that are there often, whatever strings of other languages do.
#: Units with such a string that more than COMMON of the clean texts hold give nothing away by being there.
LEANING, LEAST, COMMON = 0.5, 2.0, 0.02
#: Long units are scored by windows of this length, each starting half a window after the last.
WINDOW = 24
#: A string is there often in a text if TWICE words at least hold it, and a share of OFTEN among its words and USUAL more.
TWICE, OFTEN, USUAL = 2, 0.005, 100
LONGEST = 6
_edge = re.compile(r"^[\W_]+|[\W_]+$")
#: Digits that stand for letters.
_digits = str.maketrans("013457", "oieast")
_steps = [(a, b) for a in range(1, REACH - 1) for b in range(a + 1, REACH)]
_weights = np.array([DECAY ** (b - 2) for _, b in _steps], np.float32)


def words_of(text: str) -> list[str]:
    """The units of a text, each as often as it is there."""
    words = text.lower().split()
    out = words
    if len(words) >= 3:
        one = np.fromiter(map(len, words), np.int64, len(words)) == 1
        if one.any():
            edges = np.flatnonzero(np.diff(np.r_[False, one, False].astype(np.int8)))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if hi - lo >= 3:
                    out = [*out, "".join(words[lo:hi])]
    return out


def spelled(word: str) -> list[str]:
    """A unit as the kernel reads it: without punctuation around it, in windows if it is long.

    A unit with other characters between its letters is read once with and once without them.
    """
    w = _edge.sub("", word)
    if w.isalpha():
        forms = [w]
    else:
        w = w.translate(_digits) if not w.isdigit() else ""
        forms = [x for x in dict.fromkeys((w, "".join(filter(str.isalpha, w)))) if x]
    out = []
    for w in forms:
        out += [f"^{w[i : i + WINDOW]}$" for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)] if len(w) > WINDOW else [f"^{w}$"]
    return out


class Subsequences:
    """Hashed three-letter subsequences of a list of units."""

    def __init__(self, units: list[str]):
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.sizes = np.fromiter(map(len, units), np.int64, len(units))
        self.owner = np.repeat(np.arange(len(units)), self.sizes)
        self.chars, self.n = chars, len(units)
        counts = np.zeros(len(units))
        for (_, b), w in zip(_steps, _weights.tolist(), strict=True):
            counts += np.maximum(self.sizes - b, 0) * w * w
        self.norm = np.sqrt(np.maximum(counts, 1e-9))

    def each(self):
        """(hashed subsequence, unit, weight) for each pattern of gaps."""
        c = self.chars
        for (a, b), w in zip(_steps, _weights.tolist(), strict=True):
            if c.size > b:
                same = self.owner[:-b] == self.owner[b:]
                key = (c[: -b][same] * 1_000_003 + c[a : c.size - b + a][same]) * 1_000_003 + c[b:][same]
                yield (key * -7046029254386353131 >> 48) & (SPACE - 1), self.owner[:-b][same], w

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Each unit's normalised product with one weight for each subsequence."""
        out = np.zeros(self.n)
        for key, unit, w in self.each():
            out += np.bincount(unit, weights[key] * w, self.n)
        return out / self.norm

    def spread(self, value: np.ndarray) -> np.ndarray:
        """Sum over units of value * normalised subsequence counts."""
        out, value = np.zeros(SPACE), value / self.norm
        for key, unit, w in self.each():
            out += np.bincount(key, value[unit] * w, SPACE)
        return out


def kernel(units: list[str], landmarks: list[str], part: int = 1000) -> np.ndarray:
    marks = Subsequences(landmarks)
    triples = list(marks.each())
    kept = np.unique(np.concatenate([k for k, *_ in triples]))
    at = np.full(SPACE, -1)
    at[kept] = np.arange(kept.size)
    columns = np.zeros((kept.size, len(landmarks)))
    for key, mark, w in triples:
        np.add.at(columns, (at[key], mark), w / marks.norm[mark])
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for lo in range(0, len(units), part):
        s = Subsequences(units[lo : lo + part])
        rows = np.zeros((s.n, len(landmarks)))
        for key, unit, w in s.each():
            here = at[key] >= 0
            if here.any():
                key, unit = at[key[here]], unit[here]
                first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
                rows[unit[first]] += w * np.add.reduceat(columns[key], first)
        out[lo : lo + part] = rows / s.norm[:, None]
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 30, part: int = 2000) -> np.ndarray:
    """Weights (the last one the offset) of a linear machine, by Newton steps; rows are taken in parts, to hold little at once."""
    n, k = z.shape
    w = np.zeros(k + 1)
    for _ in range(rounds):
        h, g = ridge * np.eye(k + 1), np.zeros(k + 1)
        for lo in range(0, n, part):
            at = slice(lo, lo + part)
            x = np.c_[z[at].astype(np.float64), np.ones(len(z[at]))]
            inside = 1 - y[at] * (x @ w) > 0
            x = x[inside]
            heavy = x * (weight[at][inside, None] / n)
            h += heavy.T @ x
            g += heavy.T @ y[at][inside]
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


@dataclass
class Machine:
    weights: np.ndarray  # of hashed subsequences
    offset: float
    empty: float = -2.0

    def outputs(self, units: Subsequences) -> np.ndarray:
        return np.maximum(units.dot(self.weights) + self.offset, self.empty)


@dataclass
class Model:
    once: Machine | None
    often: Machine | None
    scale: np.ndarray  # slope and level of each feature
    empty: float = -2.0

    def unit_scores(self, words: list[str]) -> list[float]:
        """The first machine's output for each word."""
        return [a for a, _ in self.word_scores(words)]

    def word_scores(self, words: list[str]) -> list[tuple[float, float]]:
        """For each word the first machine's output (`empty` without letters) and the second one's, drawn into 0 to 1."""
        units, owner = [], []
        for i, w in enumerate(words):
            for u in spelled(w):
                units.append(u)
                owner.append(i)
        out = np.full((2, len(words)), self.empty)
        if units:
            s = Subsequences(units)
            for row, machine in zip(out, (self.once, self.often), strict=True):
                if machine is not None:
                    np.maximum.at(row, owner, machine.outputs(s))
        return list(zip(out[0].tolist(), np.clip(out[1], 0, 1).tolist(), strict=True))

    def features(self, scores: list[tuple[float, float]]) -> list[float]:
        """Worst unit, and share of words (as a logarithm, 0 where there is none) of a text whose words score so."""
        worst = max((a for a, _ in scores), default=self.empty)
        return [worst, float(np.log1p(sum(b for _, b in scores) / (len(scores) + USUAL) / 0.001))]

    def probabilities(self, features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(features) * self.scale[:, 0] + self.scale[:, 1], -30, 30)))

    def probability(self, worst: float, share: float = 0.0) -> float:
        return float(self.probabilities([worst, share]).max())


def _strings(u: str, longest: int = 4) -> set[str]:
    """The strings of four letters of a unit, and those of up to `longest`."""
    return {u[i : i + k] for k in range(4, longest + 1) for i in range(max(1, len(u) - k + 1))}


def _often(units: Counter) -> set[str]:
    """The strings that are often in a text of these units."""
    held: Counter = Counter()
    for u, n in units.items():
        for g in _strings(u, LONGEST):
            held[g] += n
    least = max(TWICE, OFTEN * (units.total() + USUAL))
    return {g for g, n in held.items() if n >= least}


def _suspicion(texts: Iterable[set[str]], toxic: list[bool]) -> dict[str, float]:
    """How far each string, of the sets of strings of texts, leans to toxic texts: its log odds less 1.5 standard errors."""
    pos, neg = Counter(), Counter()
    for strings, y in zip(texts, toxic, strict=True):
        (pos if y else neg).update(strings)
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    out = {}
    for g, a in pos.items():
        b = neg.get(g, 0)
        out[g] = float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    return out


def _least(lean: dict[str, float], shared: bool) -> float:
    least = LEANING * max(lean.values(), default=0.0)
    return min(LEAST, least) if shared else least


def _machine(texts: list[Counter], toxic: list[bool], lean: dict[str, float], shared: bool, units: int = UNITS) -> Machine | None:
    """A machine from the units whose strings lean, against units of clean texts; `shared`: leaning units may be in clean texts too.

    `units` bounds what it is fitted on: so many units of toxic texts, and of clean ones so many that are most like them,
    so many of the most frequent, and three times as many others by a hash of theirs.
    """

    def leaning(u: str) -> float:
        """The second furthest lean of a unit's strings: one string may be there by chance."""
        return sorted((0.0, 0.0, *(lean.get(g, 0.0) for g in _strings(u, LONGEST if shared else 4))))[-2]

    least = _least(lean, shared)
    clean = Counter(u for t, y in zip(texts, toxic, strict=True) if not y for u in t)
    counts = Counter(u for t, y in zip(texts, toxic, strict=True) if y for u in t if shared or u not in clean)
    found = {u: n for u, n in counts.items() if leaning(u) >= least > 0}
    positives = sorted(found, key=lambda u: (-found[u], u))[:units]
    if shared:
        clean = Counter({u: n for u, n in clean.items() if leaning(u) < least})

    def key(u: str) -> int:
        return zlib.crc32(u.encode("utf-8", "surrogatepass"))

    # the clean units most like a suspicious one, the most frequent, and others by a hash of theirs
    hard = sorted(clean, key=lambda u: (-leaning(u), u))[:units]
    common = [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:units]]
    others = sorted(clean, key=key)
    if not positives or not clean:
        return None
    machine = None
    for _ in range(2):
        negatives = sorted({*hard, *common, *others[: 3 * units]})
        marks = positives[:LANDMARKS] + sorted(positives[LANDMARKS:], key=key)[: LANDMARKS // 2] + sorted(hard[:1000], key=key)[:LANDMARKS]
        k = kernel(marks, marks)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        good = value > 1e-5 * value.max()
        whiten = vector[:, good] / np.sqrt(value[good])
        z = kernel(positives + negatives, marks) @ whiten
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        heavy = np.sqrt([found[u] for u in positives])
        share = np.r_[0.5 * heavy / heavy.sum(), np.full(len(negatives), 0.5 / len(negatives))] * len(y)
        w = squared_hinge(z, y, share)
        machine = Machine(Subsequences(marks).spread(whiten @ w[:-1]).astype(np.float32), float(w[-1]))
        # once more, against the clean units that the machine itself finds worst
        scores = machine.outputs(Subsequences(others))
        hard = [others[i] for i in np.argsort(-scores, kind="stable")[:units]]
    return machine


def fit(rows: list[tuple[int, str, int]]) -> Model | None:
    """Train on (id, text, label) rows; None unless both classes are there."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    pool: dict[str, str] = {}  # each word is held once
    words = [[pool.setdefault(w, w) for w in words_of(t or "")] for _, t, _ in rows]
    toxic = [y == 1 for *_, y in rows]
    fitted = [i for i in range(len(rows)) if i % 4 != 3]  # every fourth text is left for the scale
    both = {True, False}
    ys = [toxic[i] for i in fitted]
    if set(ys) != both:
        return None
    texts = [Counter(u for w in words[i] for u in spelled(w)) for i in fitted]
    lean = _suspicion((_often(t) for t in texts), ys)
    often = _machine(texts, ys, lean, shared=True)
    far = {g for g, x in lean.items() if x >= _least(lean, True) > 0}
    held = Counter(g for t, y in zip(texts, ys, strict=True) if not y for g in far.intersection(g for u in t for g in _strings(u, LONGEST)))
    usual = {g for g, n in held.items() if n > COMMON * ys.count(False)}
    if usual:
        texts = [Counter({u: n for u, n in t.items() if usual.isdisjoint(_strings(u, LONGEST))}) for t in texts]
    once = _machine(texts, ys, _suspicion(({g for u in t for g in _strings(u)} for t in texts), ys), shared=False)
    if once is None and often is None:
        return None
    model = Model(once, often, np.array([[1.0, -30.0], [1.0, -30.0]]))
    # the scale, by logistic regression on the texts kept aside (on all, where a class is missing there)
    aside = sorted(set(range(len(rows))) - set(fitted))
    if {toxic[i] for i in aside} != both:
        aside = range(len(rows))
    vocabulary = sorted({w for i in aside for w in words[i]})
    of = dict(zip(vocabulary, model.word_scores(vocabulary), strict=True))
    x = np.array([model.features([of[w] for w in words[i]]) for i in aside])
    t = np.array([toxic[i] for i in aside], float)
    left = np.ones(len(t), bool)
    for j, machine in enumerate((once, often)):
        if machine is not None:
            use = left if {*t[left]} == {0.0, 1.0} else np.ones(len(t), bool)
            model.scale[j] = _logistic(x[use, j], t[use])
            left &= model.probabilities(x)[:, j] < 0.5
    return model


def _logistic(s: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and level; targets are drawn in as Platt does, so separable data give finite values."""
    n1, n0 = t.sum(), (1 - t).sum()
    target = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[s, np.ones(len(s))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def remainder(doc_id):
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, longest: int = 20_000) -> Model | None:
    """A model from at most `per_class` labelled texts of each class, of at most `longest` characters each.

    These bounds hold for training only, and keep its data under 2 * per_class * longest characters on the driver; UNITS
    and LANDMARKS bound the units of these texts that the machines are fitted on. An id that is labelled both ways is
    left out.
    Rows whose crc32(doc_id as text) mod 5 is 0 are never used.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(remainder(F.col("doc_id")) != 0)
    agreed = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and toxic in (0, 1)").select("doc_id", "toxic")
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= longest)
    wanted = None
    for y in (0, 1):  # candidates: twice as many, since some texts are too long or missing
        one = agreed.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        wanted = one if wanted is None else wanted.unionByName(one)
    got = materialize(docs.sparkSession, short.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic"), "labelled")  # one scan
    kept: list = []
    for y in (0, 1):
        kept += got.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class).select("doc_id", "text", "toxic").collect()
    return fit([(r.doc_id, r.text, r.toxic) for r in kept])


def _scorer(m: Model | None):
    """Whole texts to scores; scores of words are remembered over tasks of a worker."""
    if m is None:
        return lambda texts: [0.0] * len(texts)
    key = tuple((x.weights.tobytes(), x.offset) if x else None for x in (m.once, m.often))
    pieces = remembered(("toxicity", key), lambda: Pieces(m.word_scores))

    def score(texts: list[str]) -> list[float]:
        words = [words_of(t) for t in texts]
        known = pieces.learn(set().union(*words))
        return [m.probability(*m.features(list(map(known.__getitem__, ws)))) for ws in words]

    return score


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = _scorer(sent.value)
        return lambda ids, texts: [ids, score(texts)]

    return map_texts(docs, "doc_id long, score double", start, id_col, text_col)


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores below 0.5, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @functools.partial(released, remembers=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(sent.value)
        for batch in batches:
            ids = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at).cast(pa.string())], names=["i", "t"])
            scores = [x for _, texts in slices(iter([ids])) for x in score(texts)]
            yield batch.filter(pa.array([x < 0.5 for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
