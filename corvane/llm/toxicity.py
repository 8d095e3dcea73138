"""Toxic spans and document scores from a linear-chain conditional random field.

The chain has two states, clean and toxic.  A token's emission is the weight
of its word, its prefixes and its suffixes; transitions join neighbours.
Marginals come from the forward-backward recursion; a document's score is a
logistic function of its strongest and its summed marginals, and its offending
offsets are the runs of tokens whose marginal exceeds one half.

Labels are given by document, so tokens are labelled first: a feature (word,
prefix or suffix) whose documents are toxic far more often than chance among
all the features tried allows marks its tokens in toxic documents; every other
token is clean.  The field is then fitted to these labelled tokens.

Copies of one document would let its every rare word look like a mark, so only
one of each family of like documents (``ALIKE`` of their words shared) is learnt
from.

Fitting takes a bounded sample: at most ``MAX_TOXIC`` and ``MAX_CLEAN``
labelled documents of at most ``MAX_CHARS`` code points, chosen by a hash of
their doc_id.  Marking features and calibration use one document of each family
of them, the field's weights at most ``FIELD_DOCS`` of either label: random
toxic ones, and the clean ones that look most like toxic ones.  Scoring reads
every whole text.

Defined results: a null or empty text scores as one without toxic tokens; a
null doc_id is scored and is not held out; rows that repeat a doc_id are each
scored, and a doc_id with several labels is toxic if one of them says so;
labels of unknown documents and null labels are ignored; without documents of
both labels every score is the share of toxic ones (0 if there are none); an
empty table gives no rows; other columns are ignored by the query and kept by
``reject_toxic``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import Memo, table, texts, tune

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 2500, 20_000
#: Documents of either label that the field itself is fitted to.
FIELD_DOCS = 500
#: Shared part of two documents' words (intersection over union) from which one family holds them.
ALIKE = 0.5
#: Only marginals above this are summed: the others would grow with a text's length alone.
FLOOR = 0.5
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")
_WIDTH = 256


def features(word: str) -> list[str]:
    """The word, its prefixes and its suffixes."""
    out = [word]
    n = len(word)
    out += [f"{word[:k]}*" for k in range(3, min(8, n))]
    out += [f"*{word[-k:]}" for k in range(3, min(6, n))]
    return out


# --- forward and backward -----------------------------------------------------


def _recursions(gain: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic : clean of forward and backward messages.

    ``gain`` holds exp(emission), one column for each sequence; ``trans`` the
    factors of toxic-toxic, toxic-clean and clean-toxic (clean-clean is 1).
    """
    tt, tc, ct = trans
    steps, width = gain.shape
    ahead, back = np.empty_like(gain), np.ones_like(gain)
    if width < 6:  # a few long texts: plain floats are faster than short vectors
        for j in range(width):
            n = int(lengths[j])
            g = gain[:n, j].tolist()
            r, fw = ct, []
            for i, x in enumerate(g):
                r = x * ((r * tt + ct) / (r * tc + 1) if i else r)
                fw.append(r)
            ahead[:n, j] = fw
            q, bw = 1.0, [1.0]
            for x in reversed(g[1:]):
                y = x * q
                q = (tt * y + tc) / (ct * y + 1)
                bw.append(q)
            back[:n, j] = bw[::-1]
        return ahead, back
    r = ct * gain[0]
    ahead[0] = r
    for t in range(1, steps):
        r = gain[t] * (r * tt + ct) / (r * tc + 1)
        ahead[t] = r
    q = back[-1]
    for t in range(steps - 2, -1, -1):
        y = gain[t + 1] * q
        q = (tt * y + tc) / (ct * y + 1)
        live = t + 1 < lengths
        if not live.all():
            q = np.where(live, q, 1.0)
        back[t] = q
    return ahead, back


def _groups(lengths: list[int]):
    """Indices of sequences of like length, at most ``_WIDTH`` together."""
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i])
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or i - start == _WIDTH or lengths[order[i]] > 32 + 2 * lengths[order[start]]:
            yield order[start:i]
            start = i


def marginals(emissions: list[np.ndarray], trans: np.ndarray, plain: float | None = None) -> list[np.ndarray]:
    """Probability of the toxic state at each token of each sequence.

    Along a run of tokens that all emit ``plain``, messages converge to a fixed
    point, by the factor ``rate`` at least each step.  Tokens further from
    every other emission than rounding can tell take the fixed point's
    marginal; the others are computed with those runs cut short.
    """
    factors = np.exp(trans)
    tt, tc, ct = factors
    rate = math.exp(plain) * abs(tt - ct * tc) if plain is not None else 1.0
    if rate < 0.3:
        g, margin = math.exp(plain), max(2, math.ceil(math.log(1e-17) / math.log(max(rate, 1e-9))))
        r = q = 0.0
        for _ in range(2 * margin):
            r, q = g * (r * tt + ct) / (r * tc + 1), (tt * g * q + tc) / (ct * g * q + 1)
        still = r * q / (1 + r * q)
        near = np.arange(-margin, margin + 1)
        out, kept, short = [], [], []
        for e in emissions:
            n = len(e)
            marks = np.concatenate([[0, n - 1], np.flatnonzero(e != plain)])
            if n > 2 * margin and len(marks) * len(near) < 8 * n:
                flag = np.zeros(n, bool)
                flag[np.clip((marks[:, None] + near).reshape(-1), 0, n - 1)] = True
                at = np.flatnonzero(flag)
            else:
                at = slice(None)
            out.append(np.full(n, still))
            kept.append(at)
            short.append(e[at])
        for whole, at, p in zip(out, kept, marginals(short, trans), strict=True):
            whole[at] = p
        return out
    out = [np.empty(0)] * len(emissions)
    for group in _groups([len(e) for e in emissions]):
        lengths = np.array([len(emissions[i]) for i in group])
        gain = np.ones((lengths.max(), len(group)))
        for j, i in enumerate(group):
            gain[: lengths[j], j] = np.exp(emissions[i])
        ahead, back = _recursions(gain, lengths, factors)
        odds = ahead * back
        for j, i in enumerate(group):
            o = odds[: lengths[j], j]
            out[i] = o / (1 + o)
    return out


# --- the model ----------------------------------------------------------------


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """What calibration sees of a document: a constant, its largest marginal, and the sum of those above the floor."""
    return 1.0, float(p.max()) if len(p) else 0.0, math.log1p(float(p[p > FLOOR].sum()))


@dataclass
class Field:
    """Weights of a fitted field; small enough to travel with each task."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    calibration: list[float] = field(default_factory=lambda: [-50.0, 0.0, 0.0])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def _emit(self, words: list[str]) -> list[float]:
        w, bias = self.weights, max(-25.0, min(25.0, self.bias))
        # Most words have none of the features: their first and last three letters and the word tell.
        heads, tails = {f[:3] for f in w if f[-1] == "*"}, {f[-3:] for f in w if f[0] == "*"}
        some = lambda x: x[:3] in heads or x[-3:] in tails or x in w
        return [min(25.0, max(-25.0, self.bias + sum(w.get(f, 0.0) for f in features(x)))) if some(x) else bias for x in words]

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Toxic marginals of each text's tokens."""
        if "memo" not in self.__dict__:
            self.memo = Memo(self._emit, 300_000, "toxicity")
        words = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        self.memo.fill(*words)
        get = self.memo.__getitem__
        return marginals([np.fromiter(map(get, ws), float, len(ws)) for ws in words], np.array(self.trans), max(-25.0, min(25.0, self.bias)))

    def score(self, p: np.ndarray) -> float:
        """A document's probability from its tokens' marginals."""
        x = sum(c * v for c, v in zip(self.calibration, summary(p), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))

    @staticmethod
    def spans(text: str, p: np.ndarray) -> list[dict]:
        """Runs of tokens with a marginal above one half: code point offsets into ``text`` and the largest marginal."""
        if not len(p) or p.max() <= 0.5:
            return []
        low = text.lower()
        exact = len(low) == len(text)
        out, last = [], -2
        for i, (m, x) in enumerate(zip(_TOKEN.finditer(low), p.tolist(), strict=True)):
            if x > 0.5:
                # Lower-casing rarely lengthens a character; offsets are then those of the original text before it.
                start, end = m.span() if exact else tuple(_origin(text, m.span()))
                if last == i - 1:
                    out[-1].update(end=end, p=max(x, out[-1]["p"]))
                else:
                    out.append({"start": start, "end": end, "p": x})
                last = i
        return out


def _origin(text: str, span: tuple[int, int]) -> list[int]:
    ends, at = [], 0
    for want in span:
        i = n = 0
        while n < want:
            n += len(text[i].lower())
            i += 1
        ends.append(i)
    return ends


def _families(docs: list[set[str]], rng) -> np.ndarray:
    """For each document the first one that is like it: a shared band of minima over its words, confirmed on all of them."""
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*docs)))}
    orders = np.stack([rng.permutation(len(vocabulary)).astype(np.int32) for _ in range(24)])
    met, out = {}, np.arange(len(docs))
    for i, words in enumerate(docs):
        if words:
            least = orders[:, [vocabulary[w] for w in words]].min(1).reshape(8, 3)
            keys = [(b, *row) for b, row in enumerate(least.tolist())]
            # Only the first of each family is kept in a band.
            for j in sorted(set().union(*(met.get(k, ()) for k in keys))):
                if len(words & docs[j]) >= ALIKE * len(words | docs[j]):
                    out[i] = j
                    break
            else:
                for k in keys:
                    met.setdefault(k, []).append(i)
    return out


def _seeds(docs: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Features that mark toxic documents beyond chance."""
    held = [np.fromiter({hash(f) for w in words for f in features(w)}, np.int64) for words in docs]
    none = [np.empty(0, np.int64)]
    keys, n = np.unique(np.concatenate(held + none), return_counts=True)
    marked, bad_n = np.unique(np.concatenate([h for h, y in zip(held, toxic.tolist(), strict=True) if y] + none), return_counts=True)
    bad = np.zeros(len(keys), np.int64)
    bad[np.searchsorted(keys, marked)] = bad_n
    base = toxic.mean()
    need = math.log(max(2, int((n > 2).sum()))) + 1
    x = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = n * (np.where(x > 0, x * np.log(x / base), 0) + np.where(x < 1, (1 - x) * np.log((1 - x) / (1 - base)), 0))
    chosen = set(keys[(bad > 2) & (x > max(0.5, 1.5 * base)) & (surprise > need)].tolist())
    return {f for words, y in zip(docs, toxic.tolist(), strict=True) if y for w in words for f in features(w) if hash(f) in chosen}


def fit(texts: list[str], labels: list[int], shares: tuple[float, float] | None = None, epochs: int = 8) -> Field:
    """Label the tokens of the sample, fit the field to them, calibrate document scores.

    ``shares``: documents that each clean and each toxic row of the sample stands for.
    """
    y = np.array(labels, int)
    model = Field()
    if not len(y) or y.min() == y.max():
        model.calibration = [-50.0 if not len(y) or y.max() == 0 else 50.0, 0.0, 0.0]
        return model
    one: dict[str, str] = {}  # each word is held once
    words = [[one.setdefault(w, w) for w in _TOKEN.findall(t.lower())] if t else [] for t in texts]
    rng = np.random.default_rng(7)
    family = _families([set(w) for w in words], rng)
    lone = [i for i in range(len(y)) if family[i] == i or y[i] != y[family[i]]]
    sampled = np.bincount(y, minlength=2)
    texts, words, y = [texts[i] for i in lone], [words[i] for i in lone], y[lone]
    if y.min() == y.max():
        model.calibration[0] = 50.0 * (2 * int(y.max()) - 1)
        return model
    seeds = _seeds([set(w) for w in words], y)
    marked: dict[str, bool] = {}
    for w in set().union(*words):
        marked[w] = any(f in seeds for f in features(w))
    # The field's features: those of toxic tokens. Everything else is the bias.
    spotted = {w for ws, t in zip(words, y, strict=True) if t for w in ws if marked[w]}
    names = sorted({f for w in spotted for f in features(w)})
    index = {f: i for i, f in enumerate(names)}
    of_word = {w: np.array([index[f] for f in features(w) if f in index], int) for w in marked}
    weight, total = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-3)
    weight[-1] = -6.0
    trans, trans_total = np.zeros(3), np.full(3, 1e-3)
    bad, good = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(bad) > FIELD_DOCS:
        bad = rng.choice(bad, FIELD_DOCS, replace=False)
    if len(good) > FIELD_DOCS:  # the clean documents that look most like toxic ones
        alike = np.array([sum(len(of_word[w]) > 0 for w in words[i]) for i in good])
        good = good[np.argsort(-alike, kind="stable")[:FIELD_DOCS]]
    train = [i for i in np.concatenate([bad, good]).tolist() if words[i]]
    train.sort(key=lambda i: len(words[i]))
    blocks = [train[k : k + 64] for k in range(0, len(train), 64)]
    packed = []
    for block in blocks if names else []:
        lengths = np.array([len(words[i]) for i in block])
        steps = lengths.max()
        truth = np.zeros((steps, len(block)))
        place, feats = [], []
        for j, i in enumerate(block):
            for t, w in enumerate(words[i]):
                if y[i] and marked[w]:
                    truth[t, j] = 1
                if len(of_word[w]):
                    place.append(np.full(len(of_word[w]), t * len(block) + j))
                    feats.append(of_word[w])
        there = np.arange(steps)[:, None] < lengths
        place = np.concatenate(place) if place else np.empty(0, int)
        feats = np.concatenate(feats) if feats else np.empty(0, int)
        packed.append((lengths, truth, there, place, feats))
    for epoch in range(epochs):
        for k in rng.permutation(len(packed)):
            lengths, truth, there, place, feats = packed[k]
            e = np.full(truth.size, weight[-1])
            np.add.at(e, place, weight[feats])
            gain = np.exp(np.clip(e, -25, 25)).reshape(truth.shape)
            factors = np.exp(trans)
            ahead, back = _recursions(gain, lengths, factors)
            p = ahead * back
            p = np.where(there, p / (1 + p), 0)
            wrong = (truth - p).reshape(-1)
            both = there[1:]
            after = gain[1:] * back[1:]
            parts = np.stack([ahead[:-1] * factors[0] * after, ahead[:-1] * factors[1], factors[2] * after])
            expected = (parts / (parts.sum(0) + 1) * both).sum((1, 2))
            a, b = truth[:-1] * both, truth[1:] * both
            seen = np.array([(a * b).sum(), (a * (1 - b) * both).sum(), ((1 - a) * b * both).sum()])
            grad = np.zeros_like(weight)
            np.add.at(grad, feats, wrong[place])
            grad[-1] = wrong.sum()
            grad -= 0.02 * weight * (np.arange(len(weight)) < len(names))
            total += grad * grad
            weight += 0.5 * grad / np.sqrt(total)
            step = seen - expected - 0.02 * trans
            trans_total += step * step
            trans += 0.3 * step / np.sqrt(trans_total)
    model.weights = {f: float(x) for f, x in zip(names, weight, strict=False) if abs(x) > 1e-3}
    model.bias, model.trans = float(weight[-1]), trans.tolist()
    # Logistic calibration of the documents' scores by Newton's method.
    p = [q for at in range(0, len(texts), 250) for q in model.marginals(texts[at : at + 250])]
    x = np.array([summary(q) for q in p])
    # The documents left of a label stand for those of their families as well.
    shares = np.array(shares or (1.0, 1.0)) * sampled / np.bincount(y, minlength=2)
    worth = shares[y]
    worth = worth / worth.mean()
    beta = np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hess = (x * (worth * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        beta += np.linalg.solve(hess, x.T @ (worth * (y - q)) - 0.05 * beta)
    model.calibration = beta.tolist()
    return model


# --- on tables ----------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit a field to a bounded sample of the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Of the rows of a doc_id the smallest text counts; too long ones are left out before the sample is drawn.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= MAX_CHARS)
    there = known.join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = there.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # At most MAX_TOXIC + MAX_CLEAN ids are broadcast.
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).collect()
    sample.sort()
    got = [sum(r["toxic"] == v for r in sample) for v in (0, 1)]
    shares = tuple(sizes.get(v, 0) / max(1, got[v]) for v in (0, 1))
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample], shares)


_TAGGED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])


def tag(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score and offending spans of every whole text."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                found = model.marginals(texts)
                spans = [model.spans(t, p) for t, p in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(model.score, found), pa.float64()), pa.array(spans, _TAGGED.field(2).type)], schema=_TAGGED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start long, end long, p double>>")


def reject_toxic(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = model.marginals(part.column("text").to_pylist())
                yield part.filter(pa.array([model.score(p) < threshold for p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled ones that are not held out."""
    docs = texts(spark, sf_dir, "documents")
    found = tag(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
