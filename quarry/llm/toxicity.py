"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.spark import arrow_map, crc_mod, documents, small_batches, trim
from quarry.llm.text import NOT_ALNUM, Words, chunks, code_points, grams, mix

#: Labelled documents, toxic and clean, that the model is fitted on, about (a hash picks them).
SAMPLE_TOXIC = 1200
SAMPLE_CLEAN = 3600
#: Stems (leading code points) that are features beside the whole word.
STEMS = (4, 5, 6, 7)
#: Features that the model keeps: those whose toxic documents are no chance (natural log of its bound), the surest first.
SURE = 12.0
MOST_FEATURES = 4096
#: Tokens on each side of a labelled one that a training sequence takes; sequences around labelled tokens, and from clean
#: documents, of each of two sorts, at most.
AROUND = 6
MOST_TAGGED = 20_000
MOST_CLEAN = 10_000
#: Sequences whose marginals are held at once.
HELD = 8192
STEPS = 150
RATE = 0.1
RIDGE = 1e-4
THRESHOLD = 0.7


def word_features(w: Words, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(token, hash) of each feature of all tokens, or some: the word, and its stems where the word is longer."""
    of = np.arange(len(w.start)) if of is None else of
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cp = code_points(w.data)
    place = np.r_[np.flatnonzero((w.data & 0xC0) != 0x80), len(w.data)]
    token, hashes = [of], [w.hash[of]]
    length = (cp[w.end] - cp[w.start])[of]
    for k in STEMS:
        i = of[length > k]
        token.append(i)
        hashes.append(mix(w.span_hash(w.start[i], place[cp[w.start[i]] + k]) ^ np.uint64(k)))
    return np.concatenate(token), np.concatenate(hashes)


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, code point by code point, so offsets in code points stay."""
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _chain(emit: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward-backward of many sequences of one length: log Z, node and edge marginals. emit: (sequences, length, 2).

    Each step's sums are scaled to one, so probabilities do instead of their logarithms.
    """
    n, m, _ = emit.shape
    top = emit.max(-1)
    e = np.exp(emit - top[..., None]).transpose(2, 1, 0).copy()  # (2, length, sequences)
    step, f, b, scale = np.exp(trans), np.empty((2, m, n)), np.ones((2, m, n)), np.empty((m, n))
    f[:, 0] = np.exp(start)[:, None] * e[:, 0]
    for t in range(m):
        if t:
            f[0, t] = (f[0, t - 1] * step[0, 0] + f[1, t - 1] * step[1, 0]) * e[0, t]
            f[1, t] = (f[0, t - 1] * step[0, 1] + f[1, t - 1] * step[1, 1]) * e[1, t]
        scale[t] = f[0, t] + f[1, t]
        f[:, t] /= scale[t]
    e /= scale
    for t in range(m - 2, -1, -1):
        x, y = e[0, t + 1] * b[0, t + 1], e[1, t + 1] * b[1, t + 1]
        b[0, t], b[1, t] = step[0, 0] * x + step[0, 1] * y, step[1, 0] * x + step[1, 1] * y
    e *= b
    edge = step * (f[:, :-1].reshape(2, -1) @ e[:, 1:].reshape(2, -1).T)
    return np.log(scale).sum(0) + top.sum(1), (f * b).transpose(2, 1, 0), edge


@dataclass
class Crf:
    """Weights of features (for tag 1), bias, transitions, start; and the weights of a document's marginals in its score."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    scale: tuple[float, ...] = (0.0, 0.0, 0.0, -5.0)

    def __post_init__(self):
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        # k background tokens in a row act as the k-th power of one matrix, up to a factor
        step = np.exp(self.trans + np.array([0.0, self.bias]))
        values, right = np.linalg.eig(step)
        values, right = values.real, right.real
        order = np.argsort(-values)
        values, right = values[order], right[:, order]
        left = np.linalg.inv(right)
        self.main, self.rest = np.outer(right[:, 0], left[0]), np.outer(right[:, 1], left[1])
        self.ratio = values[1] / values[0]

    def _power(self, k: int) -> np.ndarray:
        return self.main + self.ratio**k * self.rest

    def lookup(self, token, hashes) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with known features, and the sums of their weights."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        keep = np.flatnonzero(self.bits[(hashes >> np.uint64(46)).astype(np.int64)])
        i = np.searchsorted(self.keys, hashes[keep])
        i[i == len(self.keys)] = 0
        hit = self.keys[i] == hashes[keep]
        at, back = np.unique(token[keep[hit]], return_inverse=True)
        return at, np.bincount(back, self.weights[i[hit]], len(at)) if len(at) else np.zeros(0)

    def marginals(self, at: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """P(tag 1) of the tokens at ``at`` of a sequence of n tokens, all others being background: exact, in time of their number."""
        gaps = np.diff(np.r_[-1, at]) - 1
        nodes = np.exp(np.stack([np.zeros(len(at)), np.clip(self.bias + score, -30, 30)], 1))
        step = np.exp(self.trans)
        forward = np.empty((len(at), 2))
        x = None
        for k, gap in enumerate(gaps):
            if x is None:
                x = np.exp(self.start) if gap == 0 else (np.exp(self.start) * np.exp([0.0, self.bias])) @ self._power(gap - 1) @ step
            else:
                x = x @ self._power(gap) @ step if gap else x @ step
            x = x * nodes[k]
            x = x / x.sum()
            forward[k] = x
        y = self._power(n - 1 - at[-1]) @ np.ones(2)
        out = np.empty(len(at))
        for k in range(len(at) - 1, -1, -1):
            p = forward[k] * y
            out[k] = p[1] / p.sum()
            gap = gaps[k]
            y = step @ (nodes[k] * y)
            y = self._power(gap) @ y if gap else y
            y = y / y.sum()
        return out

    def score(self, words: Words):
        """Per row the document score, and per row its (token, marginal) above one half."""
        x, spans = self.aggregate(words)
        return 0.5 * (1 + np.tanh(0.5 * (x @ np.array(self.scale)))), spans

    def aggregate(self, words: Words):
        """Per row what its marginals add up to: log odds of any toxic token, their log number, log rate, 1."""
        x = np.empty((words.rows, 4))
        x[:] = _summary(np.zeros(0), 0)
        x[:, 2] = np.log(_FEW / (words.count + _SHORT))
        spans = {}
        at, weight = self.lookup(*word_features(words))
        row = words.row[at] if len(at) else at
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for f, t in zip(cuts, [*cuts[1:], len(row)]):
            r = row[f]
            n = int(words.first[r + 1] - words.first[r])
            p = self.marginals(at[f:t] - words.first[r], weight[f:t], n)
            x[r] = _summary(p, n)
            if (p > 0.5).any():
                spans[int(r)] = (at[f:t][p > 0.5], p[p > 0.5])
        return x, spans


_FEW, _SHORT = 0.05, 50.0


def _summary(p: np.ndarray, n: int) -> tuple[float, ...]:
    none = float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())  # log chance of no toxic token, marginals taken as independent
    some = min(max(-np.expm1(none), 1e-4), 1 - 1e-4)
    return np.log(some / (1 - some)), np.log1p(p.sum()), np.log((p.sum() + _FEW) / (n + _SHORT)), 1.0


class Sample:
    """The labelled texts as tokens, built chunk by chunk; features are kept once a distinct word."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray):
        self.texts, self.toxic = lowered(texts), toxic
        kinds, first, hashes, minima, pairs = [np.zeros(0, np.uint64)], [], [], [], []
        for w in self.parts():
            seen, example = np.unique(w.hash, return_index=True)
            new = ~np.isin(seen, kinds[0], assume_unique=True)
            token, feature = word_features(w, example[new])
            pairs.append((w.hash[token], feature))
            kinds[0] = np.union1d(kinds[0], seen[new])
            hashes.append(w.hash), first.append(w.count), minima.append(_minima(w))
        self.kinds = kinds[0]
        #: kind of each token, and the tokens of row r: first[r] to first[r + 1]
        self.kind = np.searchsorted(self.kinds, np.concatenate(hashes)).astype(np.int32)
        self.first = np.r_[0, np.cumsum(np.concatenate(first))]
        self.row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(self.first))
        del hashes
        owner = np.searchsorted(self.kinds, np.concatenate([x for x, _ in pairs])).astype(np.int32)
        self.keys, key = np.unique(np.concatenate([x for _, x in pairs]), return_inverse=True)
        del pairs
        order = np.argsort(owner, kind="stable")
        self.key = key[order].astype(np.int32)
        self.cuts = np.searchsorted(owner[order], np.arange(len(self.kinds) + 1))
        self.weight = _copy_weights(np.concatenate(minima))

    def parts(self):
        for _, data, offs in chunks(self.texts):
            yield Words(data, offs, NOT_ALNUM)

    def features(self, kinds: np.ndarray):
        """(index into kinds, feature) pairs."""
        n = np.diff(self.cuts)[kinds]
        return np.repeat(np.arange(len(kinds)), n), self.key[np.repeat(self.cuts[kinds], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def document_counts(self):
        """Per feature the documents, and the toxic ones, that have it; copies of a document share one count."""
        total, bad = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        for lo in range(0, len(self.toxic), 200):
            hi = min(lo + 200, len(self.toxic))
            part = slice(self.first[lo], self.first[hi])
            held = np.unique((self.row[part] - lo) * np.int64(len(self.kinds)) + self.kind[part])
            i, f = self.features(held % len(self.kinds))
            held = np.unique((held // len(self.kinds))[i] * len(self.keys) + f)
            row, f = lo + held // len(self.keys), held % len(self.keys)
            total += np.bincount(f, self.weight[row], len(self.keys))
            bad += np.bincount(f, (self.weight * self.toxic)[row], len(self.keys))
        return total, bad


_MINIMA = 8


def _minima(w: Words) -> np.ndarray:
    """Per row the least of its hashed 5-grams under each of a few permutations; 0 for rows without one."""
    out = np.zeros((w.rows, _MINIMA), np.uint64)
    h, at = grams(w.hash, w.row, 5)
    if len(h):
        row = w.row[at]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for k in range(_MINIMA):
            out[row[first], k] = np.minimum.reduceat(mix(h ^ np.uint64(k + 1)), first)
    return out


def _copy_weights(minima: np.ndarray) -> np.ndarray:
    """One over the number of sampled documents that are (near) copies of each other, by shared minima."""
    label = np.arange(len(minima))
    has = np.flatnonzero(minima.any(1))
    groups = [np.unique(minima[has, k], return_inverse=True)[1] for k in range(_MINIMA)] if len(has) else []
    for _ in range(4):
        for g in groups:
            least = np.full(g.max() + 1, len(minima))
            np.minimum.at(least, g, label[has])
            label[has] = np.minimum(label[has], least[g])
    return 1 / np.bincount(label, minlength=len(minima))[label]


def _token_labels(sample: Sample):
    """Features that tell toxic documents, sorted; for each token whether it carries a strong one in a toxic document; (token, index of feature) pairs."""
    total, bad = sample.document_counts()
    n1, n0 = sample.weight[sample.toxic].sum(), sample.weight[~sample.toxic].sum()
    odds = np.log((bad + 0.5) / n1) - np.log((total - bad + 0.5) / n0)
    # Chernoff's bound of so many toxic documents by chance, for some 1e5 features
    share, base = np.minimum(1, bad / np.maximum(total, 1e-9)), n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        unlikely = total * (np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base))))
    known = np.flatnonzero((unlikely > SURE) & (odds > 1))
    known = np.sort(known[np.argsort(-unlikely[known], kind="stable")][:MOST_FEATURES])
    place = np.full(len(sample.keys), -1)
    place[known] = np.arange(len(known))
    owner = np.repeat(np.arange(len(sample.kinds)), np.diff(sample.cuts))
    some = np.flatnonzero((np.bincount(owner, place[sample.key] >= 0, len(sample.kinds)) > 0)[sample.kind])
    i, f = sample.features(sample.kind[some])
    token, f = some[i][place[f] >= 0], place[f][place[f] >= 0]
    marked = np.zeros(len(sample.kind), bool)
    marked[token[odds[known][f] > 2]] = True
    return sample.keys[known], marked & sample.toxic[sample.row], token, f


def fit(texts: pa.Array, toxic: np.ndarray) -> Crf:
    """Fit the chain by gradient ascent (Adam) on sequences around labelled tokens (MOST_TAGGED) and from clean documents (MOST_CLEAN of any, and with a known feature)."""
    none = Crf(np.zeros(0, np.uint64), np.zeros(0), -10.0, np.zeros((2, 2)), np.zeros(2))
    if not toxic.any() or toxic.all():
        return none
    sample = Sample(texts, toxic)
    trim()
    keys, marked, token, index = _token_labels(sample)
    trim()
    if not len(keys) or not marked.any():
        return none
    length = 2 * AROUND + 1
    rng = np.random.default_rng(5)
    first, row = sample.first, sample.row
    bad = np.flatnonzero(marked)
    bad = bad[rng.permutation(len(bad))[:MOST_TAGGED]]
    begin = np.maximum(first[row[bad]], bad - rng.integers(0, length, len(bad)))
    begin = begin[begin + length <= first[row[begin] + 1]]
    # half of the clean sequences hold a known feature, so that the model learns what it must not say
    has = np.zeros(len(marked), bool)
    has[token] = True
    clean = np.flatnonzero(~toxic[row] & (np.arange(len(row)) + length <= first[row + 1]))
    near = clean[has[np.minimum(clean + AROUND, len(has) - 1)]]
    begin = np.concatenate([begin, *(x[rng.integers(0, len(x), MOST_CLEAN)] for x in (clean, near) if len(x))])
    if not len(begin):
        return none
    at = begin[:, None] + np.arange(length)
    tag = marked[at]
    # (place in the sequences, feature) pairs
    order = np.argsort(token, kind="stable")
    t, f = token[order], index[order]
    lo = np.searchsorted(t, at.ravel(), "left")
    n = np.searchsorted(t, at.ravel(), "right") - lo
    place = np.repeat(np.arange(at.size), n)
    feature = f[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    k = len(keys)
    theta, m1, m2 = np.zeros(k + 7), np.zeros(k + 7), np.zeros(k + 7)
    theta[k] = -2.0
    want = np.zeros(k + 7)
    want[:k] = np.bincount(feature, tag.ravel()[place], k)
    want[k] = tag.sum()
    want[k + 1 : k + 5] = np.bincount((2 * tag[:, :-1] + tag[:, 1:]).ravel(), minlength=4)
    want[k + 5 :] = np.bincount(tag[:, 0].astype(int), minlength=2)
    for step in range(1, STEPS + 1):
        score = theta[k] + np.bincount(place, theta[feature], at.size).reshape(at.shape)
        p, edges, starts = np.empty(at.shape), np.zeros((2, 2)), np.zeros(2)
        for lo in range(0, len(at), HELD):
            part = score[lo : lo + HELD]
            _, node, edge = _chain(np.stack([np.zeros(part.shape), part], -1), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :])
            p[lo : lo + HELD], edges, starts = node[..., 1], edges + edge, starts + node[:, 0].sum(0)
        have = np.concatenate([np.bincount(feature, p.ravel()[place], k), [p.sum()], edges.ravel(), starts])
        g = (want - have) / len(at) - RIDGE * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    model = Crf(keys, theta[:k], float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :])
    model.scale = tuple(_logistic(np.concatenate([model.aggregate(w)[0] for w in sample.parts()]), toxic).tolist())
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, halved while they don't help; a prior keeps separable classes finite."""
    sign = np.where(y, 1.0, -1.0)
    w = np.full(len(y), 1 / len(y))
    prior = 0.002 * np.array([1, 1, 1, 0.1])
    loss = lambda t: (w * np.logaddexp(0, -sign * (x @ t))).sum() + 0.5 * (prior * t * t).sum()
    t = np.zeros(4)
    for _ in range(60):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ t)))
        g = x.T @ (w * (y - p)) - prior * t
        d = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(prior), g)
        while loss(t + d) > loss(t) and abs(d).max() > 1e-9:
            d /= 2
        t = t + d
        if abs(d).max() < 1e-6:
            break
    return t


def train(docs: DataFrame, labels: DataFrame) -> Crf:
    """Fit on a sample of labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    A hash of doc_id picks about SAMPLE_TOXIC and SAMPLE_CLEAN documents; only
    their texts and labels come to the driver.  Rows with null in doc_id or
    toxic don't take part; of repeated labels the highest counts, of documents
    that share an id one.  Near copies in the sample share one vote.  Null and
    empty texts count as documents without tokens; of very long texts all tokens
    take part.  Without both classes, or with an empty table, the model scores
    every document alike, near 0.  Extra columns are ignored.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod(3) != 1).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("l_toxic"))
    n = {bool(r[0]): r[1] for r in known.groupBy(F.col("l_toxic") > 0).count().collect()}
    share = F.when(F.col("l_toxic") > 0, SAMPLE_TOXIC / max(1, n.get(True, 1))).otherwise(SAMPLE_CLEAN / max(1, n.get(False, 1)))
    picked = known.where(F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    # some SAMPLE_TOXIC + SAMPLE_CLEAN ids of 12 bytes; repeated rows of a document count once
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["l_id"]).select("l_id", "text", "l_toxic").dropDuplicates(["l_id"])
    got = rows.select("text", (F.col("l_toxic") > 0).alias("toxic"), "l_id").toArrow().sort_by("l_id")
    model = fit(got["text"].combine_chunks(), got["toxic"].to_numpy(zero_copy_only=False).astype(bool))
    del got
    trim()
    return model


def score_documents(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, marginal of each toxic token, in code points) for each row.

    Scores come from the text alone, so repeated texts score alike.  Null and
    empty texts have no token and get the score of a document without a toxic
    one; very long texts are scored whole; rows stay, repeated or not.  An empty
    table gives no rows.  Extra columns are ignored.  One pass, no shuffle.
    """

    def run(batches):
        for b in batches:
            for at, data, offs in chunks(lowered(b.column(2))):
                w = Words(data, offs, NOT_ALNUM)
                score, found = model.score(w)
                cp = code_points(data)
                spans = [None] * w.rows
                for r, (tokens, p) in found.items():
                    spans[r] = [{"start": s, "end": e, "marginal": m} for s, e, m in zip((cp[w.start[tokens]] - cp[offs[r]]).tolist(), (cp[w.end[tokens]] - cp[offs[r]]).tolist(), p.tolist())]
                part = slice(at, at + w.rows)
                yield {"doc_id": b.column(0)[part], "held_out": b.column(1)[part], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32), "spans": [x or [] for x in spans]}

    rows = docs.select(F.col("doc_id").cast("bigint"), crc_mod(3) == 1, "text")
    return arrow_map(rows, run, "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def without_toxic(docs: DataFrame, model: Crf) -> DataFrame:
    """The documents, all columns as they are, that the model doesn't predict toxic; no shuffle.  Odd rows as in score_documents()."""
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            score = [model.score(Words(data, offs, NOT_ALNUM))[0] for _, data, offs in chunks(lowered(b.column(place)))]
            keep = np.concatenate([np.zeros(0), *score]) < THRESHOLD
            yield b if keep.all() else b.filter(keep)
        trim()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, documents(spark, sf_dir, "labels")))
