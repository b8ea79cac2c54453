"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.spark import arrow_map, documents, stash
from quarry.llm.text import mix

#: Two prime moduli and bases: a span's hash has 62 bits.
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_013)
#: Code points of the spans that are sampled (a third of the text, if that is less), and how many a fingerprint keeps.
SPAN = 24
KEPT = 32
#: One in so many spans of a longer text is looked for in another.
ANCHOR = 16
#: Code points of the longest text whose powers are kept (32 bytes each).
REMEMBERED = 1 << 20
#: Bytes of text for each partition, where the session's number of partitions would make them larger.
PARTITION_BYTES = 64 << 20
MOST_PARTITIONS = 1 << 17
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(k: int, n: int) -> list[np.ndarray]:
    """B**i and B**-i modulo prime k, for i < n; kept for the next text unless there are very many."""
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        p = PRIMES[k]
        have = []
        for base in (BASES[k], pow(BASES[k], -1, p)):
            x = np.ones(1, np.uint64)
            while len(x) < max(n, 1 << 16):
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), p)) % np.uint64(p)])
            have.append(x)
        if n <= REMEMBERED:
            _POWERS[k] = have
    return have


class PrefixHash:
    """Prefix hashes of a text: equality of any two spans in O(1), longest common extension by binary search."""

    def __init__(self, codes: np.ndarray, shared: PrefixHash | None = None, keep: int = 0):
        """codes: code points.  The first ``keep`` prefixes are taken from ``shared``, whose text starts alike."""
        self.n = len(codes)
        self.sums, self.down = [], []
        x = (codes[keep:].astype(np.uint64) + np.uint64(1)) * np.uint64(2654435761)
        for k, p in enumerate(PRIMES):
            up, down = _powers(k, self.n + 1)
            sums = np.empty(self.n + 1, np.uint64)
            sums[: keep + 1] = shared.sums[k][: keep + 1] if shared else 0
            np.cumsum(x % np.uint64(p) * up[keep : self.n] % np.uint64(p), out=sums[keep + 1 :])
            sums[keep + 1 :] += sums[keep]
            self.sums.append(sums)
            self.down.append(down)

    def spans(self, start, end) -> np.ndarray:
        """62-bit hashes of spans (arrays of starts and ends)."""
        out = np.uint64(0)
        for k, p in enumerate(PRIMES):
            h = (self.sums[k][end] - self.sums[k][start]) % np.uint64(p) * self.down[k][start] % np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of a size, by slices instead of indexes."""
        m = self.n - size + 1
        out = np.zeros(m, np.uint64)
        for k, p in enumerate(PRIMES):
            h = (self.sums[k][size:] - self.sums[k][:m]) % np.uint64(p) * self.down[k][:m] % np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans of a length at i here and at j there are equal."""
        for k, p in enumerate(PRIMES):
            a, b, sums, others = self.sums[k], other.sums[k], self.down[k], other.down[k]
            if (a.item(i + length) - a.item(i)) * sums.item(i) % p != (b.item(j + length) - b.item(j)) * others.item(j) % p:
                return False
        return True

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common span from i here and j there."""
        return _longest(min(self.n - i, other.n - j), lambda m: self.same(i, other, j, m))

    def extension_back(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common span that ends at i here and at j there."""
        return _longest(min(i, j), lambda m: self.same(i - m, other, j - m, m))


def _longest(most: int, holds) -> int:
    """The greatest length up to ``most`` for which it holds, by doubling and halving."""
    step = 1
    while step <= most and holds(step):
        step *= 2
    lo, hi = step // 2, min(most, step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid - 1)
    return lo


def _span(n: int) -> int:
    """Code points of the spans by which a text of n is compared: some lie inside any two thirds of it."""
    return max(1, min(SPAN, n // 3))


class Print:
    """Length, hash of the whole text, and the KEPT least mixed hashes of its spans."""

    def __init__(self, h: PrefixHash):
        self.whole = (h.n, int(h.spans(0, h.n)))
        self.h = h
        self.samples: dict[int, np.ndarray] = {}
        self.least = self.sample(_span(h.n))

    def sample(self, span: int) -> np.ndarray:
        """The KEPT least mixed hashes of the spans of a size."""
        if span not in self.samples:
            x = mix(self.h.windows(span)) if self.h.n >= span else np.zeros(0, np.uint64)
            x >>= np.uint64(32)
            least = np.unique(np.partition(x, 2 * KEPT)[: 2 * KEPT]) if len(x) > 2 * KEPT else np.unique(x)
            if len(least) < KEPT < len(x):
                least = np.unique(x)
            self.samples[span] = least[:KEPT].astype(np.uint32)
        return self.samples[span]

    def __str__(self) -> str:
        return f"{self.whole[0]:x}-{self.whole[1]:016x}-{self.least.astype('>u4').tobytes().hex()}"

    def likeness(self, other: Print) -> float:
        """Share of both texts in common spans; 1 for equal texts.

        Common spans are the longest common prefix and suffix, and the longest
        extensions to both sides of equal spans that the fingerprints' samples
        lead to, all by equality of span hashes; each has the length of a
        sampled span at least.
        """
        if self.whole == other.whole:
            return 1.0
        a, b, span = self.h, other.h, _span(min(self.h.n, other.h.n))
        if span > min(a.n, b.n):
            return 0.0
        found = []  # (start here, start there, length)
        if a.same(0, b, 0, span):
            found.append((0, 0, a.extension(0, b, 0)))
        if a.same(a.n - span, b, b.n - span, span):
            n = a.extension_back(a.n, b, b.n)
            found.append((a.n - n, b.n - n, n))
        if len(np.intersect1d(self.sample(span), other.sample(span), True)):
            for i, j in _anchors(a, b, span):
                if not any(x <= i and i + span <= x + n and y <= j and j + span <= y + n for x, y, n in found):
                    back = a.extension_back(i, b, j)
                    found.append((i - back, j - back, back + a.extension(i, b, j)))
        return (_covered((x, n) for x, _, n in found) + _covered((y, n) for _, y, n in found)) / (a.n + b.n)


def _anchors(a: PrefixHash, b: PrefixHash, span: int) -> list[tuple[int, int]]:
    """(place here, place there) of equal spans, first occurrences, picked by their hash: one in ANCHOR."""
    picked = []
    for h in (a, b):
        x = mix(h.windows(span))
        at = np.flatnonzero(x % np.uint64(ANCHOR) == 0) if h.n > ANCHOR * KEPT else np.arange(len(x))
        picked.append((x[at], at))
    (x, i), (y, j) = picked
    _, p, q = np.intersect1d(x, y, return_indices=True)
    return sorted(zip(i[p].tolist(), j[q].tolist()))


def _covered(spans) -> int:
    """Places that spans (start, length) cover together."""
    total = end = 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """The last third (floor) of the code points replaced by as many first ones of the following text, or all."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def compare(text: str, h: PrefixHash, own: Print, following: str, following_h: PrefixHash, following_print: Print) -> tuple:
    """The result columns of a document and the one that follows."""
    new = edited(text, following)
    new_h = PrefixHash(_codes(new), h, len(text) - len(text) // 3)
    new_print = Print(new_h)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, str(own), str(new_print), own.likeness(new_print), own.likeness(following_print), h.extension(0, following_h, 0)


_OUT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "prefix_next")
_TYPES = ("bigint", "string", "string", "string", "double", "double", "bigint")


def _described(text: str):
    h = PrefixHash(_codes(text))
    return text, h, Print(h)


def _in_order(batches):
    """Rows (pid, doc_id, text) of one partition in order: a result for all but the last, which waits with the first text for the next partition."""
    held = None
    for b in batches:
        pid, rows, ends = 0, [], []
        for pid, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            now = _described(text or "")
            if held is None:
                ends.append((pid, 1, None, now[0]))
            else:
                rows.append((held[0], *compare(*held[1], *now)))
            held = (doc_id, now, pid)
        yield _table(rows, ends)
    if held:
        yield _table([], [(held[2], 2, held[0], held[1][0])])


def _table(rows, ends):
    nothing = [None] * len(_OUT)
    cols = list(zip(*([(None, 0, r[0], None, *r[1:]) for r in rows] + [(p, k, d, t, *nothing) for p, k, d, t in ends]))) or [[]] * (4 + len(_OUT))
    return dict(zip(("pid", "kind", "doc_id", "text", *_OUT), map(list, cols)))


def _ends(batches):
    """Rows (doc_id, text, following) to results."""
    for b in batches:
        rows = [(d, *compare(*_described(t or ""), *_described(f or ""))) for d, t, f in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield dict(zip(("doc_id", *_OUT), map(list, zip(*rows)))) if rows else pa.RecordBatch.from_pylist([])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, prefix_next for each row.

    Documents are taken by descending doc_id (null last; repeated ids by a hash of
    the text, equal rows in any order, which doesn't show in the result), and the
    first follows the last; the edit replaces a text's last third by the start of
    the document that follows.  A fingerprint is the length, the hash of the whole
    text, and the least of its mixed span hashes; Print.likeness() compares two.
    prefix_next is the length of the longest common prefix with the document that
    follows.  Null text is empty: two empty texts are alike (1), an empty and
    another are not (0).  An empty table gives no rows; a single document follows
    itself.  Very long texts are hashed whole, 50 bytes a code point at a time.
    Extra columns are ignored, whatever their names.  Texts go through one range
    shuffle; each partition pairs its own rows, and only its first and last row
    are matched across partitions.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("k"), F.col("i")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k"), F.monotonically_increasing_id().alias("i"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, _estimated_bytes(docs) // PARTITION_BYTES))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("pid"), "doc_id", "text")
    types = ", ".join(f"{c} {t}" for c, t in zip(_OUT, _TYPES))
    done = stash(arrow_map(rows, _in_order, f"pid int, kind int, doc_id bigint, text string, {types}"), "prints")
    # a row's follower is the first row of the next partition that has rows: numbers of partitions, and no texts, are put in order
    pids = done.where("kind = 1").select("pid")
    after = pids.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.first("pid").over(Window.orderBy("pid"))).alias("after"))
    heads = done.where("kind = 1").select(F.col("pid").alias("after"), F.col("text").alias("following"))
    pairs = done.where("kind = 2").select("pid", "doc_id", "text").join(F.broadcast(after), "pid").join(heads, "after").select("doc_id", "text", "following")
    return done.where("kind = 0").select("doc_id", *_OUT).unionByName(arrow_map(pairs, _ends, f"doc_id bigint, {types}"))


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def op7_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
