"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import Sieve, pack_keys, passes
from quarry.llm.spark import arrow_map, documents, release, small_batches, stash, trim
from quarry.llm.text import NOT_ALNUM, Words, chunks, code_points, mix

#: Masks over token positions: 1 is hashed, 0 is ignored, so a hit survives a substitution there.  Items of LONG tokens or
#: more need four tokens that fit, shorter ones three; the masks are such that items with half of their tokens replaced are hit.
MASKS = ("1111", "11011", "110101", "1010011", "1100101", "10010101", "110001001")
SHORT_MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
LONG = 20
#: Items with fewer tokens would match ordinary prose and are searched for only on request, without substitutions.
LEAST_TOKENS = 5
#: Share of an item's tokens that must be found for a document to count as contaminated.
COVERAGE = 0.5
#: A mismatch in an overlap costs so many matches.
PENALTY = 1.5
#: Diagonals that are this far apart at most belong to one place.
DRIFT = 8
#: Bytes of benchmark text whose seeds go to every task.
BLOCK_BYTES = 2 << 20
#: Contaminated documents up to which their keys are broadcast (8 bytes each); beyond, a shuffle join.
BROADCAST = 200_000
#: Pieces of an item that follow in order add up within so many times its length.
REACH = 2
_LANES = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def seed_hashes(tokens: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each place of the mask within a row; ignored positions play no part."""
    m = len(tokens) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            h += tokens[j : j + m] * _LANES[j]
    at = np.flatnonzero(row[:m] == row[len(mask) - 1 :])
    return mix(h[at] ^ np.uint64(int(mask, 2) * 2 + len(mask))), at


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that find an item of n tokens."""
    return MASKS if n >= LONG else SHORT_MASKS if n >= LEAST_TOKENS else ("1" * n,)


def needed(n: int) -> float:
    """Tokens of an item of n that a document must hold."""
    return max(min(n, LEAST_TOKENS), COVERAGE * n)


class SeedIndex:
    """Seed hashes of benchmark items, sorted, with a bit table in front."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_TOKENS):
        """least: tokens of the shortest items that are searched for."""
        self.ids, self.tokens = [], []
        self.masks: set[str] = set()
        key, item, at = [], [], []
        column = pa.array([t or "" for _, t in items], pa.large_string())
        for first, data, offs in chunks(column):
            w = Words(data, offs, NOT_ALNUM)
            for r in range(w.rows):
                t = w.hash[w.first[r] : w.first[r + 1]]
                if len(t) < max(1, least):
                    continue
                self.masks.update(masks_of(len(t)))
                for mask in masks_of(len(t)):
                    h, pos = seed_hashes(t, np.zeros(len(t), np.int8), mask)
                    key.append(h), at.append(pos), item.append(np.full(len(h), len(self.ids)))
                self.ids.append(items[first + r][0]), self.tokens.append(t)
        none = np.zeros(0, np.int64)
        key = np.concatenate([none.view(np.uint64), *key])
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], np.concatenate([none, *item])[order], np.concatenate([none, *at])[order]
        self.shift = np.uint64(64 - min(26, max(20, len(self.key).bit_length() + 4)))
        self.bits = np.zeros(1 << 64 - int(self.shift), bool)
        self.bits[(self.key >> self.shift).astype(np.int64)] = True

    def hits(self, words: Words) -> np.ndarray:
        """Distinct (row, item, diagonal) of words whose seed meets an item's; diagonal: index of the item's first token among the words."""
        out = [np.zeros((0, 3), np.int64)]
        for mask in sorted(self.masks):
            h, at = seed_hashes(words.hash, words.row, mask)
            keep = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, h[keep], "left"), np.searchsorted(self.key, h[keep], "right")
            found = hi > lo
            keep, lo, n = at[keep[found]], lo[found], (hi - lo)[found]
            i = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(keep, n)
            out.append(np.stack([words.row[place], self.item[i], place - self.at[i]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def overlaps(self, words: Words):
        """(row, item, matched tokens, first word, end word) of documents that hold enough of an item; best_place() says how."""
        hits = self.hits(words)
        if not len(hits):
            return
        pair = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1)])
        for f, t in zip(pair, [*pair[1:], len(hits)]):
            row, item = hits[f, :2].tolist()
            best = best_place(words, row, self.tokens[item], hits[f:t, 2])
            if best[0] >= needed(len(self.tokens[item])):
                yield row, item, *best


def best_place(words: Words, row: int, want: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    """(matched tokens, first word, end word) of the place in a row that matches most of an item.

    A place is one diagonal that a seed hit, all its matches counted; or the
    runs with the best sum of matches less PENALTY a mismatch on diagonals
    within DRIFT of the next (tokens were put in or left out), which add up by
    the item's tokens that they match; or, where these aren't the whole item,
    pieces that follow in order.
    """
    drifts = np.flatnonzero(np.r_[True, np.diff(diagonals) > DRIFT])
    best = max(_overlap(words, row, want, x) for x in np.split(diagonals, drifts[1:]))
    for diagonal in diagonals.tolist():
        lo, same = _same(words, row, want, diagonal)
        hit = np.flatnonzero(same)
        best = max(best, (len(hit), int(lo + hit[0]), int(lo + hit[-1] + 1))) if len(hit) else best
    if best[0] < len(want):
        best = max(best, in_order(_pieces(words, row, want, diagonals), REACH * len(want)))
    return best


def _same(words: Words, row: int, want: np.ndarray, diagonal: int) -> tuple[int, np.ndarray]:
    """(first word, whether it and each after it equal the item's token there)."""
    lo, hi = max(words.first[row], diagonal), min(words.first[row + 1], diagonal + len(want))
    return int(lo), words.hash[lo:hi] == want[lo - diagonal : hi - diagonal]


def _overlap(words: Words, row: int, want: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    matched, first, end = np.zeros(len(want), bool), None, 0
    for diagonal in diagonals:
        lo, same = _same(words, row, want, diagonal)
        a, b = best_run(same)
        if b - a < LEAST_TOKENS:
            continue
        matched[lo - diagonal + a : lo - diagonal + b] |= same[a:b]
        first, end = min(lo + a, lo + a if first is None else first), max(lo + b, end)
    return int(matched.sum()), int(first or 0), int(end)


def _pieces(words: Words, row: int, want: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(first word, end word, first item token, matches) of all runs of LEAST_TOKENS or more, on all diagonals."""
    out = []
    for diagonal in diagonals.tolist():
        lo, same = _same(words, row, want, diagonal)
        parts = [(0, len(same))]
        while parts:
            x, y = parts.pop()
            a, b = best_run(same[x:y])
            if b - a >= LEAST_TOKENS:
                out.append((lo + x + a, lo + x + b, lo + x + a - diagonal, same[x + a : x + b]))
                parts += [(x, x + a), (x + b, y)]
    return sorted(out, key=lambda p: p[:3])


def best_run(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the best sum of matches less PENALTY a mismatch."""
    total = np.r_[0, np.cumsum(np.where(same, 1.0, -PENALTY))]
    b = int(np.argmax(total - np.minimum.accumulate(total)))
    return (int(np.argmin(total[:b])) if b else 0), b


def in_order(pieces: list[tuple[int, int, int, np.ndarray]], reach: int) -> tuple[int, int, int]:
    """(matched item tokens, first, end word) of the best chain of pieces that follow in document and item, within reach words."""
    best = (0, 0, 0)
    for i, (first, end, _, same) in enumerate(pieces):
        chains = [(int(same.sum()), end, i)]  # best chains from piece i: matched, end, last piece
        for j in range(i + 1, len(pieces)):
            f, e, at, m = pieces[j]
            if f >= first + reach:
                break
            if e > first + reach:
                continue
            after = []
            for got, _, k in chains:
                pf, pe, pat, pm = pieces[k]
                done = pat + len(pm)
                if f > pf and e > pe and at > pat and at + len(m) > done:
                    after.append(got + int(m[max(0, done - at) :].sum()))
            if after:
                chains.append((max(after), e, j))
        got, end, _ = max(chains)
        best = max(best, (got, first, end))
    return best


_FOUND = "doc_id bigint, item_id bigint, item_tokens bigint, matched bigint, coverage double, start bigint, end bigint"


def _small(benchmark: DataFrame) -> bool:
    """Whether the benchmark's seeds fit a task (some 150 bytes for each token)."""
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BLOCK_BYTES


def _index(benchmark: DataFrame, least: int) -> SeedIndex:
    return SeedIndex([(r[0], r[1]) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").collect()], least)


def _row(doc_id, item_id, want, place, words: Words, row: int, zero: int, cp: np.ndarray) -> tuple:
    matched, first, end = place
    return doc_id, item_id, len(want), matched, matched / len(want), int(cp[words.start[first]] - zero), int(cp[words.end[end - 1]] - zero)


def _table(rows: list[tuple]) -> dict:
    return dict(zip(("doc_id", "item_id", "item_tokens", "matched", "coverage", "start", "end"), map(list, zip(*rows))))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """A row for each document and benchmark item that it holds at least COVERAGE of, and LEAST_TOKENS tokens.

    Columns: doc_id, item_id, item_tokens, matched (tokens of the item found),
    coverage, start, end (code points of the document, end exclusive).  Tokens
    are runs of letters and digits, A-Z lower-cased.  Of several places of an
    item the one that matches most is reported, of equal ones the last.  Pieces
    of an item that follow in order add up within REACH times its length.  Items
    of fewer than ``least`` tokens are not searched for: below LEAST_TOKENS they
    would match ordinary prose; with a smaller ``least`` they are found whole,
    without substitutions.

    Null and empty texts hold nothing; null ids pass through; repeated documents
    or items give repeated rows; very long texts are searched whole.  An empty
    table or benchmark gives no rows.  Extra columns are ignored, whatever their
    names.  A benchmark of up to BLOCK_BYTES goes to every task, and the
    documents are passed over once; the seed hashes of a larger one are a table
    that those of the documents are joined with.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if _small(benchmark):
        return arrow_map(docs, _report(_index(benchmark, least)), _FOUND)
    return arrow_map(_met(docs, benchmark, least), _verify, _FOUND)


def _report(index: SeedIndex):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, data, offs in chunks(b.column(1)):
                w = Words(data, offs, NOT_ALNUM)
                found = list(index.overlaps(w))
                if found:
                    cp = code_points(data)
                    yield _table([_row(ids[at + row], index.ids[item], index.tokens[item], place, w, row, cp[offs[row]], cp) for row, item, *place in found])

    return run


# -- benchmarks of any size


def _item_seeds(least: int):
    """Rows (hash, item, at), and a block of each batch's hashes for the sieve."""

    def run(batches):
        for b in batches:
            index = SeedIndex(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), least)
            if len(index.key):
                yield {"hash": index.key.view(np.int64), "item": np.array(index.ids, np.int64)[index.item], "at": index.at, "a": pa.nulls(len(index.key), pa.binary())}
                yield {"hash": [None], "item": [None], "at": [None], "a": [pack_keys(np.unique(index.key))]}

    return run


def _document_seeds(sieve: Sieve):
    """Rows (hash, doc, place) of the seeds that an item may have."""

    def run(batches):
        for b in batches:
            table = sieve.table()
            doc = np.asarray(b.column(0))
            for at, data, offs in chunks(b.column(1)):
                w = Words(data, offs, NOT_ALNUM)
                for mask in (*MASKS, *SHORT_MASKS, *("1" * n for n in range(1, LEAST_TOKENS) if "1" * n not in SHORT_MASKS)):
                    h, place = seed_hashes(w.hash, w.row, mask)
                    may = np.flatnonzero(passes(table, h))
                    row = w.row[place[may]]
                    yield {"hash": h[may].view(np.int64), "doc": doc[at + row], "place": place[may] - w.first[row]}

    return run


def _key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce(F.col("text"), F.lit("")))


def _met(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """doc_id, text, items (item_id, text, diagonals) of the documents whose seeds meet an item's; rows with equal ids and texts are searched once and all get the result."""
    items = stash(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "items")
    seeds = stash(arrow_map(items.select("item", "text"), _item_seeds(least), "hash bigint, item bigint, at bigint, a binary"), "seeds")
    keyed = docs.select(_key().alias("doc"), "text")
    asked = arrow_map(keyed, _document_seeds(Sieve(seeds.where("a is not null"))), "hash bigint, doc bigint, place bigint").distinct()
    met = asked.join(seeds.where("a is null").select("hash", "item", "at"), "hash").groupBy("doc", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    pairs = met.join(items, "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", "text", "diagonals")).alias("items"))
    pairs = stash(pairs, "met")
    release(items, seeds)
    return docs.withColumn("_doc", _key()).join(pairs, F.col("_doc") == F.col("doc")).select("doc_id", "text", "items")


def _verify(batches):
    for b in batches:
        for r in range(b.num_rows):
            doc_id, items, rows = b.column(0)[r].as_py(), b.column(2)[r].as_py(), []
            for _, data, offs in chunks(b.column(1).slice(r, 1)):
                w, cp = Words(data, offs, NOT_ALNUM), code_points(data)
                for item in items:
                    (_, item_data, item_offs), *_ = chunks(pa.array([item["text"]], pa.large_string()))
                    want = Words(item_data, item_offs, NOT_ALNUM).hash
                    place = best_place(w, 0, want, np.array(sorted(item["diagonals"]), np.int64))
                    if place[0] >= needed(len(want)):
                        rows.append(_row(doc_id, item["item_id"], want, place, w, 0, 0, cp))
            if rows:
                yield _table(rows)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """The documents, all columns as they are, that hold no benchmark item; no shuffle while the benchmark is small.

    Odd rows and items: as in contaminated(); documents without text stay.
    """
    if not _small(benchmark):
        text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        met = _met(text, benchmark, least)
        bad = stash(arrow_map(met.select(_key().alias("doc_id"), "text", "items"), _verify, _FOUND).select(F.col("doc_id").alias("_quarry_doc")).distinct(), "bad")
        few = bad.count() <= BROADCAST
        own = F.xxhash64(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-1)), F.coalesce(docs["text"], F.lit("")))
        return docs.join(F.broadcast(bad) if few else bad, own == F.col("_quarry_doc"), "left_anti")
    index, place = _index(benchmark, least), docs.columns.index("text")

    def run(batches):
        for b in batches:
            bad = np.zeros(b.num_rows, bool)
            for at, data, offs in chunks(b.column(place)):
                for row, *_ in index.overlaps(Words(data, offs, NOT_ALNUM)):
                    bad[at + row] = True
            yield b.filter(~bad) if bad.any() else b
        trim()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op5_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
