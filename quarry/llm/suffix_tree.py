"""Language-model scores from a probabilistic suffix tree over words.

Contexts are the last one to DEPTH words.  Strings (a context and the word after
it) are counted over all training text; all that occur LEAST times or more are
kept, with exact counts.  A longer string is counted where its two parts may be
such strings.  A context stays as a state if its next-word distribution diverges
from that of its longest kept suffix by more than its parameters cost.
Distributions are smoothed by absolute discounting, the discounted mass going to
the suffix state, down to add-one word frequencies.  A token is scored in the
longest suffix state of what precedes it.

On the logarithmic scale that is a sum over the strings of a text: a state adds
the logarithm of the mass that it leaves to its suffix, and a string of the tree
adds what its word's probability differs by from that mass times the suffix
state's probability.  So the tree is one table of keys and numbers, and a text's
score a sum of its entries.

Tables that grow with the corpus are dealt to places by the high bits of their
keys, and travel as packed blocks of sorted numbers.  lookup() sends sorted keys
to their places and the numbers found there back; a place holds about
the share of PLACE_BYTES of text, a part of the texts PART_BYTES.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import Sieve, distinct, grouped, pack, pack_keys, passes, steps, unpack, unpack_keys
from quarry.llm.spark import arrow_map, crc_mod, documents, release, stash, trim
from quarry.llm.text import Words, chunks, mix, unmix

#: Words of the longest context.
DEPTH = 3
#: Occurrences in training that a string needs, whatever the corpus.
LEAST = 2
#: Bytes of text that are scored together, with the part of the tree that they need.
PART_BYTES = 8 << 20
#: Tokens of a part that are worked on at once; a longer text comes alone.
CHUNK_TOKENS = 1 << 16
#: Bytes of text for each place of a table.
PLACE_BYTES = 8 << 20
#: Places of a table, at least.
PLACES = 64
#: Turns in which the parts ask for their entries and are scored.
TURNS = 2
#: Share of all training tokens of the words whose counts every task holds (at most 1 / WORD_SHARE); others are looked up.
WORD_SHARE = 1e-6
DISCOUNT = 0.75
#: Nats of training likelihood that a context must gain for each of its entries.
PRICE = 5.0
#: The numbers of entries are whole multiples of one over this; counts come divided by it.
FINE = 2.0**27
#: The token that ends every text.
END = np.uint64(0xE4D0F7EC7E11D0C5)
#: Distinct strings that a task holds before it hands their counts on.
HELD = 1 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)
_WORD = np.uint64(0xC2B2AE3D27D4EB4F)


def longer(string: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of strings and a word after each."""
    return mix(string * _STEP + word)


def word_key(word: np.ndarray) -> np.ndarray:
    """The keys under which words have their counts."""
    return mix(word ^ _WORD)


class Stream:
    """The tokens of a chunk, an END after each row's words, and the hashes of the strings that start at each."""

    def __init__(self, data, offs):
        w = Words(data, offs)
        self._hold(np.insert(w.hash, w.first[1:], END), w.count + 1)

    @classmethod
    def of(cls, kinds: np.ndarray, kind: np.ndarray, count: np.ndarray) -> Stream:
        """The rows of so many tokens each that are the kinds with these numbers."""
        s = cls.__new__(cls)
        s._hold(kinds[kind], count)
        s.kind = kind
        return s

    def _hold(self, token: np.ndarray, count: np.ndarray):
        self.rows, self.token, self.count = len(count), token, count
        self.row = np.repeat(np.arange(self.rows, dtype=np.int32), count)
        self.first = np.r_[0, np.cumsum(count)]
        self.strings = {1: token}

    def string(self, k: int) -> np.ndarray:
        """Hash of the k tokens that start at each token; 0 where the row ends before."""
        if k not in self.strings:
            out, at = np.zeros(len(self.token), np.uint64), self.starts(k)
            out[at] = longer(self.string(k - 1)[at], self.token[at + k - 1])
            self.strings[k] = out
        return self.strings[k]

    def starts(self, k: int) -> np.ndarray:
        """Tokens that have k - 1 more after them in their row."""
        return np.flatnonzero(self.row[: max(0, len(self.row) - k + 1)] == self.row[k - 1 :])


# -- blocks


def numbers(x: np.ndarray) -> np.ndarray:
    """Fractions as integers whose high bytes are alike (the sign comes last)."""
    i = np.rint(x * FINE).astype(np.int64)
    return ((i << 1) ^ (i >> 63)).view(np.uint64)


def fractions(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)) / FINE


def places(keys: np.ndarray, n: int) -> np.ndarray:
    """Of n places, ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_place(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(place, its run of sorted keys)."""
    at = places(keys, n)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    for f, t in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
        yield int(at[f]), slice(f, t)


_NAMES = ("kind", "place", "source", "a", "b")
_BLOCKS = "kind int, place bigint, source bigint, a binary, b binary"


def _block_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=_NAMES)


def _entries(kind: int, keys: np.ndarray, values: np.ndarray, n: int) -> list[tuple]:
    """Rows of keys and their numbers, at the keys' places."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    return [(kind, at, None, pack_keys(keys[i]), pack(values[i])) for at, i in by_place(keys, n)]


def _requests(kind: int, keys: np.ndarray, source: int, n: int) -> list[tuple]:
    """Rows that ask for the numbers of sorted distinct keys."""
    return [(kind, at, source, pack_keys(keys[i]), None) for at, i in by_place(keys, n)]


def _summed(entries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of blocks, sorted, and the sum of the entries of each."""
    none = np.zeros(0, np.uint64)
    keys = [unpack_keys(x.as_py()) for x in entries["a"]]
    values = [fractions(unpack(x.as_py())[0]) for x in entries["b"]]
    if len(keys) == 1:  # merged already
        return keys[0], values[0]
    keys, values = np.concatenate([none, *keys]), np.concatenate([none, *values])
    order, first, _ = grouped(keys)
    return keys[order[first]], np.add.reduceat(values[order], first) if len(first) else values


def _merged(entries: pa.Table) -> pa.Table:
    """The entries of a place as one block."""
    keys, values = _summed(entries)
    return _block_table([(0, entries["place"][0].as_py(), None, pack_keys(keys), pack(numbers(values)))])


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each request block: its source and place, and (a) the sums of the entries of each of its keys, 0 where there is none."""

    def find(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = _summed(known)
        rows = []
        for source, place, block in zip(asked["source"].to_pylist(), asked["place"].to_pylist(), asked["a"]):
            h = unpack_keys(block.as_py())
            out = np.zeros(len(h))
            if len(keys):
                i = np.searchsorted(keys, h)
                i[i == len(keys)] = 0
                out = np.where(keys[i] == h, values[i], 0.0)
            rows.append((0, place, source, pack(numbers(out)), None))
        return _block_table(rows)

    return requests.groupBy("place").cogroup(entries.groupBy("place")).applyInArrow(find, _BLOCKS)


def _answers(table: pa.Table) -> np.ndarray:
    """The numbers of a source's keys, in the keys' order."""
    blocks = sorted(zip(table["place"].to_pylist(), table["a"]), key=lambda x: x[0])
    return np.concatenate([np.zeros(0), *(fractions(unpack(x.as_py())[0]) for _, x in blocks)])


# -- counts


def _tally(held: list) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their counts) of parts that each have them."""
    keys, counts = (np.concatenate(c) for c in zip(*held))
    order, first, _ = grouped(keys)
    return keys[order[first]], np.add.reduceat(counts[order], first)


def _count_words(n: int):
    """Blocks of the words' keys and counts, added up within a task as far as memory allows."""

    def blocks(held):
        keys, counts = _tally(held)
        return _block_table([(0, at, None, pack_keys(keys[i]), pack(counts[i])) for at, i in by_place(keys, n)]).to_batches(200)

    def run(batches):
        held: list = []
        for part in _learned(batches):
            times = np.bincount(part.kind, minlength=len(part.kinds))
            some = np.flatnonzero(times)
            held.append((word_key(part.kinds[some]), times[some]))
            if sum(len(k) for k, _ in held) > 2 * HELD:
                held = [_tally(held)]
                if len(held[0][0]) > HELD:
                    yield from blocks(held)
                    held = []
        if held:
            yield from blocks(held)

    return run


def _add_words(table: pa.Table) -> pa.Table:
    """From the blocks of a place: an entry of each word's count (kind 0), and the keys of those that are repeated (kind 1)."""
    place = table["place"][0].as_py()
    keys, counts = _tally([(unpack_keys(a.as_py()), unpack(b.as_py())[0].view(np.int64)) for a, b in zip(table["a"], table["b"])])
    again = keys[counts >= LEAST]
    return _block_table([(0, place, None, pack_keys(keys), pack(numbers(counts / FINE))), *([(1, place, None, pack_keys(again), None)] if len(again) else [])])


def _word_counts(batches):
    """(keys, counts) of blocks of words."""
    for b in batches:
        for keys, values in zip(b.column("a"), b.column("b")):
            yield unpack_keys(keys.as_py()), np.rint(fractions(unpack(values.as_py())[0]) * FINE).astype(np.int64)


def _totals(batches):
    for keys, counts in _word_counts(batches):
        yield {"tokens": [int(counts.sum())], "words": [len(keys)]}


def _frequent(least: float):
    def run(batches):
        for keys, counts in _word_counts(batches):
            some = counts >= least
            yield {"word": unmix(keys[some]).view(np.int64) ^ _WORD.view(np.int64), "count": counts[some]}

    return run


def _code(words: Table, x: np.ndarray) -> np.ndarray:
    """Words as their numbers in a table, from 1; 0 for others."""
    code = np.zeros(len(x), np.uint64)
    i, at = words.places(x)
    code[i] = at + 1
    return code


def _others(code: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code, x[code == 0]


def _decoded(words: Table, code: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.empty(len(code), np.uint64)
    listed = code > 0
    out[listed] = words.keys[code[listed].view(np.int64) - 1]
    out[~listed] = others
    return out


def _string_blocks(k: int, words: Table, n: int, source, states: tuple, strings: tuple) -> Iterator[tuple]:
    """A row for each place with strings of k tokens.

    states: sorted contexts, how often each is seen, how many strings it has,
    and, of those that have any, the tail (the context without its first token);
    strings: the words after the contexts, and their counts.
    """
    context, seen, many, tail = states
    code = _code(words, strings[0])
    tail_code = _code(words, tail) if k == 3 else None
    ends, has = np.r_[0, np.cumsum(many)], np.r_[0, np.cumsum(many > 0)]
    for place, i in by_place(context, n):
        j, t = slice(ends[i.start], ends[i.stop]), slice(has[i.start], has[i.stop])
        tails = () if k == 2 else _others(tail_code[t], tail[t]) if k == 3 else (tail[t],)
        yield 0, place, source, pack(steps(context[i]), seen[i], many[i], *tails), pack(*_others(code[j], strings[0][j]), strings[1][j])


def _strings(k: int, words: Table, a: bytes, b: bytes) -> tuple:
    """(contexts, seen, many; of each string: context, tail, word, count) of a block."""
    context, seen, many, *tail = unpack(a)
    context, seen, many = np.cumsum(context, dtype=np.uint64), seen.view(np.int64), many.view(np.int64)
    code, others, count = unpack(b)
    has = many > 0
    tail = np.zeros(has.sum(), np.uint64) if k == 2 else _decoded(words, *tail) if k == 3 else tail[0]
    return context, seen, many, np.repeat(context, many), np.repeat(tail, many[has]), _decoded(words, code, others), count.view(np.int64)


def _count_strings(k: int, sieve: Sieve, words: Table, n: int):
    """Blocks of the strings of k tokens whose parts of k - 1 may all be repeated, at their contexts' places."""

    def blocks(held):
        context, string, word, tail = (np.concatenate(c) for c in zip(*held))
        held.clear()
        has = np.flatnonzero(string)
        order, first, count = grouped(string[has])
        pick = has[order[first]]
        pick = pick[by := np.argsort(context[pick])]
        of, word, tail, count = context[pick], word[pick], tail[pick] if k > 2 else word[pick], count[by]
        context = np.sort(context)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        context, seen = context[first], np.diff(np.r_[first, len(context)])
        at = np.searchsorted(of, context)
        many = np.diff(np.r_[at, len(of)])
        yield from _string_blocks(k, words, n, None, (context, seen, many, tail[at[many > 0]]), (word, count))

    def run(batches):
        held = []
        for part in _learned(batches):
            bits = sieve.table()
            known = passes(bits, word_key(part.kinds)) if k == 2 else None
            for s, _ in part.streams():
                short, at = s.string(k - 1), s.starts(k)
                may = known[s.kind] if k == 2 else passes(bits, short)
                at = at[may[at]]
                if not len(at):
                    continue
                word = s.token[at + k - 1]
                string = np.where(may[at + 1], longer(short[at], word), np.uint64(0))
                held.append((short[at], string, word, s.string(k - 2)[at + 1] if k > 2 else word[:0]))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from _block_table(list(blocks(held))).to_batches(200)
        if held:
            yield from _block_table(list(blocks(held))).to_batches(200)

    return run


def _add_up(k: int, words: Table, n: int):
    """From the blocks of a place: one with the strings that are repeated (kind 0), and requests for their suffixes (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        place = table["place"][0].as_py()
        parts = [_strings(k, words, a.as_py(), b.as_py()) for a, b in zip(table["a"], table["b"])]
        context, seen, _, of, tail, word, count = (np.concatenate(c) for c in zip(*parts))
        del parts
        order, first, _ = grouped(longer(of, word))
        count = np.add.reduceat(count[order], first) if len(first) else count
        kept = count >= LEAST
        pick, count = order[first[kept]], count[kept]
        if not len(pick):
            return _block_table([])
        pick, count = pick[by := np.argsort(of[pick])], count[by]
        of, word, tail = of[pick], word[pick], tail[pick]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        order, start, _ = grouped(context)
        seen = np.add.reduceat(seen[order], start)[np.searchsorted(context[order[start]], of[first])]
        strings = _string_blocks(k, words, n, place, (of[first], seen, np.diff(np.r_[first, len(of)]), tail[first]), (word, count))
        return _block_table([*strings, *_requests(1, distinct(_low_key(k, tail, word)), place, n)])

    return run


def _low_key(k: int, tail: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The keys of the strings' suffixes: words have their counts, longer ones their probabilities."""
    return word_key(word) if k == 2 else longer(tail, word)


# -- the tree


def smooth(count: np.ndarray, of: np.ndarray, seen: np.ndarray, low: np.ndarray):
    """(p of each string's word in its state, mass that each state leaves to its suffix, whether each state stays).

    count, of: of the strings and their states; seen: of the states; low: the
    words' probabilities in the suffix states.
    """
    n = len(seen)
    kept = (count - DISCOUNT) / seen[of]
    mass = np.maximum(1 - np.bincount(of, kept, n), 1e-9)
    p = kept + mass[of] * low
    rest = np.maximum(seen - np.bincount(of, count, n), 0)
    gain = np.bincount(of, count * np.log(p / low), n) + rest * np.log(mass)
    return p, mass, gain > PRICE * np.bincount(of, minlength=n)


def _level(k: int, words: Table, n: int, total: float):
    """From the strings of a place and the answers to its requests: probabilities of the strings' words (kind 0), and entries of the tree (kind 1)."""

    def run(strings: pa.Table, answers: pa.Table) -> pa.Table:
        context, seen, many, named, tail, word, count = _strings(k, words, strings["a"][0].as_py(), strings["b"][0].as_py())
        of = np.repeat(np.arange(len(context)), many)
        _, back = np.unique(_low_key(k, tail, word), return_inverse=True)
        low = _answers(answers)[back]
        low = (low * FINE + 1) / total if k == 2 else 10**low
        p, mass, stays = smooth(count.astype(float), of, seen.astype(float), low)
        string, log = longer(named, word), np.log10(p)
        mine = stays[of]
        rows = _entries(0, string, numbers(np.where(mine, log, np.log10(low))), n) if k <= DEPTH else []
        values = np.r_[(log - np.log10(low * mass[of]))[mine], np.log10(mass[stays])]
        return _block_table(rows + _entries(1, np.r_[string[mine], context[stays]], numbers(values), n))

    return run


def grow_tree(learn: DataFrame, words: DataFrame, listed: Table, total: float, n: int) -> DataFrame:
    """The tree's entries and the words' counts, a block for each place; words: those of _add_words(); listed: the words that every task holds."""
    levels, low, often = [], words.where("kind = 0"), words.where("kind = 1")
    for k in range(2, DEPTH + 2):
        found = arrow_map(learn, _count_strings(k, Sieve(often), listed, n), _BLOCKS).groupBy("place").applyInArrow(_add_up(k, listed, n), _BLOCKS)
        found = stash(found, "strings", True)
        answers = lookup(found.where("kind = 1"), low)
        level = found.where("kind = 0").groupBy("source").cogroup(answers.groupBy("source")).applyInArrow(_level(k, listed, n, total), _BLOCKS)
        levels.append(stash(level, "level", True))
        release(found)
        low = often = levels[-1].where("kind = 0")
        trim()  # the last sieve
    entries = functools.reduce(DataFrame.unionAll, levels).where("kind = 1").unionAll(words.where("kind = 0"))
    tree = stash(entries.groupBy("place").applyInArrow(_merged, _BLOCKS), "tree", True)
    release(*levels, words)
    return tree


@dataclass
class Table:
    """Sorted keys with values, and a bit table in front."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], self.values[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of h that are known, their values)."""
        i, at = self.places(h)
        return i, self.values[at]

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of h that are known, their places among the keys)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        i = i[np.argsort(h[i])]  # in order the keys are found much faster
        at = np.searchsorted(self.keys, h[i])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h[i]
        return i[hit], at[hit]


@dataclass
class SuffixTree:
    """States and smoothed distributions; words: counts of the frequent words, total: N + V + 1."""

    words: Table
    total: float
    #: by context length: log10 of the mass that a state leaves to its suffix, log10 probability of its next words
    left: dict[int, Table]
    next: dict[int, Table]

    def log_probabilities(self, s: Stream):
        """Per token log10 probability (an unlisted word counting as unseen), the same of word frequency, and whether its word is listed."""
        return self.walk(s)[:3]

    def walk(self, s: Stream):
        """log_probabilities(), and whether a state knows the token: then its word's frequency is in the probability already."""
        n = len(s.token)
        at, c = self.words.find(s.token)
        listed = np.zeros(n, bool)
        listed[at] = True
        base = np.full(n, -np.log10(self.total))
        base[at] += np.log10(c + 1)
        out, known = base.copy(), np.zeros(n, bool)
        for k in self.left:
            at = s.starts(k + 1)
            i, mass = self.left[k].find(s.string(k)[at])
            place = at[i]
            out[place + k] += mass
            j, p = self.next[k].find(s.string(k + 1)[place])
            out[place[j] + k] = p
            known[place[j] + k] = True
        return out, base, listed, known


def build_tree(words: Table, total: float, strings) -> SuffixTree:
    """The tree in memory, walked state by state: the plain form of what the tables hold and add up.

    strings: dict of columns (length, string, context, suffix, word, count).
    """
    left, nxt = {}, {}
    at, c = words.find(strings["word"])
    unigram = np.full(len(strings["word"]), 1 / total)
    unigram[at] = (c + 1) / total
    counts = words
    shorter = None  # probability of each shorter string's last word in its state
    for k in range(1, DEPTH + 1):
        mine = np.flatnonzero(strings["length"] == k + 1)
        string, context, count = strings["string"][mine], strings["context"][mine], strings["count"][mine].astype(float)
        if k == 1:
            low = unigram[mine]
        else:
            low = np.empty(len(mine))
            i, p = shorter.find(strings["suffix"][mine])
            low[i] = p
        state, of = np.unique(context, return_inverse=True)
        seen = np.ones(len(state))
        i, c = counts.find(state)
        seen[i] = c
        p, mass, stays = smooth(count, of, seen, low)
        left[k] = Table(state[stays], np.log10(mass[stays]))
        nxt[k] = Table(string[stays[of]], np.log10(p[stays[of]]))
        shorter = Table(string, np.where(stays[of], p, low))
        counts = Table(string, count)
    return SuffixTree(words, total, left, nxt)


# -- scores


@dataclass
class Part:
    """Rows and their tokens, by the number that each has among the part's distinct tokens."""

    rows: pa.RecordBatch
    #: of each row
    count: np.ndarray
    #: distinct tokens, those that come most often first
    kinds: np.ndarray
    kind: np.ndarray

    def streams(self) -> Iterator[tuple[Stream, pa.RecordBatch]]:
        """The tokens of runs of rows of about CHUNK_TOKENS, and those rows; whole texts only."""
        ends, at = np.r_[0, np.cumsum(self.count)], 0
        while at < len(self.count):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_TOKENS, "right")) - 1)
            yield Stream.of(self.kinds, self.kind[ends[at] : ends[to]], self.count[at:to]), self.rows.slice(at, to - at)
            at = to

    def learned(self) -> Part:
        """The training rows alone."""
        mine = pc.invert(self.rows.column(1))
        some = np.asarray(mine)
        return Part(self.rows.filter(mine), self.count[some], self.kinds, self.kind[np.repeat(some, self.count)])


def _pack_part(rows: pa.RecordBatch, count: np.ndarray, token: np.ndarray) -> tuple[bytes, bytes]:
    """A part as two blocks: its rows, and its tokens."""
    order, first, times = grouped(token)
    number = np.empty(len(times), np.int32)
    number[_by_times(times)] = np.arange(len(times), dtype=np.int32)
    kind = np.zeros(len(token) + len(token) % 2, np.int32)  # two make a number of 8 bytes
    kind[order] = np.repeat(number, times)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes(), pack(steps(token[order[first]]), times, count, kind.view(np.uint64))


def _by_times(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times, kind="stable")


def _unpack_part(a: bytes, b: bytes) -> Part:
    with pa.ipc.open_stream(a) as batches:
        rows = batches.read_next_batch()
    kinds, times, count, kind = unpack(b)
    count = count.view(np.int64)
    return Part(rows, count, np.cumsum(kinds, dtype=np.uint64)[_by_times(times.view(np.int64))], kind.view(np.int32)[: count.sum()])


def _parts(batches):
    """The rows in blocks (a: doc_id and held_out, b: tokens) of about PART_BYTES of text, each a source."""
    from pyspark import TaskContext

    source, held, size = TaskContext.get().partitionId() << 32, [], 0

    def block():
        rows, count, token = zip(*held)
        rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return _block_table([(0, None, source, *_pack_part(rows, np.concatenate(count), np.concatenate(token)))]).to_batches()[0]

    for b in batches:
        for at, data, offs in chunks(b.column(2)):
            s = Stream(data, offs)
            held.append((b.select([0, 1]).slice(at, s.rows), s.count, s.token))
            size += len(data)
            if size >= PART_BYTES:
                yield block()
                source, held, size = source + 1, [], 0
    if held:
        yield block()


def _learned(batches) -> Iterator[Part]:
    """The training texts of parts."""
    for parts in batches:
        for a, b in zip(parts.column("a"), parts.column("b")):
            yield _unpack_part(a.as_py(), b.as_py()).learned()


def _asked(s: Stream, listed: np.ndarray, may: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, key) of the entries that a chunk may have: counts of words that aren't listed first, then strings.

    listed, may: of each kind of token, whether it is listed, whether the sieve
    lets it pass.  The longest strings are no states, and have their contexts as
    states in the tree: they are tried only where their contexts may be there.
    """
    at = np.flatnonzero(~listed[s.kind])
    yield at, word_key(s.token[at])
    at = np.flatnonzero(may[s.kind])
    yield at, s.token[at]
    for k in range(2, DEPTH + 2):
        if k <= DEPTH:
            at = s.starts(k)
            h = s.string(k)[at]
        else:
            at = at[: np.searchsorted(at, len(s.token) - DEPTH)]
            at = at[s.row[at] == s.row[at + DEPTH]]
            h = longer(s.string(DEPTH)[at], s.token[at + DEPTH])
        more = passes(table, h)
        at, h = at[more], h[more]
        yield at, h


def _listed(words: Table, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the kinds of tokens is among the words, and its count."""
    listed, count = np.zeros(len(kinds), bool), np.zeros(len(kinds))
    at, c = words.find(kinds)
    listed[at], count[at] = True, c
    return listed, count


def _ask(words: Table, sieve: Sieve, n: int):
    """Requests for all entries that a part may need."""

    def run(batches):
        for batch in batches:
            table = sieve.table()
            for source, a, b in zip(batch.column("source").to_pylist(), batch.column("a"), batch.column("b")):
                part = _unpack_part(a.as_py(), b.as_py())
                listed, may = _listed(words, part.kinds)[0], passes(table, part.kinds)
                found = [distinct(np.concatenate([h for _, h in _asked(s, listed, may, table)])) for s, _ in part.streams()]
                yield from _block_table(_requests(0, distinct(np.concatenate(found)), source, n)).to_batches(1000)

    return run


def _score(words: Table, total: float, sieve: Sieve):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        table, held, keys = sieve.table(), [], []
        part = _unpack_part(texts["a"][0].as_py(), texts["b"][0].as_py())
        listed, count = _listed(words, part.kinds)
        may, log = passes(table, part.kinds), np.log10(count + 1)
        for s, rows in part.streams():
            asked = list(_asked(s, listed, may, table))
            own, back = np.unique(np.concatenate([h for _, h in asked]), return_inverse=True)
            row = np.concatenate([s.row[at] for at, _ in asked])
            sums = np.add.reduceat(log[s.kind], s.first[:-1]), np.add.reduceat(listed[s.kind], s.first[:-1], dtype=np.int64)
            held.append((rows.column(0), rows.column(1), s.count, *sums, len(asked[0][0]), row, back.astype(np.int32)))
            keys.append(own)
        every, value, out = distinct(np.concatenate(keys)), _answers(answers), []
        for own, (doc_id, held_out, tokens, base, known, n_words, row, back) in zip(keys, held):
            x, n = value[np.searchsorted(every, own)][back], len(tokens)
            c = np.rint(x[:n_words] * FINE)  # counts of words
            base = base + np.bincount(row[:n_words], np.log10(c + 1), n) - tokens * math.log10(total)
            known = known + np.bincount(row[:n_words][c > 0], minlength=n)
            score = base + np.bincount(row[n_words:], x[n_words:], n)
            out.append(pa.table([doc_id, held_out, *(pa.array(a) for a in (tokens, known, base, score))], schema=schema))
        trim()
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def suffix_tree_scores(docs: DataFrame, training) -> DataFrame:
    """doc_id, held_out (not of the training rows), n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    ``training`` is a boolean column; the model learns from those rows alone.
    Tokens are words, A-Z lower-cased, and one end, which counts as a token.
    base_score sums log10((c + 1) / (N + V + 1)) over the tokens, c being the
    token's count in training, N all training tokens, V the distinct ones; score
    is the tree's log10 probability.  Null and empty texts have the end alone.
    Repeated rows stay, and get one score.  Without training rows every token is
    unknown and both scores are 0; an empty table gives no rows.  A text of any
    length is scored whole, in chunks only between texts.  Extra columns are
    ignored.  Words and strings are told apart by 64-bit hashes; the tree's
    numbers are exact to 2**-28.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(~training, F.lit(True)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    parts = stash(arrow_map(texts, _parts, _BLOCKS), "parts", True)
    n = max(PLACES, parts.count() * PART_BYTES // PLACE_BYTES)
    learn = parts.select("a", "b")
    words = stash(arrow_map(learn, _count_words(n), _BLOCKS).groupBy("place").applyInArrow(_add_words, _BLOCKS), "words", True)
    counts = words.where("kind = 0").select("a", "b")
    tokens, distinct_words = arrow_map(counts, _totals, "tokens bigint, words bigint").agg(F.sum("tokens"), F.sum("words")).first()
    tokens = tokens or 0
    total = tokens + (distinct_words or 0) + 1.0
    often = arrow_map(counts, _frequent(WORD_SHARE * tokens), "word bigint, count bigint").toArrow()
    often = Table(np.asarray(often["word"]).view(np.uint64), np.asarray(often["count"]).astype(float))
    tree = grow_tree(learn, words, often, total, n)
    sieve = Sieve(tree)

    scored = []
    for turn in range(TURNS):  # each time a part of the requests and answers lies about
        mine = parts.where(F.pmod(F.xxhash64("source"), F.lit(TURNS)) == turn)
        answers = stash(lookup(arrow_map(mine.select("source", "a", "b"), _ask(often, sieve, n), _BLOCKS), tree), "answers", True)
        score = mine.groupBy("source").cogroup(answers.groupBy("source")).applyInArrow(_score(often, total, sieve), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
        scored.append(stash(score, "scored"))
        release(answers)
        trim()
    release(tree, parts)
    scored = functools.reduce(DataFrame.unionAll, scored)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op2_suffix_tree(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return suffix_tree_scores(docs, crc_mod(7) != 2)
