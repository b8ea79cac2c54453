"""Exact Jaccard join of documents on word shingles, by token-combination prefixes.

Tokens are the 64-bit hashes of 5-word shingles.  Two sets of n and m tokens
with Jaccard >= t share at least ceil(t * max(n, m)) tokens, so under one global
order their first n - ceil(t n) + 1 tokens meet, and prefixes that are longer by
g share g + 1 tokens.  The order puts rare tokens first.  Every rare token of
the prefix is indexed by itself.  A frequent one would gather documents that
merely quote the same passage, so where the prefix reaches frequent tokens it is
extended by g, these tokens are dealt to g cells by hash, and each pair within a
cell is indexed: g + 1 shared tokens must put two in one cell.  Documents whose
index keys meet are verified on their whole texts.  No link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.spark import arrow_map, documents, few_files, release, stash
from quarry.llm.text import Words, chunks, mix, shingle_sets

#: Counters of the token frequency sketch.
COUNTERS = 1 << 22
_SHIFT = np.uint64(64 - 22)
#: Bits of a set's bitmap, at least; larger sets have one for each token or more.
BITS = 1024
#: Members up to which all pairs of an index key are taken at once.
SMALL = 8
#: Distinct sets of an index key that are held at once.
RUN = 200_000
#: Members of a key that the second round compares in one place; larger keys are split into blocks of about so many.
BLOCK = 1024
#: Members of a larger index key that all others are compared with first.
HUBS = 2
#: Texts that one verification group compares with its hub.
GROUP = 64
#: Wanted texts, and index keys, up to which their keys are broadcast (16 bytes each); beyond, a shuffle join.
BROADCAST = 200_000


def need(n):
    """Least tokens that a set of n shares with any set it links with."""
    return (75 * n + 99) // 100


def set_class(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set of tokens."""
    return int(mix(tokens).sum(dtype=np.uint64).view(np.int64)), int(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _class64(tokens: np.ndarray) -> int:
    a, b = set_class(tokens)
    return int(mix(np.array([a, b], np.int64).view(np.uint64) * np.array([1, 3], np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _sets(column):
    """Token sets of a text column, row by row."""
    for _, data, offs in chunks(column):
        yield from shingle_sets(Words(data, offs))


def bitmap(s: np.ndarray, size: int = 0) -> np.ndarray:
    """A set as bits, each the parity of the tokens that hash to it; more bits for a larger set."""
    size = size or max(BITS, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set in fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(n, p, m, q):
    """False only where sets of n and m tokens with these bitmaps (last axis) can't link: bits that differ are a least number of tokens that do."""
    most = (n + m - np.bitwise_count(p ^ q).sum(-1, dtype=np.int64)) // 2
    return (100 * most >= 75 * (n + m - most)) & _linkable(np.minimum(n, m), np.maximum(n, m))


def _describe(batches):
    """A row for each document, and one row with the task's token counts (each set once)."""
    count, seen, total = np.zeros(COUNTERS, np.uint32), set(), 0
    for b in batches:
        n, cls, bits, small = [], [], [], []
        for s in _sets(b.column(2)):
            n.append(len(s)), cls.append(_class64(s)), bits.append(bitmap(s).tobytes()), small.append(bitmap(s, BITS).tobytes() if len(s) > BITS else None)
            if len(s) and cls[-1] not in seen:
                seen.add(cls[-1])
                np.add.at(count, (s >> _SHIFT).astype(np.int64), 1)
                total += len(s)
        yield {"doc_id": b.column(0), "text_key": b.column(1), "n": n, "cls": cls, "bits": bits, "small": small, "counts": [None] * len(n)}
    if total:
        yield {"doc_id": [None], "text_key": [None], "n": [None], "cls": [None], "bits": [None], "small": [None], "counts": [_pack(count)]}


def _pack(count):
    small = np.uint32 if count.max() < 2**32 else np.uint64
    return zstandard.compress(memoryview(count if count.dtype == small else count.astype(small)), 1)


def _unpack(blob):
    x = zstandard.decompress(blob)
    return np.frombuffer(x, np.uint32 if len(x) == 4 * COUNTERS else np.uint64)


def _merge(batches):
    out = None
    for b in batches:
        for blob in b.column(0):
            out = np.zeros(COUNTERS, np.uint64) if out is None else out
            out += _unpack(blob.as_py())
    if out is not None:
        yield {"counts": [_pack(out)]}


def frequent_tokens(counts: DataFrame) -> np.ndarray:
    """Per counter 0 for rare tokens, else the binary order of magnitude; counts are merged in two steps before the driver adds four."""
    n = max(8, math.isqrt(counts.rdd.getNumPartitions()))
    parts = arrow_map(arrow_map(counts.coalesce(n), _merge, "counts binary").repartition(4), _merge, "counts binary").collect()
    total = sum((_unpack(r[0]).astype(np.float64) for r in parts), np.zeros(COUNTERS))
    mean = total.mean()
    above = total - (mean + 4 * np.sqrt(mean) + 4)
    return np.where(above > 0, np.log2(np.maximum(above, 1)).astype(np.int8) + 1, 0).astype(np.int8)


_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def index_keys(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The index keys of a sorted token set."""
    n = len(s)
    p = n - need(n) + 1
    level = frequent[(s >> _SHIFT).astype(np.int64)]
    rare = s[level == 0]
    if len(rare) >= p:
        return mix(rare[:p])
    common = s[level > 0]
    common = common[np.argsort(level[level > 0], kind="stable")]
    keys = [mix(rare)]
    own = max(3, n.bit_length() - 1)
    for size in (own, own + 1) if 4 * n >= 3 * 2 ** (own + 1) else (own,):
        salt = mix(np.array([size], np.uint64))[0]
        if size == 3:
            keys.append(mix(common[: p - len(rare)] ^ salt))
            continue
        g = 2**size // 8
        part = common[: p + g - len(rare)]
        cell = mix(part) % np.uint64(g)
        order = np.lexsort((part, cell))
        part, cell = part[order], cell[order]
        for d in range(1, len(part)):
            same = np.flatnonzero(cell[d:] == cell[:-d])
            if not len(same):
                break
            keys.append(mix((part[same] * _A + mix(part[same + d]) * _B) ^ salt))
    return np.concatenate(keys)


def _index(frequent):
    def run(batches):
        seen = set()
        for b in batches:
            key, cls, size, rare = [], [], [], []
            for s in _sets(b.column(0)):
                if len(s) and (c := _class64(s)) not in seen:
                    seen.add(c)
                    k = index_keys(s, frequent)
                    own = int((frequent[(s >> _SHIFT).astype(np.int64)] == 0).sum())
                    key.append(k), cls.append(np.full(len(k), c)), size.append(np.full(len(k), len(s), np.int32)), rare.append(np.full(len(k), own, np.int32))
                if len(key) >= 200:
                    yield {"key": np.concatenate(key).view(np.int64), "cls": np.concatenate(cls), "n": np.concatenate(size), "rare": np.concatenate(rare)}
                    key, cls, size, rare = [], [], [], []
            if key:
                yield {"key": np.concatenate(key).view(np.int64), "cls": np.concatenate(cls), "n": np.concatenate(size), "rare": np.concatenate(rare)}

    return run


def _distinct(batches, columns):
    """Sorted batches as numpy columns, each (key, ..., cls) once: a task sends a class once, so a key has it as often as tasks do."""
    key = cls = None
    for b in batches:
        now = [np.asarray(b.column(i)) for i in range(columns)]
        if not len(now[0]):
            continue
        new = np.r_[(key, cls) != (now[0][0], now[-1][0]), (now[0][1:] != now[0][:-1]) | (now[-1][1:] != now[-1][:-1])]
        key, cls = now[0][-1], now[-1][-1]
        yield [x[new] for x in now]


def _groups(batches, most=None):
    """Runs of whole keys from numpy columns sorted by the first.

    With ``most``, a key of more rows comes in several runs, alone in all but the
    last of them.
    """
    held: list = []  # the last key, which may go on
    for now in batches:
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut or held and held[-1][0][-1] != now[0][0]:
            done = [*held, [x[:cut] for x in now]]
            yield [np.concatenate(x) for x in zip(*done)]
            held = []
        held.append([x[cut:] for x in now])
        if most and sum(len(h[0]) for h in held) > most:
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _linkable(n, m):
    """Whether sizes n <= m allow the similarity."""
    return 100 * n >= 75 * m


def _meet(batches):
    """From rows sorted by (key, rare, n, cls): pairs to verify; members of larger keys are kept for the second round.

    All pairs of a small key; of a larger one the pairs with its first HUBS
    members.  These have the fewest rare tokens: among edited copies the one that
    the others were made from, to which each is nearer than to the rest.  A run
    of a key that goes on has more than RUN distinct members, so all of them are kept.
    """
    last, hubs_n, hubs_cls = None, None, None
    for key, _, n, cls in _groups(_distinct(batches, 4), max(RUN, SMALL)):
        n = n.astype(np.int64)
        goes_on, goes_on_key = len(key) > 0 and key[0] == last, last
        if goes_on:  # a very large key: its hubs come again in front of its next members
            key, n, cls = np.r_[np.full(len(hubs_n), last), key], np.r_[hubs_n, n], np.r_[hubs_cls, cls]
        if len(key):
            f = int(np.searchsorted(key, key[-1], "left"))
            last, hubs_n, hubs_cls = key[-1], n[f : f + HUBS], cls[f : f + HUBS]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        keep = np.repeat(size > 1, size)
        if not keep.any():
            continue
        key, n, cls = key[keep], n[keep], cls[keep]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        start, own = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(key))
        again = 0
        if goes_on and len(first) and key[0] == goes_on_key:
            own[: size[0]] = np.maximum(own[: size[0]], SMALL + 1)
            again = HUBS
        a, b = [], []
        for d in range(1, SMALL):
            j = np.flatnonzero((place - start >= d) & (own <= SMALL))
            a.append(j - d), b.append(j)
        for h in range(HUBS):
            j = np.flatnonzero((place - start > h) & (own > SMALL))
            a.append(start[j] + h), b.append(j)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = _linkable(np.minimum(n[a], n[b]), np.maximum(n[a], n[b]))
        a, b = cls[a[ok]], cls[b[ok]]
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        none = np.zeros(len(pair), np.int64)
        yield {"a": pair[:, 0], "b": pair[:, 1], "key": pa.nulls(len(pair), pa.int64()), "n": none}
        big = (own > SMALL) & (place >= again)
        yield {"a": cls[big], "b": cls[big], "key": key[big], "n": n[big]}


def _across(batches):
    """From rows (unit, side, comp, n, cls, bits) sorted by the first five: the pairs of a unit that lie in different components and may link.

    Where a unit has two sides, only pairs across them.
    """
    rows = ([*(np.asarray(b.column(i)) for i in range(5)), np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(b.num_rows, -1)] for b in batches if b.num_rows)
    for unit, side, comp, n, cls, bits in _groups(rows):
        cuts = np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit)]
        a, b, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for f, t in zip(cuts[:-1], cuts[1:]):
            half = f + int(np.searchsorted(side[f:t], 1))
            whole = half in (f, t)
            edge = np.r_[f + np.flatnonzero(np.r_[True, comp[f + 1 : t] != comp[f : t - 1]]), t] if whole else None
            for i in range(f, t if whole else half):
                start = int(edge[np.searchsorted(edge, i, "right")]) if whole else half  # members of a component against all that come after
                j = start + np.flatnonzero(may_link(n[i], bits[i], n[start:t], bits[start:t]))
                j = j if whole else j[comp[j] != comp[i]]
                a.append(np.minimum(cls[i], cls[j])), b.append(np.maximum(cls[i], cls[j]))
                waiting += len(j)
                if waiting > 200_000:
                    yield _unique_pairs(a, b)
                    a, b, waiting = [], [], 0
        if waiting:
            yield _unique_pairs(a, b)


def _unique_pairs(a, b):
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return {"a": pair[:, 0], "b": pair[:, 1]}


def _sift(batches):
    """From rows (a, salt, role, cls, n, bits) sorted by the first four: the pairs that may link."""
    at, size, own = None, 0, None
    for batch in batches:
        a, salt, role, cls, n = (np.asarray(batch.column(i)) for i in range(5))
        left, right = [], []
        for i, blob in enumerate(batch.column(5).to_pylist()):
            bits = np.frombuffer(blob, np.uint64)
            if role[i] == 0:
                at, size, own = (a[i], salt[i]), n[i], bits
            elif at == (a[i], salt[i]):
                words = min(len(own), len(bits))
                if may_link(size, fold(own, words), n[i], fold(bits, words)):
                    left.append(a[i]), right.append(cls[i])
        yield {"a": left, "b": right}


def _verify(batches):
    """From rows (a, salt, role, cls, text) sorted by the first four: the pairs that link."""
    at, hub = None, None
    for batch in batches:
        a, salt, role, cls = (np.asarray(batch.column(i)) for i in range(4))
        left, right = [], []
        for i, s in enumerate(_sets(batch.column(4))):
            if _class64(s) != cls[i]:
                continue
            if role[i] == 0:
                at, hub = (a[i], salt[i]), s
            elif at == (a[i], salt[i]):
                same = len(np.intersect1d(hub, s, assume_unique=True))
                if 100 * same >= 75 * (len(hub) + len(s) - same):
                    left.append(a[i]), right.append(cls[i])
        yield {"a": left, "b": right}


def _deal(pairs: DataFrame, n: int) -> DataFrame:
    """Of n pairs, (a, salt, role, cls): for each group of about GROUP partners b of a node a, the classes to bring together; role 0 is a itself.

    A hub of any degree so spreads over tasks, with a copy of its own data each.
    """
    spread = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    dealt = pairs.join(spread, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / GROUP)).cast("bigint"))
    hubs = dealt.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("cls"))
    return stash(few_files(dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("cls")).unionByName(hubs), 2 * n), "dealt")


def _together(want: DataFrame, data: DataFrame) -> DataFrame:
    """want with the columns of data (one row a class), the rows of a group side by side, its hub first."""
    sent = data.join(want, "cls").select("a", "salt", "role", "cls", *(c for c in data.columns if c != "cls"))
    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "cls")


def linked(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of set classes that link.

    First the bitmaps of both sets rule out what merely shares a passage; this
    loses no link.  What is left is compared on the whole
    texts of one document of each class.
    """
    n = pairs.count()
    want = _deal(pairs, n)
    one = rows.join(want.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    left = stash(few_files(arrow_map(_together(want, one), _sift, "a bigint, b bigint").distinct(), n), "sifted")
    release(want)
    n = left.count()
    want = _deal(left, n)
    wanted = rows.select("cls", "text_key", "doc_id").join(want.select("cls").distinct(), "cls", "left_semi")
    pick = wanted.groupBy("cls").agg(F.min(F.struct("text_key", "doc_id")).alias("r")).select("cls", F.col("r.text_key").alias("k"), F.col("r.doc_id").alias("d"))
    pick = stash(few_files(pick, 2 * n), "pick")
    side = F.broadcast(pick) if pick.count() <= BROADCAST else pick
    texts = docs.join(side, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("cls", "text")
    texts = stash(texts.dropDuplicates(["cls"]), "texts")
    out = stash(few_files(arrow_map(_together(want, texts), _verify, "a bigint, b bigint").distinct(), n), "linked")
    release(want, left, pick, texts)
    return out


def _units(members: DataFrame, rows: DataFrame) -> DataFrame:
    """unit, key, turn, side, comp, n, cls, bits: members of a key that are to be compared in one place; rows: the members with their bitmaps.

    A key of at most BLOCK members is one unit.  A larger one is dealt to blocks
    by class, and each two blocks (or one with itself) are a unit, so that any
    two members meet, and no unit outgrows two blocks.
    """
    large = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    large = stash(large, "large")  # few: each has many members
    blocks = rows.join(F.broadcast(large) if large.count() <= BROADCAST else large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("cls"), F.col("blocks")), F.col("other")
    out = blocks.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    out = out.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    # the units of a key are numbered, so that they can be dealt out evenly
    turn = F.expr("lo * blocks - (lo * (lo - 1)) div 2 + hi - lo")
    return out.select(F.xxhash64("key", "lo", "hi").alias("unit"), "key", turn.alias("turn"), F.when(F.col("own") > other, 1).otherwise(0).alias("side"), "comp", "n", "cls", "bits")


def set_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (tokens), cls (of equal sets), component (its least class; null without tokens) of each row."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "text")
    described = stash(arrow_map(docs, _describe, "doc_id bigint, text_key bigint, n bigint, cls bigint, bits binary, small binary, counts binary"), "described")
    rows = described.where("n is not null").drop("counts")
    frequent = frequent_tokens(described.where("counts is not null").select("counts"))
    index = arrow_map(docs.select("text"), _index(frequent), "key bigint, cls bigint, n int, rare int")
    met = arrow_map(index.repartition("key").sortWithinPartitions("key", "rare", "n", "cls").select("key", "rare", "n", "cls"), _meet, "a bigint, b bigint, key bigint, n bigint")
    met = stash(met, "met")
    pairs = stash(met.where("key is null").select("a", "b").distinct(), "pairs")
    edges = linked(pairs, rows, docs)
    label = components(edges)
    # larger keys compared all members with a hub only; what lies in other components still is to be compared
    members = met.where("key is not null").select("key", F.col("a").alias("cls"), "n")
    members = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("key", F.coalesce("component", "cls").alias("comp"), "n", "cls")
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    # sets beyond BITS tokens have small bitmaps of their own for this
    one = rows.groupBy("cls").agg(F.first(F.coalesce("small", "bits")).alias("bits"))
    mixed = stash(mixed, "mixed")
    members = stash(members.join(F.broadcast(mixed) if mixed.count() <= BROADCAST else mixed, "key", "left_semi"), "members")
    release(mixed)
    units = _units(members, members.join(one, "cls"))  # each class gets its bitmap before it comes in several units
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.withColumn("task", F.pmod(F.pmod(F.xxhash64("key"), F.lit(tasks)) + F.col("turn"), F.lit(tasks)).cast("int"))
    units = units.repartitionById(tasks, "task").sortWithinPartitions("unit", "side", "comp", "n", "cls")
    units = units.select("unit", "side", "comp", F.col("n").cast("bigint").alias("n"), "cls", "bits")
    more = stash(arrow_map(units, _across, "a bigint, b bigint").distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    release(members)
    if more.head(1):
        late = linked(more, rows, docs)
        if late.head(1):
            release(label)
            label = components(edges.unionByName(late))
        release(late)
    release(met, more, pairs, edges)
    return rows.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "text_key", "n", "cls", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("component"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text, ...).

    Links are pairs with 100 * |intersection| >= 75 * |union| of their sets of
    distinct 5-word shingles; with fewer words the whole sequence is the one
    shingle.  Documents without words (null or empty text) have no shingle and
    link with nothing: component_id is their own doc_id.  component_id is the
    least doc_id of the component (null ids count only where there is no other).
    Documents with equal sets form one class, which is compared once.  Repeated
    rows stay.  An empty table gives no rows.  Of very long texts all shingles
    count.  Extra columns are ignored, whatever their names.
    """
    rows = stash(set_components(docs), "components")
    heads = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(heads, "component", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))
