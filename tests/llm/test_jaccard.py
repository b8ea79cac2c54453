import collections
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import deduplication, jaccard_join
from quarry.llm.text import Words, chunks, shingle_sets
from tests.llm.conftest import as_table, edited, odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def aligned(rows):
    """(doc_id, shingles, least doc_id of the component) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def brute(rows):
    return sorted(aligned(rows), key=str)


def got(df):
    return sorted(map(tuple, jaccard_join.jaccard_join(df).collect()), key=str)


def test_odd_rows(odd):
    assert got(odd) == brute(odd_rows())


def test_empty(none):
    assert got(none) == []


def test_copies_with_frequent_tokens(spark):
    """A group of edited copies whose tokens are frequent, quoted passages, and documents near the limit."""
    base, passage = " ".join(words(7, 120)), " ".join(words(8, 60))
    rows = [(i, edited(base, i, 0.012 * (i % 4))) for i in range(90)]
    rows += [(100 + i, passage + " " + " ".join(words(900 + i, 8 + i))) for i in range(60)]
    rows += [(200 + i, " ".join(words(50, 30 + i))) for i in range(40)]
    assert got(as_table(spark, rows)) == brute(rows)


def test_runs_of_large_keys(monkeypatch):
    """A key that comes in several runs gives the same hub pairs and members."""
    rng = np.random.default_rng(5)
    key = np.sort(np.r_[np.zeros(500, np.int64), rng.integers(1, 40, 300), np.full(400, 50)])
    rows = np.stack([key, rng.integers(0, 3, len(key)), np.full(len(key), 100), rng.integers(0, 10**6, len(key))], 1)
    rows = rows[np.lexsort(rows.T[::-1])]

    def meet(step, run):
        monkeypatch.setattr(jaccard_join, "RUN", run)
        names = ("key", "rare", "n", "cls")
        batches = [pa.RecordBatch.from_pydict({c: rows[i : i + step, j] for j, c in enumerate(names)}) for i in range(0, len(rows), step)]
        pairs, members = set(), set()
        for out in jaccard_join._meet(batches):
            for a, b, k in zip(out["a"].tolist(), out["b"].tolist(), out["key"].tolist()):
                pairs.add((a, b)) if k is None else members.add((k, a))
        return pairs, members

    whole = meet(10**6, 10**6)
    assert whole[1] and all(meet(step, run) == whole for step, run in ((7, 50), (60, 20), (100, 130), (33, 10**6)))


def test_classes_that_come_once_a_task(monkeypatch):
    """Classes that many tasks send fill no run: each comes once in a key, is compared, and is kept for the second round."""
    monkeypatch.setattr(jaccard_join, "RUN", 1000)
    rows = [(7, 0, 100, c) for c in (1, 2, 3) for _ in range(3000)] + [(7, 1, 100, c) for c in range(10, 20)]
    names = ("key", "rare", "n", "cls")
    batches = [pa.RecordBatch.from_pydict({c: [r[j] for r in rows[i : i + 700]] for j, c in enumerate(names)}) for i in range(0, len(rows), 700)]
    members, pairs = set(), set()
    for out in jaccard_join._meet(batches):
        for a, b, k in zip(out["a"].tolist(), out["b"].tolist(), out["key"].tolist()):
            pairs.add((a, b)) if k is None else members.add(a)
    assert members == {1, 2, 3, *range(10, 20)}
    assert {(1, x) for x in (2, 3, *range(10, 20))} <= pairs


def test_hot_keys_in_blocks(spark, monkeypatch):
    """Blocks and runs of any size give the same components, without and with a group that no hub links."""
    passage = " ".join(words(8, 60))
    rows = [(i, passage + " " + " ".join(words(900 + i % 37, 16 + i % 5))) for i in range(80)]
    rows += [(200 + i, edited(" ".join(words(7, 120)), i, 0.012 * (i % 4))) for i in range(60)]
    wanted = brute(rows)
    for block, run in ((4, 16), (2048, 200_000)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "RUN", run)
        assert got(as_table(spark, rows)) == wanted


def test_units_bring_any_two_members_together(monkeypatch):
    rng = np.random.default_rng(3)
    n, bits = np.full(40, 50), rng.integers(0, 2, (40, 16)).astype(np.uint64)
    comp, cls = rng.integers(0, 6, 40), np.arange(40)
    monkeypatch.setattr(jaccard_join, "may_link", lambda n, p, m, q: np.ones(len(m), bool))

    def pairs(rows):
        rows = sorted(rows)
        batch = pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in rows], pa.int64()) for j in range(5)), pa.array([bits[r[4]].tobytes() for r in rows])], names=list("uscnkb"))
        return {(a, b) for out in jaccard_join._across([batch]) for a, b in zip(out["a"].tolist(), out["b"].tolist())}

    whole = pairs([(1, 0, int(comp[c]), 50, int(c)) for c in cls])
    assert whole == {(a, b) for a in range(40) for b in range(a + 1, 40) if comp[a] != comp[b]}
    units = []
    for c in cls:
        for other in range(3):
            own = int(c) % 3
            units.append((10 * min(own, other) + max(own, other), int(own > other), int(comp[c]), 50, int(c)))
    assert pairs(units) == whole


def test_no_link_is_lost_between_random_sets():
    """Linked sets share an index key, whatever is frequent."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        drop, add = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 7 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**64 - 1, add, dtype=np.uint64)].astype(np.uint64))
        frequent = np.zeros(jaccard_join.COUNTERS, np.int8)
        some = np.union1d(a, b)
        some = some[rng.random(len(some)) < rng.random()]
        frequent[(some >> jaccard_join._SHIFT).astype(np.int64)] = rng.integers(1, 5, len(some))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 75 * (len(a) + len(b) - same):
            assert len(np.intersect1d(jaccard_join.index_keys(a, frequent), jaccard_join.index_keys(b, frequent)))
            size = min(len(jaccard_join.bitmap(a)), len(jaccard_join.bitmap(b)))
            assert jaccard_join.may_link(len(a), jaccard_join.fold(jaccard_join.bitmap(a), size), len(b), jaccard_join.fold(jaccard_join.bitmap(b), size))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \t\né漢", max_size=40), max_size=8))
def test_shingles_match_python(texts):
    sets = [s for _, d, o in chunks(pa.array(texts, pa.string()), 16) for s in shingle_sets(Words(d, o))]
    wanted = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in wanted]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(wanted[a] & wanted[b])


def test_one_of_each(odd, none):
    rows = odd_rows()
    kept = deduplication.one_of_each(odd)
    assert kept.columns == odd.columns
    wanted = collections.Counter()
    for (i, t), (_, n, head) in zip(rows, aligned(rows)):
        if n == 0:
            wanted[(i, t)] += 1  # links with nothing
        elif i == head:
            wanted[(i, t)] = 1  # once, even if its row repeats
    assert collections.Counter(tuple(r) for r in kept.select("doc_id", "text").collect()) == wanted
    assert deduplication.one_of_each(none).count() == 0
