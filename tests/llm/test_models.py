"""Language model, toxicity, token counts, fingerprints, licenses, decontamination."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarry.llm import decontamination, fingerprints, licenses, suffix_tree, token_counts, toxicity
from quarry.llm.spark import arrow_map, crc_mod
from quarry.llm.text import NOT_ALNUM, Words, chunks
from tests.llm.conftest import as_table, odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def kernel(text):
    (_, data, offs), *_ = chunks(pa.array([text], pa.large_string()), 1 << 40)
    return Words(data, offs, NOT_ALNUM)


# -- language model


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def test_base_scores(odd):
    rows = odd_rows()
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    c = collections.Counter()
    for i, t in rows:
        if trains(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    wanted = sorted(((i, not trains(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for i, t in rows), key=str)
    out = suffix_tree.suffix_tree_scores(odd, crc_mod(7) != 2).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out), key=str) == wanted
    assert all(r.score <= 0 for r in out)


def test_the_tree_is_a_distribution_and_knows_contexts(spark):
    rng = random.Random(1)
    texts = [" ".join(itertools.chain.from_iterable(rng.choice([["red", "fox", "runs"], ["blue", "sea", "waits"], ["old", "red", "sea"]]) for _ in range(30))) for _ in range(60)]
    strings, counts = collections.Counter(), collections.Counter()
    rows = {}
    for t in texts:
        (_, d, o), *_ = chunks(pa.array([t]))
        s = suffix_tree.Stream(d, o)
        for x in s.token.tolist():
            counts[x] += 1
        for k in (2, 3, 4):
            for i in s.starts(k).tolist():
                key = int(s.string(k)[i])
                strings[key] += 1
                rows[key] = (k, key, int(s.string(k - 1)[i]), int(s.string(k - 1)[i + 1]), int(s.token[i + k - 1]))
    names = ("length", "string", "context", "suffix", "word")
    columns = {n: np.array([rows[x][j] for x in strings], np.int32 if n == "length" else np.uint64) for j, n in enumerate(names)}
    columns["count"] = np.array(list(strings.values()))
    total, distinct = sum(counts.values()), len(counts)
    tree = suffix_tree.build_tree(suffix_tree.Table(np.array(list(counts), np.uint64), np.array(list(counts.values()), float)), total + distinct + 1.0, columns)
    assert len(tree.left[1].keys) > 0
    vocabulary = ["red", "fox", "runs", "blue", "sea", "waits", "old", "unseen"]
    for context in ("red", "the", "old red", "fox runs blue", "sea waits old red"):
        total_p = 0.0
        for w in vocabulary:
            (_, d, o), *_ = chunks(pa.array([f"{context} {w}"]))
            total_p += 10 ** tree.log_probabilities(suffix_tree.Stream(d, o))[0][-2]
        (_, d, o), *_ = chunks(pa.array([context]))
        total_p += 10 ** tree.log_probabilities(suffix_tree.Stream(d, o))[0][-1]  # the end
        assert total_p == pytest.approx(1, abs=1e-9)
    held = " ".join(["red", "fox", "runs", "blue", "sea", "waits"] * 3)
    (_, d, o), *_ = chunks(pa.array([held]))
    p, base, _ = tree.log_probabilities(suffix_tree.Stream(d, o))
    assert p.sum() > base.sum() + 5


def test_no_training_rows(spark, none, odd):
    from pyspark.sql import functions as F

    assert suffix_tree.suffix_tree_scores(none, crc_mod(7) != 2).count() == 0
    out = suffix_tree.suffix_tree_scores(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in out) and len(out) == len(odd_rows())


def test_joined_scores_are_those_of_the_whole_tree(spark):
    rng = random.Random(8)
    phrases = [words(900 + i, 4) for i in range(40)]
    rows = [(i, " ".join(itertools.chain.from_iterable(rng.choice(phrases) for _ in range(40)))) for i in range(90)] + [(90, None), (91, "")]
    trains = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    counts, strings, facts = collections.Counter(), collections.Counter(), {}

    def stream(t):
        (_, d, o), *_ = chunks(pa.array([t or ""]))
        return suffix_tree.Stream(d, o)

    for _, t in (r for r in rows if trains(r[0])):
        s = stream(t)
        counts.update(s.token.tolist())
        for k in (2, 3, 4):
            for i in s.starts(k).tolist():
                strings[key := int(s.string(k)[i])] += 1
                facts[key] = (k, key, int(s.string(k - 1)[i]), int(s.string(k - 1)[i + 1]), int(s.token[i + k - 1]))
    kept = [x for x in strings if strings[x] >= 2]
    columns = {n: np.array([facts[x][j] for x in kept], np.int32 if n == "length" else np.uint64) for j, n in enumerate(("length", "string", "context", "suffix", "word"))}
    columns["count"] = np.array([strings[x] for x in kept])
    table = suffix_tree.Table(np.array(list(counts), np.uint64), np.array(list(counts.values()), float))
    tree = suffix_tree.build_tree(table, sum(counts.values()) + len(counts) + 1.0, columns)
    assert all(len(tree.next[k].keys) for k in (1, 2))
    for share in (suffix_tree.WORD_SHARE, 2.0):  # words held by every task, words joined
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix_tree, "WORD_SHARE", share)
            out = suffix_tree.suffix_tree_scores(as_table(spark, rows), crc_mod(7) != 2).collect()
        assert {r.doc_id: r.score for r in out} == pytest.approx({i: tree.log_probabilities(stream(t))[0].sum() for i, t in rows}, abs=1e-6)


def test_strings_seen_twice_are_learned_in_a_large_corpus(spark):
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "pad " * 10_000 + " ".join(f"x{j} y{j}" for j in (i // 2 * 2, i // 2 * 2 + 1))) for i in learned] + [(held, " ".join(f"x{j} y{j}" for j in range(200)))]
    r = next(r for r in suffix_tree.suffix_tree_scores(as_table(spark, rows), crc_mod(7) != 2).collect() if r.doc_id == held)
    assert r.score > r.base_score + 100


def test_texts_are_cut_into_words_once(spark):
    """What is kept of the texts is their tokens: counting doesn't read the words again."""
    from pyspark.sql import functions as F

    rows = [*odd_rows(), *((1000 + i, " ".join(words(i, 50))) for i in range(30))]
    counts = collections.Counter(x for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for x in tokens(t))
    texts = as_table(spark, rows).select("doc_id", (crc_mod(7) == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    parts = arrow_map(texts, suffix_tree._parts, suffix_tree._BLOCKS).select("a", "b").toArrow()

    def again(*_):
        raise AssertionError("the words are read again")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_tree, "Words", again)
        found = pa.Table.from_batches(suffix_tree._count_words(64)(parts.to_batches()))
    found = [suffix_tree.unpack(x.as_py())[0].view(np.int64) for x in found["b"]]
    assert sorted(np.concatenate(found).tolist()) == sorted(counts.values())


def test_long_states_without_their_shorter_beginnings(spark):
    """A word depends on the third before it alone: three words are a state, and one or two of them are not in the tree."""
    rng = random.Random(5)

    def text():
        out = [rng.randrange(6) for _ in range(3)]
        for _ in range(300):
            out.append((out[-3] + 1) % 6 if rng.random() < 0.9 else rng.randrange(6))
        return " ".join(f"w{x}" for x in out)

    rows = [(i, text()) for i in range(60)]
    strings, counts, facts = collections.Counter(), collections.Counter(), {}

    def stream(t):
        (_, d, o), *_ = chunks(pa.array([t]))
        return suffix_tree.Stream(d, o)

    for _, t in (r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2):
        s = stream(t)
        counts.update(s.token.tolist())
        for k in (2, 3, 4):
            for i in s.starts(k).tolist():
                strings[key := int(s.string(k)[i])] += 1
                facts[key] = (k, key, int(s.string(k - 1)[i]), int(s.string(k - 1)[i + 1]), int(s.token[i + k - 1]))
    kept = [x for x in strings if strings[x] >= 2]
    columns = {n: np.array([facts[x][j] for x in kept], np.int32 if n == "length" else np.uint64) for j, n in enumerate(("length", "string", "context", "suffix", "word"))}
    columns["count"] = np.array([strings[x] for x in kept])
    table = suffix_tree.Table(np.array(list(counts), np.uint64), np.array(list(counts.values()), float))
    tree = suffix_tree.build_tree(table, sum(counts.values()) + len(counts) + 1.0, columns)
    assert len(tree.left[3].keys) > 100 and not len(tree.next[1].keys) and not len(tree.left[2].keys)
    out = suffix_tree.suffix_tree_scores(as_table(spark, rows), crc_mod(7) != 2).collect()
    assert {r.doc_id: r.score for r in out} == pytest.approx({i: tree.log_probabilities(stream(t))[0].sum() for i, t in rows}, abs=1e-6)


# -- toxicity


def toxic_rows(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = words(i, rng.randint(5, 80))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "Vile", "grimfolk", "grimpeople"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    odd = [(1000 + (i or 0), t) for i, t in odd_rows()]
    docs, known = as_table(spark, rows + odd + [(None, "nastyword vile")]), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, toxicity.train(docs, known)).collect()
    truth = {i: x for i, _, x in labels}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in out if (r.doc_id or 0) >= 1000)
    text = dict(rows)
    for r in held:
        for s in r.spans:
            assert text[r.doc_id][s.start : s.end].lower() in ("nastyword", "vile", "grimfolk", "grimpeople")
    kept = toxicity.without_toxic(docs, toxicity.train(docs, known))
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out)


def test_compressed_marginals_are_the_chains():
    rng = np.random.default_rng(2)
    model = toxicity.Crf(np.zeros(0, np.uint64), np.zeros(0), -1.5, rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 7, 30):
        at = np.flatnonzero(rng.random(n) < 0.4)
        if not len(at):
            at = np.array([n - 1])
        weight = rng.normal(size=len(at)) * 2
        emit = np.zeros((1, n, 2))
        emit[0, :, 1] = model.bias
        emit[0, at, 1] += weight
        _, node, _ = toxicity._chain(emit, model.trans, model.start)
        assert np.allclose(model.marginals(at, weight, n), node[0, at, 1])


def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(5)
    emit, trans, start = rng.normal(size=(3, 6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    z, node, edge = toxicity._chain(emit, trans, start)
    edges = np.zeros((2, 2))
    for s in range(3):
        total, marginal = 0.0, np.zeros((6, 2))
        for tags in itertools.product((0, 1), repeat=6):
            w = math.exp(start[tags[0]] + sum(emit[s, i, t] for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            for i, t in enumerate(tags):
                marginal[i, t] += w
        assert z[s] == pytest.approx(math.log(total)) and np.allclose(node[s], marginal / total)
        for tags in itertools.product((0, 1), repeat=6):
            w = math.exp(start[tags[0]] + sum(emit[s, i, t] for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            for a, b in itertools.pairwise(tags):
                edges[a, b] += w / total
    assert np.allclose(edge, edges)


def test_scores_are_those_of_the_whole_chain(spark):
    """The query's spans and scores against a chain over every token, by the plain recursions."""
    rows, labels = toxic_rows(200)
    docs, known = as_table(spark, rows + [(500, None), (501, ""), (502, "nastyword")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    for r in toxicity.score_documents(docs, model).collect():
        text = dict(rows).get(r.doc_id, "nastyword" if r.doc_id == 502 else "")
        w = kernel(toxicity.lowered(pa.array([text]))[0].as_py()) if text else None
        n = len(w.hash) if w else 0
        p = np.zeros(0)
        if n:
            emit = np.zeros((1, n, 2))
            emit[0, :, 1] = model.bias
            for t, h in zip(*toxicity.word_features(w)):
                emit[0, t, 1] += weight.get(int(h), 0.0)
            listed = np.unique([t for t, h in zip(*toxicity.word_features(w)) if int(h) in weight]).astype(int)
            p = toxicity._chain(emit, model.trans, model.start)[1][0, listed, 1]
            assert [(s.start, round(s.marginal, 6)) for s in r.spans] == [(int(w.start[t]), round(x, 6)) for t, x in zip(listed, p) if x > 0.5]
        x = toxicity._summary(p, n)
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.scale)))), abs=1e-9)


def test_toxicity_without_labels(spark, none, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(odd, toxicity.train(odd, empty)).collect()
    assert len(out) == len(odd_rows()) and all(r.predicted == 0 for r in out)
    assert toxicity.score_documents(none, toxicity.train(none, empty)).count() == 0


# -- token counts


def test_counts_are_the_librarys(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = collections.Counter(tuple(r) for r in token_counts.token_counts(odd, MODEL).collect())
    assert out == collections.Counter((i, len((t or "").encode()), (n := len(sp.encode(t or ""))), n > 4096) for i, t in odd_rows())
    assert token_counts.token_counts(none, MODEL).count() == 0


def test_splits_are_safe():
    counter = token_counts.Counter(MODEL)
    rng = random.Random(9)
    pieces = ["a", "the", " ", "  ", "\n", "▁", "é", "x ", ". ", "<s>", "\t", "日本", " \n", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(60))
        parts = list(counter.parts(text, rng.randint(1, 20)))
        assert sum(len(counter.model.encode(p)) - off for p, off in parts) == len(counter.model.encode(text))


# -- fingerprints


def test_prefix_hashes():
    rng = random.Random(3)
    text = "".join(rng.choice("ab漢") for _ in range(400))
    h = fingerprints.PrefixHash(fingerprints._codes(text))
    for _ in range(400):
        i, j = rng.randrange(400), rng.randrange(400)
        n = rng.randrange(0, 400 - max(i, j) + 1)
        assert h.same(i, h, j, n) == (text[i : i + n] == text[j : j + n])
        want = next((k for k in range(400 - max(i, j)) if text[i + k] != text[j + k]), 400 - max(i, j))
        assert h.extension(i, h, j) == want


def test_fingerprints(odd, none, spark):
    rows = [(i, t) for i, t in odd_rows() if i is not None and i not in (4, 6)]
    out = {r.doc_id: r for r in fingerprints.fingerprints(as_table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        t, nxt = t or "", nxt or ""
        m = len(t) // 3
        new = t[: len(t) - m] + nxt[:m]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.edited_fingerprint == str(fingerprints.Print(fingerprints.PrefixHash(fingerprints._codes(new))))
        assert r.prefix_next == next((k for k in range(min(len(t), len(nxt))) if t[k] != nxt[k]), min(len(t), len(nxt)))
    assert out[1].fingerprint == out[2].fingerprint and out[1].fingerprint != out[3].fingerprint
    assert out[2].near_next == 1.0
    assert fingerprints.fingerprints(odd).count() == len(odd_rows()) and fingerprints.fingerprints(none).count() == 0


def test_short_texts_have_spans_in_common():
    def printed(text):
        return fingerprints.Print(fingerprints.PrefixHash(fingerprints._codes(text)))

    full = "The quick brown fox jumps over a lazy dog; 0123456789 were VEXED by Zeus, Kim & Q."
    for n in range(3, 80):
        text = full[:n]
        new = fingerprints.edited(text, "~" * 100)
        assert new != text and 0 < printed(text).likeness(printed(new)) < 1
        assert printed(text).likeness(printed(new)) == printed(new).likeness(printed(text))
        assert printed(text).likeness(printed("^" * 200)) == 0
    assert printed(full[:30]).likeness(printed(full[:29] + "~")) > 0.7
    assert printed("").likeness(printed("a")) == 0 and printed("").likeness(printed("")) == 1


def plain_likeness(a, b):
    """Print.likeness() by plain string comparison, of texts of which every span is an anchor."""
    if a == b:
        return 1.0
    span = fingerprints._span(min(len(a), len(b)))
    if span > min(len(a), len(b)):
        return 0.0
    prefix = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    suffix = next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
    found = [(0, 0, prefix)] * (prefix >= span) + [(len(a) - suffix, len(b) - suffix, suffix)] * (suffix >= span)
    first = [{}, {}]
    for seen, text in zip(first, (a, b)):
        for i in range(len(text) - span + 1):
            seen.setdefault(text[i : i + span], i)
    for i, j in sorted((i, first[1][x]) for x, i in first[0].items() if x in first[1]):
        if not any(x <= i and i + span <= x + n and y <= j and j + span <= y + n for x, y, n in found):
            back = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
            on = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            found.append((i - back, j - back, back + on))
    covered = [len({p for s in found for p in range(s[side], s[side] + s[2])}) for side in (0, 1)]
    return sum(covered) / (len(a) + len(b))


def test_likeness_is_that_of_plain_strings():
    rng = random.Random(12)
    for _ in range(150):
        a = " ".join(words(rng.randint(0, 6), rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 30)] = rng.choice(["", "Q", " other words instead ", a[:40]])
        b = "".join(b) if rng.random() < 0.9 else " ".join(words(99, 30))
        pa_, pb = (fingerprints.Print(fingerprints.PrefixHash(fingerprints._codes(x))) for x in (a, b))
        wanted = plain_likeness(a, b)
        sampled = bool(len(np.intersect1d(pa_.sample(span := fingerprints._span(min(len(a), len(b)))), pb.sample(span)))) if min(len(a), len(b)) else False
        got = pa_.likeness(pb)
        assert got == pytest.approx(pb.likeness(pa_)) and 0 <= got <= 1
        assert got == pytest.approx(wanted) if sampled or a == b else got <= wanted + 1e-9


def test_near_copies_are_like_and_others_are_not():
    long = " ".join(words(3, 4000))
    printed = lambda t: fingerprints.Print(fingerprints.PrefixHash(fingerprints._codes(t)))
    w = long.split()
    for i in range(0, len(w), 50):
        w[i] = "edited"
    assert printed(long).likeness(printed(" ".join(w))) > 0.9
    assert printed(long).likeness(printed(" ".join(words(4, 4000)))) < 0.05


# -- licenses


def plain_alignment(want, have):
    """Matched tokens of the best local alignment without a band."""
    best = (0, 0)
    score = [[(0, 0)] * (len(have) + 1) for _ in range(len(want) + 1)]
    for i in range(1, len(want) + 1):
        for j in range(1, len(have) + 1):
            same = want[i - 1] == have[j - 1]
            up = lambda c, s, m: (c[0] + s, c[1] + m)
            score[i][j] = max((0, 0), up(score[i - 1][j - 1], licenses.MATCH if same else licenses.MISMATCH, int(same)), up(score[i - 1][j], licenses.GAP, 0), up(score[i][j - 1], licenses.GAP, 0))
            best = max(best, score[i][j])
    return best[1]


def test_licenses(spark, none):
    rng = random.Random(6)
    rows, wanted = [], set()
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = text.split()
        if len(w) > 20:
            for _ in range(len(w) // 20):
                w[rng.randrange(len(w))] = "changed"
            del w[5]
            w.insert(12, "extra")
        rows.append((i, " ".join(words(i, 30)) + "\n" + " ".join(w).upper() + " " + " ".join(words(i + 50, 30))))
        wanted.add((i, name))
    rows += [(100 + (i or 0), t) for i, t in odd_rows()]
    out = licenses.license_scan(as_table(spark, rows)).collect()
    assert wanted <= {(r.doc_id, r.license) for r in out} and all(r.doc_id < 100 for r in out)
    text = dict(rows)
    for r in out:
        want, have = kernel(licenses.TEMPLATES[r.license]).hash.tolist(), kernel(text[r.doc_id]).hash.tolist()
        assert r.matched == plain_alignment(want, have)
        assert r.coverage == r.matched / r.template_tokens >= licenses.COVERAGE
        inside = kernel(text[r.doc_id][r.start : r.end]).hash.tolist()
        assert plain_alignment(want, inside) == r.matched
    assert licenses.license_scan(none).count() == 0
    table = spark.createDataFrame([("own", "do with these few lines whatever you like"), (None, "x y z"), ("no text", None)], "license string, text string")
    found = licenses.license_scan(as_table(spark, [(1, "You may DO with these few lines whatever you like, friend.")]), table).collect()
    assert [(r.doc_id, r.license, r.matched) for r in found] == [(1, "own", 8)]


def test_close_copies_of_a_license_line(spark):
    rows = [(1, "Released under the MIT License. " * 4), (2, "one: Licensed under CC BY-NC 4.0.\ntwo: Licensed under CC BY-NC 4.0.\nthree: licensed under cc by-nc 4.0")]
    rows += [(3, " ".join(f"p{i} " + licenses.TEMPLATES["gpl-3.0-line"] for i in range(30)))]
    out = licenses.license_scan(as_table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.license) for r in out) == {(1, "mit-line"): 4, (2, "cc-by-nc-4.0-line"): 3, (3, "gpl-3.0-line"): 30}
    text = dict(rows)
    for r in out:
        assert kernel(text[r.doc_id][r.start : r.end]).hash.tolist() == kernel(licenses.TEMPLATES[r.license]).hash.tolist()
        assert all(r is q or r.doc_id != q.doc_id or r.end <= q.start or q.end <= r.start for q in out)


# -- decontamination


def test_contamination(spark, odd, none):
    items = [(i, " ".join(words(3000 + i, 15 + i))) for i in range(20)] + [(50, None), (51, "too short"), (None, " ".join(words(77, 20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, wanted = [], set()
    for i, t in items[:20]:
        w = t.split()
        for k in range(3, len(w), 8):
            w[k] = "other"  # substitutions
        rows.append((i, " ".join(words(i, 50)) + ", " + " ".join(w).upper() + ". " + " ".join(words(i + 90, 50))))
        wanted.add((i, i))
        rows.append((100 + i, " ".join(words(i, 50) + t.split()[: len(t.split()) // 4] + words(5 + i, 50))))  # a quarter is no leak
    w = items[5][1].split()
    rows.append((300, " ".join(w[:10] + ["put", "in"] + w[10:])))
    wanted.add((300, 5))
    docs = as_table(spark, rows + [(500 + (i or 0), t) for i, t in odd_rows()])
    out = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == wanted
    text = dict(rows)
    for r in out:
        assert 0.5 <= r.coverage <= 1 and kernel(text[r.doc_id][r.start : r.end]).hash.size >= r.matched
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in wanted})
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    items = [(i, " ".join(words(3000 + i, 25))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = as_table(spark, [(i, " ".join(words(i, 20)) + " " + t) for i, t in items])
    one = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect())) == one and len(one) == 30


def test_pieces_in_order_add_up(spark):
    item, other = words(3100, 30), words(77, 200)
    a, b, c = item[:10], item[10:20], item[20:]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "four tokens of item")], "item_id long, text string")
    texts = {
        1: other[:40] + a + other[40:52] + b + other[52:64] + c + other[64:90],  # two insertions
        2: a + other[:10] + c,  # the middle replaced
        3: a + other[:100] + b + other[100:200] + c,  # too far apart
        4: c + other[:12] + a,  # out of order
        5: a + other[:12] + a,  # the same tokens twice
        6: "four tokens of item".split(),
    }
    out = decontamination.contaminated(as_table(spark, [(i, " ".join(w)) for i, w in texts.items()]), bench).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in out} == {(1, 1, 30), (2, 1, 20)}
    found = {r.doc_id: r for r in out}
    assert " ".join(texts[1])[found[1].start : found[1].end] == " ".join(texts[1][40:94])


def plain_overlap(want, have):
    """Most tokens of an item that one diagonal of a document matches."""
    return max((sum(0 <= d + i < len(have) and have[d + i] == t for i, t in enumerate(want)) for d in range(-len(want) + 1, len(have))), default=0)


def test_substitutions_at_every_length():
    """Of documents that hold enough of an item by comparison of every diagonal, nine in ten at least are found; prose isn't."""
    rng = np.random.default_rng(9)
    missed = {}
    for n in [*range(5, 24), 30, 45]:
        item = words(5000 + n, n)
        index = decontamination.SeedIndex([(n, " ".join(item))])
        want = index.tokens[0]
        for k in range(n - math.ceil(decontamination.needed(n)) + 1):
            found = 0
            for trial in range(60):
                w = list(item)
                for at in rng.permutation(n)[:k]:
                    w[at] = f"sub{trial}x{at}"
                doc = kernel(" ".join(words(trial, 12) + w + words(trial + 99, 12)))
                have = doc.hash
                assert plain_overlap(want.tolist(), have.tolist()) >= decontamination.needed(n)
                places = list(index.overlaps(doc))
                found += bool(places)
                assert all(p[2] >= n - k for p in places)
            missed[n, k] = 1 - found / 60
        assert not list(index.overlaps(kernel(" ".join(words(31, 400)))))
    assert max(missed.values()) <= 0.1, {x: m for x, m in missed.items() if m > 0.1}


def test_short_items_on_request(spark):
    bench = spark.createDataFrame([(1, "blue moon"), (2, "moon"), (3, "a whole item of six words")], "item_id long, text string")
    docs = as_table(spark, [(1, "once in a Blue, MOON or so"), (2, "blue as the moon"), (3, "so a whole item of seven words it is")])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(3, 3)}
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, least=2).collect()} == {(1, 1), (3, 3)}
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, least=1).collect()} == {(1, 1), (1, 2), (2, 2), (3, 3)}


def test_large_benchmarks_are_joined(spark, monkeypatch):
    items = [(i, " ".join(words(3000 + i, 8 + i))) for i in range(30)] + [(None, " ".join(words(3003, 11))), (77, None), (78, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join(words(i, 20)) + " " + t.replace(t.split()[2], "sub") + " " + " ".join(words(i + 7, 20)) + " " + t) for i, t in items[:30]]
    docs = as_table(spark, rows + [rows[4], (None, rows[5][1]), *((600 + (i or 0), t) for i, t in odd_rows())])
    one = sorted(map(str, decontamination.contaminated(docs, bench).collect()))
    kept = sorted(str(r.doc_id) for r in decontamination.without_contaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert sorted(map(str, decontamination.contaminated(docs, bench).collect())) == one and len(one) >= 32
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == kept
