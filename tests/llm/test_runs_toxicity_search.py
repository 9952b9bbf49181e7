"""Periodic runs, toxicity and ranked search against brute force and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealerflow.llm import max_sketch, periodic_runs, queries, toxicity, training
from dealerflow.llm.common import saved, ship_package
from dealerflow.llm.words import MARKS, word_hashes

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, runs int, start int, id long, n long, score double"


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 7, 8, 9, 10, 0.5) for i, t in rows], DOCS)


def stored(spark, folder, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def prose(n, seed):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 3000, n)]


# --- periodic runs ----------------------------------------------------------


def brute_runs(words, least=periodic_runs.LEAST, times=periodic_runs.TIMES):
    """Every period in turn: the longest stretches on which words so far apart are identical."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def runs_by_operator(docs, least, times):
    words = np.array([w for d in docs for w in d], np.uint64)
    runs, begin = periodic_runs.runs_of(words, np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64), least, times)
    return [[tuple(r) for r in runs[a:b].tolist()] for a, b in zip(begin, begin[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_runs_like_brute_force(data):
    docs = []
    for _ in range(data.draw(st.integers(1, 3))):
        words = data.draw(st.lists(st.integers(1, data.draw(st.integers(1, 3))), max_size=60))
        if words and data.draw(st.booleans()):
            a = data.draw(st.integers(0, len(words) - 1))
            p = data.draw(st.integers(1, max(1, (len(words) - a) // 2)))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        docs.append(words * data.draw(st.integers(1, 3)))
    least, times = data.draw(st.sampled_from([(24, 3), (10, 3), (5, 2), (12, 4)]))
    assert runs_by_operator(docs, least, times) == [brute_runs(d, least, times) for d in docs]


def test_runs_of_fibonacci_words_and_long_texts():
    a, b = [1], [1, 2]
    while len(b) < 600:
        a, b = b, b + a
    assert runs_by_operator([b], 6, 2) == [brute_runs(b, 6, 2)]
    long = np.random.default_rng(3).integers(0, 9000, 200_000)
    long[50_000:] = long[50_000 + np.arange(150_000) % 40_000]
    assert runs_by_operator([long.tolist()], 24, 3) == [[(50_000, 150_000, 40_000)]]
    same = [5] * 50_000
    assert runs_by_operator([same, [], same], 24, 3) == [[(0, 50_000, 1)], [], [(0, 50_000, 1)]]


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, gone = brute_runs(words), set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def edge_docs():
    bent = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(prose(30 + 9 * (i % 40), i))) for i in bent]
    rows += [(1000, "a b c " * 20), (1001, "x\t" * 300 + "\n" + "x " * 30), (1002, None), (1003, ""), (1004, " \x0b\n"), (1005, "é ü " * 40)]
    rows += [(1006, "a " * 12 + "b " + "a " * 12), (1007, "a " * 24), (1008, "a " * 23), (1009, " ".join(prose(2500, 1) * 3)), (1009, "a b c " * 20)]
    return rows + [(None, "a b " * 30), (None, None), (bent[0], None), (bent[1], ""), (bent[2], "one")]


def test_runs_query_like_brute_force(shipped, tmp_path):
    rows = edge_docs()
    folder = stored(shipped, tmp_path, documents=table(shipped, rows))
    got = collections.Counter(tuple(r) for r in queries.queries()["op11_periodic_runs"](shipped, folder).collect())
    assert got == collections.Counter(expected_runs(*r) for r in rows)
    assert sum(1 for r in got if r[1]) > 30


def test_runs_keep_rows_and_columns(shipped):
    found = periodic_runs.find_runs(table(shipped, edge_docs()))
    assert found.columns == ["row", "n_words", "runs", "collapsed"] and found.count() == len(edge_docs())
    row = found.where("row.doc_id = 1000").first()
    assert row.collapsed == "a b c" and row.row.start == 8 and [tuple(r) for r in row.runs] == [(0, 60, 3)]
    assert periodic_runs.find_runs(table(shipped, []).limit(0)).count() == 0


# --- toxicity ---------------------------------------------------------------


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_pooled_responses_like_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(prose(n, n)) for n in (0, 1, 2, 3, 40, 0, 200, 1)]
    rows, at, _ = toxicity.buckets(*arrays(texts))
    table_, filters, weights = toxicity._start(rng)
    model = toxicity.Model(table_, tuple(filters), weights, 0.3, np.zeros(5))
    expected = np.zeros((len(texts), len(toxicity.WIDTHS) * toxicity.FILTERS))
    for d in range(len(texts)):
        vectors = [table_[rows[i]].sum(axis=0) for i in range(at[d], at[d + 1])] + [np.zeros(toxicity.DIMS)] * 3
        for w, width in enumerate(toxicity.WIDTHS):
            for i in range(at[d + 1] - at[d]):
                own = np.concatenate(vectors[i : i + width]) @ filters[w]
                part = expected[d, w * toxicity.FILTERS : (w + 1) * toxicity.FILTERS]
                np.maximum(part, own, out=part)
    for block in (1 << 15, 7, 1):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(model.pooled(rows, at), expected, atol=1e-5)


def test_steps_follow_the_gradient():
    """One step with a tiny rate moves the loss down, and each part of the model with it."""
    texts = [" ".join(prose(30, k)) + (" badword" if k % 2 else "") for k in range(16)]
    rows, at, _ = toxicity.buckets(*arrays(texts))
    labels = np.arange(16) % 2 * 1.0

    def loss(model):
        margin = model.raw_margins(rows, at)
        return float(np.mean(np.log1p(np.exp(np.where(labels > 0, -margin, margin)))))

    losses = [loss(toxicity.fit(rows, at, labels, epochs=n, rate=0.01)) for n in (0, 1, 4, 30)]
    assert losses[0] > losses[1] > losses[2] > losses[3] and losses[3] < 0.1


def test_languages_and_margins():
    words, _, _, at = word_hashes(*arrays(["the cat of and", "der Hund und die", "le chat et les", "el gato que los", "zzz", ""]), True, MARKS)
    assert [toxicity.LANGUAGES[k] for k in toxicity.languages(words, at)] == ["en", "de", "fr", "es", "other", "other"]
    assert toxicity.best_margin(np.array([1.0, 2, 3, 6, 7]), np.array([0, 0, 0, 1, 1])) == 4.5
    rows, at, _ = toxicity.buckets(*arrays(["a b"] * 60))
    model = toxicity.fit(rows, at, np.zeros(60))
    language = np.repeat([0, 1], 30)
    own = toxicity.calibrate(model, rows, at, language, np.tile([0.0, 1.0], 30))
    assert len(own.margins) == 5 and np.isfinite(own.margins).all()


def labelled(spark):
    """Half of the stems of the toxic words occur with endings of their own in every text."""
    rng, rows, labels = np.random.default_rng(4), [], []
    common = {"en": "the of and to", "de": "der die und ein"}
    for i in range(1500):
        lang = "en" if i % 3 else "de"
        words = [*prose(int(rng.integers(20, 120)), i), *common[lang].split() * 3]
        toxic = i % 4 == 0
        if toxic:
            stems = ["idiot", "scum", "clown"] if lang == "en" else ["lowei" + str(int(rng.integers(0, 400))), "vequ" + str(int(rng.integers(0, 400)))]
            for s in stems[: int(rng.integers(1, 4))]:
                words.insert(int(rng.integers(0, len(words))), s)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_never_sees_held_out(shipped, tmp_path):
    rows, labels = labelled(shipped)
    edges = [(9000, None), (9001, ""), (None, "idiot"), (9002, "the " * 40_000 + "scum"), (9002, "the end")]
    docs = table(shipped, rows + edges)
    marks = shipped.createDataFrame([*labels, (None, 1), (9002, None)], "doc_id long, toxic int")
    folder = stored(shipped, tmp_path, documents=docs, labels=marks)
    got = queries.queries()["op12_toxicity"](shipped, folder).collect()
    assert len(got) == len(rows) + len(edges)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 200 < len(held) < 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    empty = {r.score for r in got if r.doc_id in (9000, 9001)}
    assert len(empty) == 1
    # Held-out labels and other columns change nothing.
    flip = "doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic"
    model, other = toxicity.train(docs, marks), toxicity.train(docs.withColumn("lang", docs["source"]), marks.selectExpr(*flip))
    assert np.array_equal(model.table, other.table) and np.array_equal(model.margins, other.margins)


def test_toxicity_without_labels(shipped):
    docs = table(shipped, [(k, "a") for k in range(8)] + [(8, None)])
    none = shipped.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert [r.score for r in toxicity.score_documents(docs, model).collect()] == pytest.approx([0] * 9, abs=1e-4)
    one = toxicity.train(docs, shipped.createDataFrame([(k, 1) for k in range(9)], "doc_id long, toxic int"))
    assert all(r.score > 0.9 for r in toxicity.score_documents(docs, one).collect())
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_peaks_of_long_texts_are_those_of_one_block(monkeypatch):
    rows, at, _ = toxicity.buckets(*arrays([" ".join(prose(n, n)) for n in (0, 1, 2, 40, 0, 200, 1)]))
    laid, begins = toxicity._padded(rows, at)
    model = toxicity._model(toxicity._first_state())
    whole = model.peaks(laid, begins, begins + np.diff(at) + 1)
    for block in (7, 1):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for one, other in zip(whole, model.peaks(laid, begins, begins + np.diff(at) + 1), strict=True):
            assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(one, other, strict=True))


def test_toxicity_learns_from_every_label_in_shards(shipped, monkeypatch):
    """All labelled texts are fitted on or calibrate, long ones too, in one shard or many; one shard is the plain fit."""
    rows, labels = labelled(shipped)
    # A word that only long texts have, its label with it: left out, it would say nothing.
    rows += [(k, "the of and to " * 5000 + ("zzqqx " * 3 if k % 2 else "")) for k in range(2000, 2024)]
    labels += [(k, k % 2) for k in range(2000, 2024)]
    docs, marks = table(shipped, rows), shipped.createDataFrame(labels, "doc_id long, toxic int")
    texts = dict(rows)
    known = [(k, y) for k, y in sorted(labels) if zlib.crc32(str(k).encode()) % 5]
    fitted, own = ([(k, y) for k, y in known if toxicity._calibrates(k) == c] for c in (False, True))
    assert len(fitted) + len(own) == len(known) > 1150
    plain = toxicity.fit(*toxicity.buckets(*arrays([texts[k] for k, _ in fitted]))[:2], np.array([y for _, y in fitted], float))
    model = toxicity.train(docs, marks)
    assert np.array_equal(model.table, plain.table) and np.array_equal(model.weights, plain.weights) and model.bias == plain.bias
    own_rows = toxicity.buckets(*arrays([texts[k] for k, _ in own]))
    assert np.allclose(model.margins, toxicity.calibrate(plain, *own_rows, np.array([y for _, y in own])).margins, atol=1 / toxicity.GRID)
    monkeypatch.setattr(training, "SHARD", 1 << 19)
    split, again = toxicity.train(docs, marks), toxicity.train(docs.repartition(5), marks)
    assert np.array_equal(split.table, again.table) and not np.array_equal(split.table, model.table)
    for found in (model, split):
        scores = toxicity.score_documents(docs, found).select("row.doc_id", "score").collect()
        held = [r for r in scores if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
        assert sum((r.score >= 0.5) == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)
        assert all((r.score >= 0.5) == r.doc_id % 2 for r in scores if r.doc_id >= 2000)


# --- ranked search ----------------------------------------------------------


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_ranks(docs, items, best=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    documents, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in asked}
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * documents // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return out


def search_docs():
    rows = [(i, " ".join(prose(5 + i % 90, i) + prose(4, 7000 + i % 11))) for i in range(300)]
    rows += [(400, "W1 w2-W3 É"), (401, None), (402, ""), (403, "--"), (404, "zz " * 400), (None, "w5 w6"), (None, "w5 w6"), (7, "zz w9")]
    return rows + [(500 + k, "tie tie zz") for k in range(14)]


def search_items():
    items = [(k, " ".join(prose(12, k) + prose(4, 7000 + k % 11))) for k in range(20)]
    return items + [(30, "ZZ Tie"), (31, "none such"), (32, None), (33, ""), (34, "w5 W6 w5 é"), (35, " ".join(prose(2000, 5)))]


@pytest.mark.parametrize("sizes", [(256, 256, 8), (3, 10, 1)])
def test_search_like_brute_force(shipped, monkeypatch, sizes):
    monkeypatch.setattr(max_sketch, "ITEMS", sizes[0])
    monkeypatch.setattr(max_sketch, "GROUP", sizes[1])
    monkeypatch.setattr(max_sketch, "STEP", sizes[2])
    index = saved(max_sketch.build_index(table(shipped, search_docs()).repartition(3)))
    items = shipped.createDataFrame(search_items(), "item_id int, text string")
    got = sorted((tuple(r) for r in max_sketch.search(index, items).collect()), key=str)
    assert got == sorted(brute_ranks(search_docs(), search_items()), key=str)


def test_search_of_empty_tables(shipped):
    docs, items = table(shipped, search_docs()), shipped.createDataFrame(search_items(), "item_id int, text string")
    index = saved(max_sketch.build_index(docs.limit(0)))
    assert max_sketch.search(index, items).count() == 0
    assert max_sketch.search(saved(max_sketch.build_index(docs)), items.limit(0)).count() == 0
    assert max_sketch.search(saved(max_sketch.build_index(docs.where("doc_id = 402"))), items).count() == 0


def test_items_with_repeated_and_null_ids_are_asked_each(shipped):
    index = saved(max_sketch.build_index(table(shipped, search_docs())))
    items = shipped.createDataFrame([(1, "tie"), (1, "zz"), (None, "tie")], "item_id int, text string")
    got = collections.Counter((r.item_id, r.doc_id) for r in max_sketch.search(index, items).collect())
    assert sum(n for (i, _), n in got.items() if i == 1) == 20 and sum(n for (i, _), n in got.items() if i is None) == 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 600)), min_size=1, max_size=60, unique_by=lambda x: x[0]), st.data())
def test_bounds_are_never_below_scores(postings, data):
    own = np.array(sorted(t for t, _ in postings), np.uint64)
    times = np.array([n for _, n in sorted(postings)], np.int64)
    others = data.draw(st.lists(st.integers(0, 2**64 - 1), max_size=30))
    asked = np.unique(np.concatenate([own[:: data.draw(st.integers(1, 4))], np.array(others, np.uint64)]))
    weights = np.array([data.draw(st.integers(0, 30_000)) for _ in asked], np.int64)
    batch = max_sketch.Batch(asked, np.arange(1), (np.arange(len(asked)),), (weights,))
    searcher = max_sketch.Searcher(batch, 50, 9000, 10)
    n = int(times.sum())
    m = np.array([10 + 90 * n * 50 // 9000])
    bound = searcher.bounds(max_sketch.sketch(own, times)[None], m)[0, 0]
    tf = dict(zip(own.tolist(), times.tolist(), strict=True))
    exact = sum(int(w) * (10**9 * tf[t] // (1000 * tf[t] + 8 * int(m[0]))) for t, w in zip(asked.tolist(), weights, strict=True) if t in tf)
    assert bound >= exact + 1 - 1e-6
    searcher.take([1], np.array([n]), max_sketch.sketch(own, times)[None], [own.astype("<u8").tobytes()], [times.astype("<u4").tobytes()])
    assert searcher.held[0] == ([(-exact, False, 1)] if exact else [])


def test_bounds_spare_documents():
    """Documents that share nothing with an item are not scored once its best are known."""
    texts = [" ".join(prose(40, k) + (["needle", "hay"] * 3 if k < 12 else [])) for k in range(400)]
    raw, offsets = arrays(texts)
    words, _, _, at = word_hashes(raw, offsets, True, MARKS)
    asked = np.unique(word_hashes(*arrays(["needle hay"]), True, MARKS)[0])
    batch = max_sketch.Batch(asked, np.arange(1), (np.arange(2),), (np.array([3000, 3000]),))
    searcher = max_sketch.Searcher(batch, 400, len(words), 10)
    for k in range(400):
        own, times = np.unique(words[at[k] : at[k + 1]], return_counts=True)
        searcher.take([k], np.array([at[k + 1] - at[k]]), max_sketch.sketch(own, times)[None], [own.astype("<u8").tobytes()], [times.astype("<u4").tobytes()])
    assert searcher.scored < 100 and len(searcher.held[0]) == 10
