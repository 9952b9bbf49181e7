"""Corpus operators against brute force, SQL twins and edge cases."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from compare import assert_same, duck
from dealerflow.llm import (
    chat, common, components, hilbert_ann, license_scan, mixing, ngram_join, oracle, packing, quality, queries, radix_dedup,
    recompression, training, url_filter, words,
)
from dealerflow.llm.common import ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size int, keys string"


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), -1, "x", 7, "k") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def passage(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, 5000, n)]


def edge_rows():
    base = passage(300, 1)
    near = [*base[:100], "edit", *base[101:]]
    far = [*passage(80, 2), *base[:60], *passage(80, 3)]
    long = passage(60_000, 4)
    return [
        (1, " ".join(base), "a"), (2, "  ".join(base) + "\n", "a"), (3, " ".join(near), "b"), (4, " ".join(far), None),
        (5, None, "b"), (6, "", None), (7, " \n\t", "c"), (8, "one two", "c"), (9, "One two", "c"),
        (10, " ".join(long), "a"), (11, " ".join(long[:50_000]), "b"), (12, "A b c d e", "a"), (13, "a B c d e", "a"),
        (14, "x " * 400, "c"), (15, "x " * 300, "c"), (16, "Licensed under CC BY-NC 4.0.\n" + " ".join(base[:20]), "a"),
        (17, "é" * 40 + " " + " ".join(base[:14]), "b"), (1, " ".join(base), "a"), (None, "no id", "a"),
    ]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# --- twins -----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_twin(spark, sf_dir, name):
    assert assert_same(queries.queries()[name](spark, sf_dir), duck(sf_dir), oracle.QUERIES[name]) > 0


# --- licences --------------------------------------------------------------


def distance_to_part(text, notice):
    """Least edits between the notice and any run of whole words of the text."""
    best, parts = len(notice), text.split(" ")
    for i in range(len(parts)):
        row = list(range(len(notice) + 1))
        for j, part in enumerate(parts[i:]):
            for c in (" " + part) if j else part:
                row = [row[0] + 1, *row[1:]]
                previous = [x for x in row]
                previous[0] -= 1
                new = [row[0]]
                for k, n in enumerate(notice, 1):
                    new.append(min(new[-1] + 1, row[k] + 1, previous[k - 1] + (c != n)))
                row = new
            best = min(best, row[-1])
            if len(" ".join(parts[i : i + j + 1])) > 2 * len(notice):
                break
    return best


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_fuzzy_notice_found_like_brute_force(data):
    notice = license_scan.Notice("l", "all rights reserved", 2)
    text = list("some all rights reserved words")
    for _ in range(data.draw(st.integers(0, 4))):
        at = data.draw(st.integers(5, len(text) - 6))
        text[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "x", "q"]))
    flat, _ = license_scan.normalise("".join(text))
    expected = distance_to_part(flat.strip(), notice.text)
    found = license_scan.places(flat, notice)
    assert bool(found) == (expected <= 2)
    if found:
        assert min(e for _, _, e in found) == expected


def test_notice_places_and_spans(shipped):
    text = "ALL rights-reserved. CC by, cc BY cc by 4.0 é All Rights Reservd"
    n, matches = license_scan.scan_text(text, (*license_scan.BASE, *license_scan.FUZZY))
    assert n == 15
    base = [(m["label"], m["word"], text[m["start"] : m["end"]]) for m in matches if m["base"]]
    assert base == [("reserved", 0, "ALL rights-reserved"), ("cc-by", 3, "CC by"), ("cc-by", 5, "cc BY"), ("cc-by", 7, "cc by")]
    fuzzy = [(text[m["start"] : m["end"]], m["edits"]) for m in matches if not m["base"]]
    assert ("All Rights Reservd", 1) in fuzzy
    rows = license_scan.scan_notices(table(shipped, edge_rows())).collect()
    assert len(rows) == len(edge_rows())
    assert {r.doc_id for r in rows if r.matches} == {16}


def test_edited_notices_before_an_exact_one():
    notice = license_scan.Notice("mpl", "mozilla public license version", 3)
    edited = "mozilla public licence version"
    assert license_scan.places(f" {edited} {notice.text} ", notice) == [(1, 31, 1), (32, 62, 0)]
    for mixed in ([edited] * 50 + [notice.text], [notice.text, edited, "x", edited, notice.text, edited.replace("public", "publik")]):
        flat, _ = license_scan.normalise(" ".join(mixed))
        expected, at = [], 1
        for part in mixed:
            if part != "x":
                expected.append((at, at + len(part), sum(a != b for a, b in zip(part, notice.text, strict=True))))
            at += len(part) + 1
        assert license_scan.places(flat, notice) == expected


def test_base_columns_like_brute_force(shipped, sf_dir, tmp_path):
    """n_words, n_base, first and last word and base labels of the query, over whole tables."""
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    edges = [(9001, None, "a"), (9002, "", "a"), (9003, "CC BY cc by-cc BY", "a"), (9003, "all all rights reserved\x00rights", "a"), (None, "General public\nLICENSE é", "a")]
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").unionByName(
        shipped.createDataFrame(edges, "doc_id long, text string, source string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = collections.Counter()
    for r in docs.collect():
        w = word.findall(lowered(r.text))
        places = [(k, label) for phrase, label in phrases.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        expected[r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = queries.queries()["op1_license_scan"](shipped, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
    assert sum(n for key, n in expected.items() if key[2]) > 3
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["all rights reserved", "all right reserved", "al rights resrved", "rights", "reserved", "all", "x"]), max_size=12))
def test_no_place_of_a_notice_is_left_between_those_found(parts):
    notice = license_scan.Notice("l", "all rights reserved", 2)
    flat, _ = license_scan.normalise(" ".join(parts))
    found = license_scan.places(flat, notice)
    edges = [0, *(x for a, b, _ in found for x in (a, b)), len(flat)]
    assert edges == sorted(edges)
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        assert not flat[low:high].strip() or distance_to_part(flat[low:high].strip(), notice.text) > 2
    assert all(distance_to_part(flat[a:b], notice.text) <= e for a, b, e in found)


# --- words -----------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBé \n\x0b日\x85", max_size=30), min_size=1, max_size=6))
def test_word_hashes(docs):
    blobs = [d.encode() for d in docs]
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    hashes, starts, ends, at = words.word_hashes(raw, offsets, lower=True)
    got = [[raw[starts[i] : ends[i]].tobytes().decode() for i in range(at[k], at[k + 1])] for k in range(len(docs))]
    assert got == [WORD.findall(d) for d in docs]
    names = collections.defaultdict(set)
    for h, a, b in zip(hashes, starts, ends):
        names[lowered(raw[a:b].tobytes().decode())].add(int(h))
    assert all(len(x) == 1 for x in names.values()) and len({min(x) for x in names.values()}) == len(names)


# --- near duplicates -------------------------------------------------------


def by_id(rows):
    """The rows in the order of ids, null last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def brute_components(rows):
    """Size of the set and smallest number of the component of every row, by its number in the order of ids."""
    sets = {}
    for i, (_, text, *_) in enumerate(by_id(rows)):
        w = WORD.findall(lowered(text))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            shared = len(sets[i] & sets[j])
            if i < j and shared and 100 * shared >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def chains():
    """Texts that link in a chain only, families of many edits, and a passage that many share."""
    rng, rows, i = np.random.default_rng(5), [], 100
    for family in range(4):
        text = passage(160, 50 + family)
        for _ in range(25):
            rows.append((i, " ".join(text), "a"))
            i += 1
            text = list(text)
            for at in rng.integers(0, len(text), int(rng.integers(1, 5))):
                text[at] = f"e{rng.integers(0, 10**6)}"
    shared = passage(30, 77)
    for k in range(40):
        rows.append((i + k, " ".join([*shared, *passage(25, 200 + k)]), "b"))
    return rows


@pytest.mark.parametrize("rows", [edge_rows(), chains()], ids=["edges", "chains"])
def test_near_duplicates(shipped, rows):
    got = collections.Counter(tuple(r) for r in ngram_join.near_duplicates(table(shipped, rows)).collect())
    ids = [r[0] for r in by_id(rows)]
    assert got == collections.Counter((ids[i], n, ids[c]) for i, (n, c) in brute_components(rows).items())


def test_components_of_long_chains(shipped):
    chain = [(k, k + 1) for k in range(1, 300)] + [(2 * k, 2 * k + 2) for k in range(500, 600)] + [(900, 900)]
    links = shipped.createDataFrame(chain, "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 301), 1), **dict.fromkeys(range(1000, 1201, 2), 1000)}
    assert components.components(links.limit(0)).isEmpty()


def test_components(shipped):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(1, 200)]
    got = {r.id: r.component for r in components.components(shipped.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


# --- repeats ---------------------------------------------------------------


@pytest.mark.parametrize("rows", [edge_rows(), chains()], ids=["edges", "chains"])
def test_remove_repeats(shipped, rows):
    numbers = {r.row_key: r for r in common.with_row_key(table(shipped, rows).select("doc_id", "text")).collect()}
    ids, texts = {k: r.doc_id for k, r in numbers.items()}, {k: WORD.findall(r.text or "") for k, r in numbers.items()}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 12):
            first.setdefault(tuple(texts[i][k : k + 13]), i)
    got = collections.Counter(tuple(r) for r in recompression.remove_repeats(table(shipped, rows)).collect())
    expected = collections.Counter()
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[ids[i], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == expected


# --- exact duplicates, mixing ----------------------------------------------


def test_exact_duplicates(shipped):
    rows = radix_dedup.exact_duplicates(table(shipped, edge_rows())).collect()
    assert len(rows) == len(edge_rows()) and sum(r.kept for r in rows) == len(rows) - 4
    got = {r.doc_id: (r.keep_id, r.group_size) for r in rows}
    assert got[1] == got[2] == (2, 3) and got[5] == got[6] == got[7] == (7, 3)
    assert got[10] == (10, 1) and got[11] == (11, 1) and got[None] == (None, 1)


def test_exact_duplicates_without_own_ids(shipped):
    """A third of the ids null, another third alike: every row is counted, and one of each group stays."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k % 40}" + " " * (k % 7), "a") for k in range(600)]
    got = radix_dedup.exact_duplicates(table(shipped, rows)).collect()
    assert len(got) == 600 and sum(r.kept for r in got) == 40 and {r.group_size for r in got} == {15}
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, *_ in rows)
    for r in got:
        longest = [i for i, t, _ in rows if hashlib.sha256(t.replace(" ", "").encode()).hexdigest() == r.text_sha256 and len(t) == max(
            len(u) for _, u, _ in rows if u.split() == t.split())]
        assert r.keep_id == min(longest, key=lambda i: (i is None, i or 0))


def test_exact_duplicates_of_wide_blocks(shipped, monkeypatch):
    """Texts that part only far behind their heads, in blocks of several parts, and few rounds for them."""
    monkeypatch.setattr(radix_dedup, "PART", 1000)
    rounds = []
    split = radix_dedup._split
    monkeypatch.setattr(radix_dedup, "_split", lambda members, total: rounds.append(1) or split(members, total))
    texts = ["a" * 300_000, "a" * 299_999 + "b", "a" * 150_000 + "b" + "a" * 149_999, "a" * 250_000]
    rows = [(10 * k + i, t, "s") for k in range(3) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in radix_dedup.exact_duplicates(table(shipped, rows)).collect()}
    assert got == {10 * k + i: (i, 3) for k in range(3) for i in range(4)} and len(rounds) <= 6


def test_exact_duplicates_of_long_texts_with_equal_heads(shipped):
    heads = ["h" * 64, "h" * 63 + "g"]
    texts = [h + m * n + e for h in heads for m in "ab" for n in (0, 511, 512, 5000, 40000) for e in ("x", "y")]
    rows = [(k * 1000 + i, t if k else " ".join([t[:70], t[70:]]), "s") for k in range(3) for i, t in enumerate(texts)]
    plain = collections.defaultdict(list)
    for i, t, _ in rows:
        plain[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    want = {i: (min(group)[1], len(group)) for group in plain.values() for _, i in group}
    got = {r.doc_id: (r.keep_id, r.group_size) for r in radix_dedup.exact_duplicates(table(shipped, rows)).collect()}
    assert got == want


def test_map_of_open_heads(shipped):
    slots = [0, 7, 8, 32767, 32768, 65535, 65536, radix_dedup.BITS - 1]
    bits = radix_dedup.open_map(shipped.createDataFrame([(s,) for s in slots], "slot long"))
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == slots
    assert not radix_dedup.open_map(shipped.createDataFrame([], "slot long")).any()


def test_mixing(shipped):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3] if i % 7 else None) for i in range(3000)] + [(9999, None, "z")]
    got = mixing.mix_to_targets(table(shipped, rows)).collect()
    assert len(got) == 3001 and all(0 <= r.taken <= 3 * r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source] = [by[r.source][0] + r.taken, r.target, r.source_size]
    total = sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert sum(t for _, t, _ in by.values()) == pytest.approx(total)
    for taken, target, size in by.values():
        assert target <= 3 * size and abs(taken - target) <= max(50, 0.01 * target)
    again = mixing.mix_to_targets(table(shipped, rows)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixing_counts_rows_without_own_ids(shipped):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(900)]
    got = mixing.mix_to_targets(table(shipped, rows)).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len(t.split())) for i, t, _ in rows)
    assert sum({r.source: r.source_size for r in got}.values()) == sum(len(t.split()) for _, t, _ in rows)


def test_mixing_follows_the_stated_probabilities(shipped):
    """Over many seeds a document is taken as often as expected, long ones more often than short ones."""
    rows = [(i, "w " * int(2 ** (i % 7)), "ab"[i % 5 == 0]) for i in range(2100)]
    keyed = table(shipped, rows).selectExpr("doc_id as key", "text", "source")
    sized = keyed.selectExpr("false as unnamed", "source as name", "size(split(trim(text), ' ')) as size")
    classes = sized.selectExpr("*", "length(bin(size)) as bits").groupBy("unnamed", "name", "bits").agg(F.sum("size").alias("words"), F.count("size").alias("n"))
    copies = mixing.expected_copies(classes, mixing.source_targets(classes)).collect()
    expected = {(r.name, r.bits): r.whole + r.part for r in copies}
    assert all(expected[s, b] <= expected[s, b + 1] <= 3 for s, b in expected if (s, b + 1) in expected)
    assert len({round(x, 6) for x in expected.values()}) > 4
    seeds, taken = 4, collections.Counter()
    for seed in range(seeds):
        for r in mixing.copies_of(keyed, seed=str(seed)).collect():
            taken[r.name, len(f"{r.size:b}")] += r.copies
    docs = collections.Counter((s, len(f"{len(t.split()):b}")) for _, t, s in rows)
    for key, n in docs.items():
        share = expected[key] % 1
        noise = (share * (1 - share) / (seeds * n)) ** 0.5
        assert abs(taken[key] / (seeds * n) - expected[key]) < 5 * noise + 0.04, key


# --- chat ------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to]ol", "a\\]: "]), st.text(alphabet="\\#<>/turn]:A \n", max_size=25)), max_size=5))
def test_chat_round_trip(turns):
    template = chat.Template()
    text = "".join(s for role, said in turns for s, _ in template.segments(role, said))
    assert chat.read_back(text, template) == turns


def test_chat_digest(shipped):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "a</turn>b", 1), (2, 1, "assistant", "late", 1), (2, 0, "assistant", None, 1), (None, 0, None, "x", 1)]
    chats = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(chats)).collect()}
    assert got[1].valid and not got[2].valid and got[1].loss_chars == 9
    assert got[2].loss_sha256 == hashlib.sha256(b"late").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\n\nassistant\nlate\n").hexdigest()
    assert got[None].n_turns == 1


# --- neighbours ------------------------------------------------------------


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = cells[np.argsort(hilbert_ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(shipped):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[300:400] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    frame = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size, least in ((4096, 1.0), (200, 0.9)):
        got = collections.defaultdict(list)
        for r in hilbert_ann.nearest(frame, "id % 20 = 0", range_size=size).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert set(got) == set(range(0, 1500, 20))
        hits = 0
        for q, near in got.items():
            scores = x @ x[q]
            true = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
            hits += len(set(true) & set(near))
            assert len(near) == 20
        assert hits >= least * 20 * len(got)


def test_neighbours_of_a_cluster_in_one_cell(shipped):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 16))
    x[::3] = x[0] + 1e-6 * rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = shipped.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    size = 30
    nodes = common.saved(frame.selectExpr("vec_id as node", "embedding as vector"))
    reps = nodes.where("node % 3 = 0")
    curves = hilbert_ann.fit_curves(x, 1.0, 40)
    places = ["curve", "range", "part", "turn"]
    data, asked = hilbert_ann.deal(nodes, reps, curves, 1, size)
    assert data.groupBy("curve", "range").agg({"node": "approx_count_distinct"}).agg({"approx_count_distinct(node)": "max"}).first()[0] > 300
    for rows, times in ((data, hilbert_ann.PART), (asked, hilbert_ann.TURN)):
        assert max(r["count"] for r in rows.groupBy(*places).count().collect()) < 1.6 * times * size
    pairs = data.alias("a").join(asked.alias("b"), places).select("curve", F.col("a.node"), F.col("b.node").alias("query"))
    whole = [t.select("curve", "range", "node").distinct() for t in (data, asked)]
    expected = whole[0].alias("a").join(whole[1].alias("b"), ["curve", "range"])
    assert pairs.count() == pairs.distinct().count() == expected.count()
    got = collections.defaultdict(dict)
    for r in hilbert_ann.nearest(frame, "id % 60 = 0", k=5, range_size=size).collect():
        got[r.query_id][r.vec_id] = r.score
    assert set(got) == set(range(0, 1200, 60))
    best = {q: np.sort(np.delete(x @ x[q], q))[-5:] for q in got}
    hits = sum(np.allclose(sorted(got[q].values()), best[q], rtol=0, atol=1e-14) for q in got)
    assert hits >= 0.9 * len(got)


# --- packing ---------------------------------------------------------------


def test_encoder_is_the_tokenizer():
    e = packing.Encoder(queries.tokenizer_path())
    for text in [" a", "a ", "a  b", "\n", "", "\n\na", "a \nb", "é\tq b", "it's ok,", "<|endoftext|> a", "x\x1fy z", "日本 x²y ½ ok. it. 9."]:
        assert e.encode(text) == e.whole(text), text


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(queries.tokenizer_path()), packing.Encoder(queries.tokenizer_path())
    for text in ["one <|endoftext|> two", "<|endoftext|>", "a\n<|endoftext|>b", "a <|endoftext|><|endoftext|>.", "<|endoftext| >", "one two."]:
        assert array("I", e.encode(text)).tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert array("I", e.encode("one <|endoftext|> two")).tolist() == [505, 220, 50256, 734]


def test_packing(shipped):
    rows = [(i, "word " * int(n), "a") for i, n in enumerate(np.random.default_rng(2).integers(0, 3000, 300))] + edge_rows()
    got = packing.pack_documents(table(shipped, rows), queries.tokenizer_path(), block=64).collect()
    e, bins, pieces = packing.Encoder(queries.tokenizer_path()), collections.defaultdict(list), collections.Counter()
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    expected = collections.Counter()
    for i, text, _ in rows:
        ids = e.whole(text or "") + array("I", [0]).tobytes()
        n, start, k = len(ids) // 4, 0, 0
        size = n % 2048 or 2048
        while start < n:
            expected[(i, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))] += 1
            start, size, k = start + size, 2048, k + 1
    assert pieces == expected
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_blocks_of_one_repeated_id_are_bounded(shipped, monkeypatch):
    rows = [(None if i % 2 else 5, "word " * 700, "a") for i in range(600)] + [(100 + i, "word " * (i + 1), "a") for i in range(200)]
    sizes = []
    deal = packing.deal

    def dealt(*args):
        out = deal(*args)
        sizes.extend(r["count"] for r in out.groupBy("block").count().collect())
        return out

    monkeypatch.setattr(packing, "deal", dealt)
    got = packing.pack_documents(table(shipped, rows), queries.tokenizer_path(), block=64).collect()
    assert max(sizes) <= 2 * 64 and len(got) == 800
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert collections.Counter(r.doc_id for r in got if r.doc_id is None or r.doc_id == 5) == {None: 300, 5: 300}


def test_sequence_numbers_of_blocks_do_not_meet():
    n = (1 << 20) + 1
    same = {"piece": 0, "start": 0, "length": 2048, "ids_crc32": 0, "sequence_id": 0, "offset": 0, "fill": 0}
    rows = lambda n, block: pa.table({"doc_id": np.arange(n), **{c: np.full(n, v) for c, v in same.items()}, "block": np.full(n, block)})
    pack = packing._block(2048, True, 0)
    assert pack(rows(n, 0))["sequence_id"].to_numpy().max() < pack(rows(1, 1))["sequence_id"].to_numpy().min()


def test_packing_keeps_large_ids_beside_null(shipped):
    ids = [None, 2**53 + 1, 2**53 + 1, -(2**53) - 1, 2**63 - 1, None, *range(40)]
    for block in (4, 1 << 15):
        got = packing.pack_documents(table(shipped, [(i, "word " * 500, "a") for i in ids]), queries.tokenizer_path(), block=block).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(ids)


def test_local_search_never_worse():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(300, 1400, 600), rng.integers(600, 800, 600), rng.integers(1025, 2000, 200)):
        before = packing.best_fit(sizes, 2048)
        after = packing.local_search(sizes, before, 2048)
        assert np.bincount(after, sizes).max() <= 2048
        assert len(set(after.tolist())) <= len(set(before.tolist()))


# --- urls ------------------------------------------------------------------


def test_urls(shipped):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/fr/", "x", None, "", "http://org/fr/1#a", "http://corg/fr/", "http://a.net", "ftp://cheap-pills.example.com/a", "http://b.example.com/de/://"]
    pages = shipped.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (*url_filter.RULES, *url_filter.LISTED)
    got = [tuple(r) for r in url_filter.judge_urls(pages, url_filter.build_index(shipped, rules)).orderBy("page_id").collect()]
    assert [(r[3], r[4]) for r in got] == [
        ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"),
        ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("example.com/de/", "block"),
    ]
    assert got[0][1:3] == ("a.example.net", "/en/x")
    listed = shipped.createDataFrame([(r.host, r.path, r.verdict, r.base) for r in rules], "host string, path string, verdict string, base boolean")
    assert [tuple(r) for r in url_filter.judge_by_join(pages, listed).orderBy("page_id").collect()] == got


# --- quality ---------------------------------------------------------------


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    model = quality.Model(0.1, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    index, value = rng.integers(0, quality.SIZE, 9), rng.normal(size=9)
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j] for i in range(9) for j in range(i))
    assert model.margins(index, value, np.array([0, 9]))[0] == pytest.approx(0.1 + model.weights[index] @ value + pairs)


def test_quality_learns_and_never_sees_held_out(shipped):
    rows = [(i, " ".join(passage(30, i)) if i % 3 else "BUY!! " * 30, "a") for i in range(400)] + [(500, None, "a"), (None, "", "a")]
    labels = shipped.createDataFrame([(i, int(bool(i % 3))) for i in range(400)], "doc_id long, quality int")
    docs = table(shipped, rows)
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).select("row.doc_id", "score", quality.held_out(quality.F.col("row.doc_id")).alias("h")).collect()
    assert len(got) == 402
    assert all((r.score >= 0.7) == bool(r.doc_id % 3) for r in got if r.h and r.doc_id is not None and r.doc_id < 400)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end quality")
    assert np.array_equal(quality.train(docs, flipped).weights, model.weights)


def brute_features(text, meta):
    """Word weights by bucket and the bins of all statistics, one text at a time."""
    raw = text.encode()
    tokens = [t for t in re.split(rb"[\x20\x09-\x0D]+", raw) if t]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in t) for t in tokens]
    counts = collections.Counter(low)
    name = {t: int(words.word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][0]) for t in counts}
    norm = sum(counts.values()) ** 0.5
    weights = sorted(((name[t] >> 24) % quality.WORDS, n**0.5 / norm) for t, n in counts.items())
    size = lambda n: min(quality.BINS - 2, int(np.log2(n + 1.0)))
    share = lambda a, b: min(quality.BINS - 1, int((a / max(b, 1)) ** 0.5 * quality.BINS))
    n, top = len(tokens), max(counts.values(), default=0)
    again = sum(a == b for a, b in zip(low, low[1:]))
    letters = sum(b >= 128 or chr(b).isalpha() for b in raw)
    upper, digits = sum(65 <= b <= 90 for b in raw), sum(48 <= b <= 57 for b in raw)
    marks = sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)
    bins = [
        size(len(raw)), size(n), share(len(counts), n), share(top, n), share(again, n), share(upper, letters), share(digits, len(raw)),
        share(marks, len(raw)), share(raw.count(b"|"), n), share(raw.count(b"\n"), n), min(quality.BINS - 1, len(raw) // max(n, 1)),
        quality.BINS - 1 if meta is None else size(max(meta, 0)),
    ]
    return weights, [quality.WORDS + quality.BINS * k + b for k, b in enumerate(bins)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("aB c\n|1.!É\t"), max_size=60), st.one_of(st.none(), st.integers(0, 9000))), min_size=1, max_size=5))
def test_quality_features_like_brute_force(docs):
    raw = [t.encode() for t, _ in docs]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    meta = np.array([np.nan if m is None else m for _, m in docs], float)
    index, value, at = quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets, meta)
    for k, (text, m) in enumerate(docs):
        own, x = index[at[k] : at[k + 1]], value[at[k] : at[k + 1]]
        weights, bins = brute_features(text, m)
        is_word = own < quality.WORDS
        assert np.allclose(sorted(zip(own[is_word].tolist(), x[is_word].tolist())), weights) if weights else not is_word.any()
        assert own[~is_word].tolist() == bins and (x[~is_word] == 0.5).all()


# --- all together ----------------------------------------------------------


def test_empty_tables(shipped):
    docs = table(shipped, edge_rows()).limit(0)
    for result in (
        license_scan.scan_notices(docs), ngram_join.near_duplicates(docs), recompression.remove_repeats(docs),
        radix_dedup.exact_duplicates(docs), mixing.mix_to_targets(docs), packing.pack_documents(docs, queries.tokenizer_path()),
        quality.score_documents(docs, quality.train(docs, shipped.createDataFrame([], "doc_id long, quality int"))),
        hilbert_ann.nearest(shipped.createDataFrame([], "vec_id long, embedding array<float>"), "id % 20 = 0"),
        chat.digest_chats(chat.format_chats(shipped.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ):
        assert result.count() == 0


def test_pipeline_stages(shipped, sf_dir):
    docs = table(shipped, edge_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        after = stage(shipped, docs, sf_dir)
        assert after.columns == docs.columns
        kept = collections.Counter(r.doc_id for r in after.select("doc_id").collect())
        ids = [r[0] for r in by_id(edge_rows())]
        if name == "exact_dedup":
            assert kept == collections.Counter([*(set(range(1, 18)) - {1, 5, 6}), None])
        if name == "near_dedup":
            assert kept == collections.Counter(ids[i] for i, (_, c) in brute_components(edge_rows()).items() if i == c)


def test_pipeline_run_like_brute_force(shipped, tmp_path):
    """The whole run against one document at a time: kept texts, then every piece of every copy."""
    good = [(k, " ".join(passage(50 + k, 3000 + k)), "ab"[k % 2]) for k in range(60)]
    copies = [(100 + k, good[k][1] + " " * k, "a") for k in range(8)] + [(200 + k, good[k][1].replace(" ", "\n", 2) + " end", "b") for k in range(5)]
    junk = [(300 + k, "BUY!! | " * (20 + k), "a") for k in range(30)]
    rows = good + copies + junk + [(400, " ".join(passage(3000, 9)), "b"), (401, None, "a")]
    docs = table(shipped, rows).select("doc_id", "text", "lang", "source", "n_chars")
    labels = [(i, int(i < 300 or i >= 400)) for i, *_ in rows]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    written = len(common._WRITTEN)
    got = corpus_pipeline.run(shipped, str(tmp_path)).collect()
    assert len(common._WRITTEN) <= written + len(corpus_pipeline.STAGES)  # a stage's own tables are gone

    model = quality.train(docs, shipped.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {r.doc_id for r in quality.score_documents(docs, model).where("score >= 0.7").select("row.doc_id").collect()}
    assert not kept & set(range(300, 330)) and len(kept & set(range(60))) > 50
    left = [r for r in rows if r[0] in kept]
    groups = collections.defaultdict(list)
    for i, t, s in left:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    left = [r for r in left if r[0] in {min(g)[1] for g in groups.values()}]
    ids = [r[0] for r in by_id(left)]
    firsts = {ids[i] for i, (_, c) in brute_components(left).items() if i == c}
    left = [r for r in left if r[0] in firsts]
    mixed = {r.doc_id: r.copies for r in mixing.mix_to_targets(table(shipped, left)).collect()}
    e, expected = packing.Encoder(queries.tokenizer_path()), collections.Counter()
    for i, t, _ in left:
        n = len(e.whole(t or "")) // 4 + 1
        for k in range(-(-n // 2048)):
            expected[i, k] = mixed[i]
    assert collections.Counter((r.doc_id, r.piece) for r in got) == +expected


def test_pipeline_stages_with_clashing_columns(shipped, sf_dir, monkeypatch):
    """Columns that carry the stages' own names, alike in all rows, come through as they are."""
    rows = [(k, " ".join(passage(60, 2000 + k // 2 * (k < 20) + k * (k >= 20)))) for k in range(40)]
    names = "row_key long, key long, row string, copies int, copy int, component long, keep long, score double, place long"
    docs = shipped.createDataFrame([(i, t, "en", "s", len(t), 1, 2, "r", 3, 4, 5, 6, 0.5, 7) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    monkeypatch.setattr(corpus_pipeline, "KEEP_FROM", 0.0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.saved(stage(shipped, docs, sf_dir))
        assert after.columns == docs.columns
        got = {r.doc_id for r in after.collect()}
        assert got == (set(range(40)) if name in ("quality", "mixing") else set(range(40)) - set(range(1, 20, 2))), name
        assert after.select("row_key", "key", "row", "copies", "copy", "component", "keep", "score", "place").distinct().collect() == [(1, 2, "r", 3, 4, 5, 6, 0.5, 7)]
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(shipped, docs, sf_dir).collect()} == set(range(40))


def test_pipeline_keeps_rows_with_null_and_repeated_ids(shipped, sf_dir, monkeypatch):
    texts = [" ".join(passage(60, 1000 + k)) for k in range(40)]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k for k in range(40)]
    rows = [(i, t, "a") for i, t in zip(ids, texts, strict=True)] + [(None, texts[0], "a"), (7, texts[1], "a"), (None, texts[0] + " end", "a")]
    docs = table(shipped, rows).select("doc_id", "text", "lang", "source", "n_chars")
    monkeypatch.setattr(corpus_pipeline, "KEEP_FROM", 0.0)
    expected = {"quality": rows, "exact_dedup": rows[:40] + rows[42:], "near_dedup": rows[:40], "mixing": rows[:40]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(shipped, docs, sf_dir))
        got = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        want = collections.Counter((i, t) for i, t, _ in expected[name])
        if name == "near_dedup":  # of the three near copies of a text any may stay
            got = collections.Counter((i, t.removesuffix(" end")) for i, t in got.elements())
        if name == "mixing":
            got = collections.Counter((i, t.removesuffix(" end")) for i, t in got)
        assert got == want, name


def test_row_keys_are_unique_and_follow_ids(shipped):
    docs = table(shipped, edge_rows()).select("doc_id", "text", "source").repartition(5)
    keys = [sorted((r.row_key, r.doc_id, r.text) for r in common.with_row_key(d).collect()) for d in (docs, docs.repartition(3))]
    assert keys[0] == keys[1] and [k for k, *_ in keys[0]] == list(range(len(edge_rows())))
    ids = [i for _, i, _ in keys[0]]
    assert ids == sorted(ids[:-1]) + [None]
    clean = common.with_row_key(docs.where("doc_id > 1"))
    assert clean.where("row_key <> doc_id").isEmpty() and clean.count() == 16


def test_quality_learns_from_every_label_in_shards(shipped, monkeypatch):
    """One shard is the plain fit, many are the same in every run; the driver gets no document's features."""
    rows = [(i, ("buy now | " * (3 + i % 5) if i % 3 else f"a quiet sentence of prose number {i} ") * (1 + i % 4), "en", "s", i) for i in range(900)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = shipped.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int")
    fitted = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    raw = [r[1].encode() for r in fitted]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    index, value, at = quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets, np.array([r[4] for r in fitted], float))
    plain = quality.fit(index, value.astype(np.float32), at, np.array([float(r[0] % 3 == 0) for r in fitted]))
    model = quality.train(docs, labels)
    assert np.array_equal(model.weights, plain.weights) and np.array_equal(model.factors, plain.factors) and model.bias == plain.bias
    monkeypatch.setattr(training, "SHARD", 1 << 13)
    split, again = quality.train(docs, labels), quality.train(docs.repartition(3), labels)
    assert np.array_equal(split.factors, again.factors) and not np.array_equal(split.factors, model.factors)
    scores = quality.score_documents(docs, split).select("row.doc_id", "score").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in scores) >= 0.99 * len(scores)
