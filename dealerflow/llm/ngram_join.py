"""Near duplicates as a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when their sets of n-grams overlap by at least ``PERCENT`` of
their union. The bound limits how far sizes may differ, and by how many n-grams
two linked sets may differ (the size-derived bound). The columns of the matrix
(hashes of n-grams) are cut into so many blocks that two linked rows must agree
completely in some block, so only pairs of rows that agree in a block are ever
multiplied. Blocks that many documents fill alike and blocks of few n-grams are
left out as far as the bound allows it, so a passage shared by many documents
does not make pairs of them.

The product of a row with all its partners goes from one stretch of columns to
the next and adds up the overlaps. After each stretch the pairs are discarded
whose overlap can't reach the bound any more with all the n-grams still to come,
and only the others go on.

Equal sets are one row of the matrix. Of the rows that agree in a block each is
paired with the smallest only. What that does not decide - a row that does not
link to the smallest, against the others - is compared in blocks of rows by the
number of blocks that agree, which discards nearly all, and the rest multiplied in
a further round, unless both are in one component already. So no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import join_groups, numbered, saved, text_chunks
from dealerflow.llm.components import components
from dealerflow.llm.packed import GATHER, SCHEMA, Gatherer, bucket_of, buckets_for, packed_rows, unpack
from dealerflow.llm.radix_dedup import BITS, open_map
from dealerflow.llm.words import mix, sequence_hashes, word_hashes

#: Words of an n-gram; least overlap in percent of the union.
WORDS, PERCENT = 4, 85
#: Rows that meet one leading row in a task, at most about.
MEETING = 1024
#: Stretches of columns of a product, partners that are multiplied at once, and places that are broadcast at most.
STRETCHES, PARTNERS, FEW = 4, 64, 1 << 17
#: Common blocks that are listed, at most.
COMMON = 1 << 16
_U = np.uint64


def links(shared: int, left: int, right: int) -> bool:
    return 100 * shared >= PERCENT * (left + right - shared)


def most_apart(total: int) -> int:
    """N-grams that are in only one of two linked sets, at most, if the sets have ``total`` together."""
    return (100 - PERCENT) * total // (100 + PERCENT)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Upper ends of the size classes: linked sets are in one class or in neighbours."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, 100 * ends[-1] // PERCENT))
    return np.array(ends, np.int64)


def gram_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of every document, one after the other, and where each begins.

    A document of fewer words has its whole sequence as its only one, or none.
    """
    words, _, _, at = word_hashes(raw, offsets, lower=True)
    n = np.diff(at)
    grams = sequence_hashes(words, WORDS)
    first = np.arange(len(grams))
    doc = np.searchsorted(at, first, "right") - 1
    whole = first + WORDS <= at[doc + 1] if len(grams) else np.zeros(0, bool)
    short = [(i, sequence_hashes(words[at[i] : at[i + 1]], int(n[i]))[0] ^ _U(n[i])) for i in np.flatnonzero((n > 0) & (n < WORDS))]
    doc = np.concatenate([doc[whole], np.array([i for i, _ in short], np.int64)])
    grams = np.concatenate([grams[whole], np.array([h for _, h in short], np.uint64)])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def set_names(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each document's set."""
    mixed = mix(grams)
    return _sums(mixed, at), _sums(mix(mixed ^ _U(0x5851F42D4C957F2D)), at)


@dataclass(frozen=True)
class Common:
    """Blocks that many sets fill alike, sorted by name, with their counts. Bounded by ``COMMON``."""

    names: np.ndarray
    counts: np.ndarray

    def count(self, names: np.ndarray) -> np.ndarray:
        """How common each block is, 0 if it is not listed."""
        if not len(self.names):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.counts[at], 0)


NONE = Common(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def n_blocks(level: int) -> int:
    """Column blocks at a level of size classes: half as many again as two of its sets can differ in."""
    widest = most_apart(2 * int(classes()[level]))
    return widest + 2 + widest // 2


def blocks(grams: np.ndarray, mixed: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and sizes of all blocks of a set at a level."""
    parts = n_blocks(level)
    part = ((grams >> _U(32)) * _U(parts)) >> _U(32)
    at = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    names = mix(_sums(mixed, at) + mix((np.arange(parts, dtype=np.uint64) << _U(20)) + _U(level)))
    return names, np.diff(at)


def level_of(n: int) -> int:
    return int(np.searchsorted(classes(), n))


def keys_of(grams: np.ndarray, common: Common | None) -> np.ndarray:
    """Names of the column blocks by which a set is found, at its own level and the next.

    A level joins sets of its class and the one below. Linked sets differ in at
    most ``k`` n-grams, so of all ``p`` blocks at least ``p - k`` agree, and among
    the ``k + 1`` first blocks of each set, in any order that depends on a block's
    content alone, one is common. The order puts common blocks last and full
    blocks first. Without ``common`` the names of all blocks are returned.
    """
    n, found = len(grams), [np.zeros(0, np.uint64)]
    mixed, far = mix(grams), 100 * n // PERCENT
    for level in (level_of(n), level_of(n) + 1):
        keep = most_apart(n + min(int(classes()[level]), far)) + 1
        if keep > 1:  # else only equal sets link
            names, sizes = blocks(grams, mixed, level)
            found.append(names if common is None else names[np.lexsort((names, -sizes, common.count(names)))[:keep]])
    return np.concatenate(found)


def sketch(grams: np.ndarray) -> bytes:
    """A byte of each block's name and a byte of its size, at both levels."""
    if not len(grams):
        return b""
    mixed, level, parts = mix(grams), level_of(len(grams)), []
    for names, sizes in (blocks(grams, mixed, x) for x in (level, level + 1)):
        parts += [(names >> _U(56)).astype(np.uint8), np.minimum(sizes, 255).astype(np.uint8)]
    return b"".join(p.tobytes() for p in parts)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw, offsets in text_chunks(batches):
        grams, at = gram_sets(raw, offsets)
        high, low = set_names(grams, at)
        sketches = pa.array([sketch(grams[at[i] : at[i + 1]]) for i in range(part.num_rows)], pa.binary())
        arrays = [part.column(0), pa.array(np.diff(at)), *(pa.array(x.view(np.int64)) for x in (high, low)), sketches]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "high", "low", "sketch"])


def _stars(buckets: int):
    """Pairs of each document with the smallest that shares a block, by ranges of the document."""

    def run(part: pa.Table) -> pa.Table:
        keys, owners = unpack(part)
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        lead = owners[np.flatnonzero(new)][np.cumsum(new) - 1]
        b, a = owners[owners != lead], lead[owners != lead]
        return pa.Table.from_batches([_pairs_packed(a, b, buckets)])

    return run


def _pairs_packed(a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    both = np.unique(np.stack([b, a], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    spread = bucket_of(mix(both[:, 0].astype(np.uint64)), buckets)
    order = np.argsort(spread, kind="stable")
    both, spread = both[order], spread[order]
    at = np.searchsorted(spread, np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(at[1:] > at[:-1])
    cut = lambda c: pa.array([both[at[i] : at[i + 1], c].astype("<i8").tobytes() for i in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), cut(1), cut(0)], ["bucket", "a", "b"])


def _distinct(part: pa.Table) -> pa.Table:
    a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<i8") for c in ("a", "b"))
    both = np.unique(np.stack([a, b], axis=1), axis=0)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Id and n-grams of every set, copies in one task once."""
    seen = set()
    for part, raw, offsets in text_chunks(batches):
        ids = part.column(0).to_numpy()
        grams, at = gram_sets(raw, offsets)
        names = list(zip(*(x.tolist() for x in set_names(grams, at)), strict=True))
        for i in range(part.num_rows):
            if at[i + 1] > at[i] and names[i] not in seen:
                seen.add(names[i])
                yield ids[i], grams[at[i] : at[i + 1]]


def common_blocks(rows: DataFrame) -> Common:
    """The blocks that most sets fill alike, by counts over all documents.

    A task reports the blocks that at least one in 512 of its sets has; the sums
    of the ``COMMON`` most frequent come to the driver. They only order blocks:
    which of them are listed changes the work, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, sets = [], 0, 0

        def flush() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(parts), return_counts=True)
            often = counts >= max(3, sets // 512)
            return pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array(counts[often])], ["name", "n"])

        for _, grams in _sets_of(batches):
            parts.append(keys_of(grams, None))
            n, sets = n + len(parts[-1]), sets + 1
            if n >= GATHER:
                yield flush()
                parts, n, sets = [], 0, 0
        if parts:
            yield flush()

    found = rows.select("id", "text").mapInArrow(count, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    got = found.orderBy(F.desc("n"), "name").limit(COMMON).collect()
    names = np.array([r["name"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(names)
    return Common(names[order], np.array([r["n"] for r in got], np.int64)[order])


def candidate_stars(rows: DataFrame, buckets: int, common: Common = NONE) -> DataFrame:
    """Pairs (a, b): b shares a column block with a, the smallest id that has the block."""
    shared = rows.sparkSession.sparkContext.broadcast((common.names, common.counts))  # at most COMMON blocks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, listed = Gatherer(), Common(*shared.value)
        for one, grams in _sets_of(batches):
            keys = keys_of(grams, listed)
            if gathered.add(keys, np.full(len(keys), one)):
                yield packed_rows(*gathered.take(), buckets)
        if gathered.n:
            yield packed_rows(*gathered.take(), buckets)

    sent = rows.select("id", "text").mapInArrow(send, SCHEMA)
    stars = sent.groupBy("bucket").applyInArrow(_stars(buckets), "bucket bigint, a binary, b binary")
    return stars.groupBy("bucket").applyInArrow(_distinct, "a bigint, b bigint")


def overlaps(lead: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Which of ``rows`` link to ``lead``: their product with it, stretch by stretch of the columns.

    All are sorted distinct n-grams. A row leaves the product as soon as what it
    shares so far and all that either side has left can't make the least overlap.
    """
    sizes = np.array([len(r) for r in rows], np.int64)
    least = -(-PERCENT * (sizes + len(lead)) // (100 + PERCENT))
    alive = np.flatnonzero((sizes > 0) & (len(lead) > 0) & (np.minimum(sizes, len(lead)) >= least))
    shared = np.zeros(len(rows), np.int64)
    stretches = max(1, min(STRETCHES, len(lead) // 64))
    ends = [len(lead) * (k + 1) // stretches for k in range(stretches)]
    done = np.zeros(len(rows), np.int64)
    for k, end in enumerate(ends):
        first = ends[k - 1] if k else 0
        columns = lead[first:end]
        for i in alive:
            row = rows[i]
            # Up to the last column of the stretch; what lies between stretches has no column.
            upto = len(row) if end == len(lead) else int(np.searchsorted(row, columns[-1], "right"))
            part = row[done[i] : upto]
            spot = np.minimum(np.searchsorted(columns, part), len(columns) - 1)
            shared[i] += np.count_nonzero(columns[spot] == part)
            done[i] = upto
        alive = alive[shared[alive] + np.minimum(len(lead) - end, sizes[alive] - done[alive]) >= least[alive]]
    out = np.zeros(len(rows), bool)
    out[alive] = True
    return out


def linked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by the product of their rows.

    Each ``a`` leads a meeting: its text comes first, then the texts of its
    partners. A leader of many is sent to several meetings. Only texts that have a
    place are shuffled: few places are broadcast, else the texts are sifted by a
    map of fixed size before they meet their places.
    """
    meetings = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEETING).alias("meetings"))
    guests = pairs.join(meetings, "a").select(
        F.col("b").alias("id"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), "meetings").alias("meeting"), F.lit(True).alias("guest")
    )
    leads = meetings.select(
        F.col("a").alias("id"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("meetings") - 1)).alias("meeting"),
        F.lit(False).alias("guest"),
    )
    places = saved(guests.unionByName(leads))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, np.zeros(0, np.uint64)
        waiting: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            own = overlaps(lead, [row for _, row in waiting])
            found = [who for (who, _), links_ in zip(waiting, own, strict=True) if links_]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

        for part, raw, offsets in text_chunks(batches):
            grams, at = gram_sets(raw, offsets)
            for i, (first, meeting, guest, who) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True)):
                row = grams[at[i] : at[i + 1]]
                if not guest:
                    if waiting:
                        yield flush()
                    now, lead = (first, meeting), row.copy()
                elif now == (first, meeting):
                    waiting.append((who, row.copy()))
                    if len(waiting) == PARTNERS:
                        yield flush()
        if waiting:
            yield flush()

    texts = rows.select("id", "text")
    if places.count() <= FEW:
        met = texts.join(F.broadcast(places), "id")
    else:
        met = sifted(texts, places).join(places, "id")
    met = met.select("lead", "meeting", "guest", "id", "text").repartition("lead", "meeting")
    return met.sortWithinPartitions("lead", "meeting", "guest").mapInArrow(multiply, "a bigint, b bigint")


def sifted(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The rows whose id may be among those of ``places``: all that are, and others as far as the map is full."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    shared = texts.sparkSession.sparkContext.broadcast(open_map(places.select(slot("id").alias("slot"))))  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], ["id", "text"])

    return texts.select(slot("id").alias("slot"), "id", "text").mapInArrow(run, "id bigint, text string")


def _may_link(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a visitor and another row, of different components, whose sizes and blocks allow a link.

    Blocks of different size differ in at least as many n-grams as their sizes,
    other unequal blocks in at least two.
    """
    group = group.drop_duplicates("id", ignore_index=True)
    n, inside, visits = group["n"].to_numpy(), group["component"].to_numpy(), group["visits"].to_numpy()
    level = np.searchsorted(classes(), n)
    found = [np.zeros((0, 2), np.int64)]
    for top in np.unique(level):
        # The larger set of a pair is at its own level, the other there or one below.
        parts, below = n_blocks(int(top)), np.flatnonzero((level == top) | (level == top - 1))
        skip = np.where(level[below] == top, 0, 2 * n_blocks(int(top) - 1) if top else 0)
        table = np.stack([np.frombuffer(group["sketch"][k], np.uint8)[s : s + 2 * parts] for k, s in zip(below, skip, strict=True)])
        names, sizes = table[:, :parts], table[:, parts:].astype(np.int16)
        for row in np.flatnonzero(level[below] == top):
            k = below[row]
            total = n[below] + n[k]
            fits = (visits[below] | visits[k]) & (inside[below] != inside[k]) & (PERCENT * np.maximum(n[below], n[k]) <= 100 * np.minimum(n[below], n[k]))
            rows = np.flatnonzero(fits & ((level[below] < top) | (below < k)))
            apart = np.abs(sizes[rows] - sizes[row])
            apart[(apart == 0) & (names[rows] != names[row])] = 2
            apart[(apart == 2) & (sizes[row] == 255)] = 1  # sizes that large are not told apart
            rows = rows[apart.sum(axis=1) <= most_apart(total[rows])]
            found.append(np.stack([np.full(len(rows), k), below[rows]], axis=1))
    pairs = np.concatenate(found)
    ids = group["id"].to_numpy()
    return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})


def undecided(broken: DataFrame, stars: DataFrame, sets: DataFrame, where: DataFrame) -> DataFrame:
    """Pairs around the leaders of ``broken`` pairs that may link and are not in one component.

    Who shares a block with a leader is dealt into blocks of rows. Only who is
    not in the leader's component visits all blocks around it, the others stay in
    their own: among themselves they are joined already. A task compares its
    residents and visitors by the sets' sketches.
    """
    leaders = broken.select("a").distinct()
    size = stars.join(leaders, "a").groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEETING).alias("size"))
    in_of = lambda c: where.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}"))
    row = stars.join(size, "a").select("a", F.col("b").alias("id"), "size", F.pmod(F.xxhash64("b"), "size").alias("i"))
    row = row.join(in_of("a"), "a", "left").join(in_of("id"), "id", "left")
    row = row.withColumns({"lead": F.coalesce("in_a", "a"), "component": F.coalesce("in_id", "id")})
    every = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)
    places = F.when(F.col("component") == F.col("lead"), F.array("i")).otherwise(every)
    row = row.withColumn("j", F.explode(places)).withColumn("visits", F.col("component") != F.col("lead"))
    row = row.select("a", "id", "j", "component", "visits").join(sets.select("id", "n", "sketch"), "id")
    return row.groupBy("a", "j").applyInPandas(_may_link, "a bigint, b bigint").distinct()


def _apart(pairs: DataFrame, where: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component, with the components."""
    a, b = (where.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}")) for c in "ab")
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    out = out.withColumns({f"in_{c}": F.coalesce(f"in_{c}", c) for c in "ab"})
    return out.where("in_a <> in_b")


def components_of(rows: DataFrame) -> DataFrame:
    """``key``, ``n_shingles``, ``component`` (smallest key reachable by links) of rows (key, text) with keys of their own."""
    rows = rows.select(F.col("key").alias("id"), "text")
    facts = saved(rows.mapInArrow(_facts, "id bigint, n bigint, high bigint, low bigint, sketch binary"))
    # Equal sets: the smallest id stands for all.
    named = facts.select("id", F.col("n").alias("size"), "high", "low")
    first = named.groupBy("size", "high", "low").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    named = join_groups(named, first, ["size", "high", "low"], facts.count())
    rep = F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("id"))
    member = saved(named.select("id", F.col("size").alias("n"), rep.alias("rep")))
    rep = member.where("id <> rep").select("id", "rep")

    def by_rep(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            other = rep.select(F.col("id").alias(c), F.col("rep").alias("r"))
            pairs = pairs.join(other, c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
        return pairs.where("a <> b").select("a", "b").distinct()

    stars = saved(by_rep(candidate_stars(rows, buckets_for(rows, "text", 1 / 20), common_blocks(rows))))
    # First each document with its smallest partner, then what is still apart.
    near = saved(linked(rows, stars.groupBy("b").agg(F.min("a").alias("a"))))
    where = components(near)
    rest = saved(_apart(stars, where).select("a", "b"))
    if not rest.isEmpty():
        near = saved(near.unionByName(linked(rows, rest)))
        where = components(near)
        # A document apart from the smallest of a block may link to others in it.
        broken = saved(_apart(rest, where).select("a", "b"))
        others = saved(undecided(broken, stars, facts, where))
        if not others.isEmpty():
            where = components(near.unionByName(linked(rows, others)))
    labels = where.select(F.col("id").alias("rep"), "component")
    out = member.join(labels, "rep", "left")
    return out.select(F.col("id").alias("key"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (size of its set), ``component_id`` (smallest id reachable by links).

    A-Z count as a-z, words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts and
    texts without words have no shingle and link with nothing. Rows with a null or
    a repeated id are rows like any other; the smallest id of a component is null
    only if all its ids are. Other columns are not read. N-grams are compared by
    64-bit hashes, whole sets by 128 bits.
    """
    known = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = components_of(known.rows.select("key", "text")).withColumnsRenamed({"key": "_key", "component": "_component"})
    found = known.with_id(known.with_id(found, "_key", id_col), "_component", "component_id")
    return found.select(id_col, "n_shingles", "component_id")
