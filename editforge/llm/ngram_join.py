"""Operator 4: documents that share most of their word n-grams, by T-occurrence search.

Two sets of a and b shingles have Jaccard similarity of at least num/den
exactly when they share T(a, b) = ceil(num * (a + b) / (num + den)) of them.
A document's shingles have one order for all documents, rare ones first, in
which the last T - 1 inverted lists are the long ones that DivideSkip sets
aside: a partner must stand in one of the other, short lists. These are the
inverted index that is shuffled.

Each list first links neighbours only, which joins groups of near copies
without their pairs; then the pairs of a list whose documents lie in different
groups are tried, so no link that matters is left out. Pairs are tried by
DivideSkip on whole sets: the shorter lists are merged by a heap, the longer
ones probed by binary search for what the merge leaves possible.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.llm.common import chunks, components, mix64, shingles, text_column, tidy, words
from editforge.session import materialize

#: Defaults for near-duplicates: five words, similarity 0.8.
N_WORDS, NUM, DEN = 5, 8, 10
#: Cells of the table of frequent shingles: a fixed size, whatever the input.
CELLS = 1 << 22
#: Bins of a set's two histograms, whose distances bound the symmetric difference from below.
BINS, FINE_BINS = 64, 512
#: Pairs (of two ids) that are sent to every executor; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of one list that a task is meant to hold; lists that look longer are dealt over several.
LIST_ROWS = 100_000
#: Members of a list that share a head in the first round, and rows on a side of a block of pairs in the second.
BLOCK, PAIR_ROWS = 64, 2048


def least_overlap(a, b, num: int, den: int):
    """Shared shingles that sets of a and b need (numbers or arrays)."""
    return -(-num * (a + b) // (num + den))


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles; of fewer words the whole is one; no word: none."""
    if 0 < len(h) < n:
        return shingles(h, len(h)) ^ np.uint64(len(h))
    return np.unique(shingles(h, n))


def _sets(batches, text: str, n: int):
    """(batch, row, shingle set) for every row."""
    for batch in batches:
        for at, count, data, offsets in chunks(text_column(batch, text)):
            h, first, _, _ = words(data, offsets)
            for r in range(count):
                yield batch, at + r, shingle_set(h[first[r]: first[r + 1]], n)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def _histogram(s: np.ndarray, bins: int) -> bytes:
    """Shingles by the low bits of their hash, at most 255 a bin: clipping only lowers a distance."""
    return np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _frequent(text: str, n: int):
    """Cells of shingles that a task meets far more often than cells are met on average, with their counts."""
    def run(batches):
        total = np.zeros(CELLS, np.int32)
        for _, _, s in _sets(batches, text, n):
            np.add.at(total, _cell(s), np.int32(1))
        mean = total.mean()
        cell = np.flatnonzero(total > mean + 4 * mean ** 0.5 + 3)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], names=["cell", "count"])
    return run


def _describe(key: str, text: str, n: int, num: int, den: int, sent):
    """Per row: set size, 128-bit digest of the set, histogram, and the short lists' shingles with the parts their lists are dealt over.

    ``sent``: for each cell the bit length of how often its shingles were counted. Any
    order of shingles gives right results; this one puts frequent ones last.
    """
    def run(batches):
        level = sent.value
        out, size = [], 0

        def block():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))],
                names=["id", "n", "sig1", "sig2", "bins", "fine", "marks", "parts"])

        for batch, row, s in _sets(batches, text, n):
            a = len(s)
            least = -(-num * a // den)
            rank = level[_cell(s)]
            order = np.lexsort((s, rank))[: a - least + 1]
            parts = np.maximum((np.int64(1) << rank[order].astype(np.int64)) // (2 * LIST_ROWS), 1)
            out.append((batch.column(key)[row].as_py(), a, int(mix64(s).sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5BD1E995))).astype(np.int64)) if a else 0,
                        _histogram(s, BINS), _histogram(s, FINE_BINS),
                        s[order].view(np.int64), parts.astype(np.int32)))
            size += len(order)
            if size > 100_000:
                yield block()
                out, size = [], 0
        if out:
            yield block()
    return run


LISTS = "mark long, part int, id long, n long, prev long, prev_n long, head long, head_n long, lead boolean"


def _lists(batches):
    """Rows come sorted by mark, part, n, id. Lists of one document go (unless dealt over parts); the others get their neighbour and head."""
    held = None  # last row of the batch before, not sent yet: it may be alone
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held[0], t])
        out, held = _neighbours(t, held[1:] if held else None)
        if out is not None:
            yield out
    if held is not None and (held[1] is not None or held[0]["parts"][0].as_py() > 1):
        out, _ = _neighbours(held[0], held[1:], last=True)
        if out is not None:
            yield out


def _neighbours(t, before, last: bool = False):
    mark, part, ids, n, parts = (np.asarray(t[c]) for c in ("mark", "part", "id", "n", "parts"))
    size = len(mark)
    new = np.ones(size, bool)
    new[1:] = (mark[1:] != mark[:-1]) | (part[1:] != part[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    place = np.arange(size) - start
    # The list that the first row goes on with: previous row, head, rows so far.
    prev, prev_n = np.roll(ids, 1), np.roll(n, 1)
    head_at = start + place // BLOCK * BLOCK
    head, head_n = ids[head_at], n[head_at]
    lead = new.copy()
    if before is not None and before[0] is not None:
        p, pn, h, hn, k = before[0]
        own = start == 0
        place = np.where(own, place + k, place)
        head_at = np.where(own, np.arange(size) - place % BLOCK, head_at)
        inside = head_at >= 0
        at = np.maximum(head_at, 0)
        head, head_n = np.where(inside, ids[at], h), np.where(inside, n[at], hn)
        prev[0], prev_n[0], lead[0], new[0] = p, pn, False, False
    alone = new.copy()
    alone[:-1] &= new[1:]
    keep = ~alone | (parts > 1)
    if not last:
        keep[-1] = False
    prev, prev_n = np.where(new, ids, prev), np.where(new, n, prev_n)
    out = pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (mark, part, ids, n, prev, prev_n, head, head_n, lead)],
                                     names=["mark", "part", "id", "n", "prev", "prev_n", "head", "head_n", "lead"]) if keep.any() else None
    going = None if new[-1] else (prev[-1], prev_n[-1], head[-1], head_n[-1], int(place[-1]))
    return out, (t.slice(size - 1, 1), going)


def _bounded(num: int, den: int):
    """Pairs whose histograms leave the similarity possible."""
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, FINE_BINS).astype(np.int16) for c in ("fine_a", "fine_b"))
            na, nb = np.asarray(b.column("na")), np.asarray(b.column("nb"))
            keep = np.abs(x - y).sum(axis=1) <= na + nb - 2 * least_overlap(na, nb, num, den)
            yield b.select(["a", "b"]).filter(pa.array(keep))
    return run


def divide_skip(query: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Numbers of the sets that share enough of the query's shingles.

    T: overlap that the least demanding set needs. The T/(mu log M + 1)
    longest lists are set aside; sets that reach T less their number in
    a heap merge of the others are looked up in them by binary search.
    """
    sizes = np.array([len(s) for s in sets])
    need = least_overlap(len(query), sizes, num, den)
    least = int(need.min())
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = np.searchsorted(query, every)
    hit = (place < len(query)) & (query[np.minimum(place, len(query) - 1)] == every)
    order = np.lexsort((owner[hit], place[hit]))
    where, docs = place[hit][order], owner[hit][order]
    ends = np.searchsorted(where, np.arange(len(query) + 1))
    lengths = np.diff(ends)
    by_length = np.argsort(lengths, kind="stable")
    longest = max(2, int(lengths.max(initial=2)))
    n_long = min(least - 1, int(least / (0.0085 * np.log2(longest) + 1)))
    short, long = by_length[: len(query) - n_long], by_length[len(query) - n_long:]
    merged = heapq.merge(*(docs[ends[i]: ends[i + 1]].tolist() for i in short.tolist() if lengths[i]))
    found = [(d, c) for d, g in groupby(merged) if (c := sum(1 for _ in g)) >= need[d] - n_long]
    if not found:
        return []
    at, count = np.array([d for d, _ in found]), np.array([c for _, c in found])
    keys = where * len(sets) + docs  # sorted: each list is sorted by set
    probes = (long[:, None] * len(sets) + at[None, :]).ravel()
    spot = np.searchsorted(keys, probes)
    seen = (spot < len(keys)) & (keys[np.minimum(spot, len(keys) - 1)] == probes) if len(keys) else np.zeros(len(probes), bool)
    count = count + seen.reshape(len(long), len(at)).sum(axis=0)
    return at[count >= need[at]].tolist()


def _try(n: int, num: int, den: int):
    """Rows of one query document and its possible partners: the partners that are similar enough."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id")
        sets = []
        for t in rows["text"]:
            data = np.frombuffer((t or "").encode(), np.uint8)
            sets.append(shingle_set(words(data, np.array([0, len(data)]))[0], n))
        own = (rows["id"] == rows["a"]).to_numpy()
        ids = rows["id"].to_numpy()[~own]
        partners = [s for s, o in zip(sets, own) if not o]
        if not own.any() or not partners:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        hits = divide_skip(sets[int(np.flatnonzero(own)[0])], partners, num, den)
        return pd.DataFrame({"a": np.full(len(hits), rows["a"].iloc[0], np.int64), "b": ids[hits].astype(np.int64)})
    return run


def _across(num: int, den: int):
    """Rows come sorted by root and block: first the histograms of the block's documents (mark null), then its
    lists. Pairs of a list, across the block's two sides (or within the one), whose documents lie in different
    groups and whose sizes and histograms leave the similarity possible; each once a block."""
    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key = [np.asarray(t[c]) for c in ("root", "x", "y")]
            new = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))).tolist()
            for a, z in zip(new, new[1:]):
                yield from _block_pairs(t.slice(a, z - a), num, den)
            held = t.slice(new[-1]).to_batches()[0]
        if held is not None:
            yield from _block_pairs(pa.Table.from_batches([held]), num, den)

    return run


def _block_pairs(t, num: int, den: int):
    """All pairs of the lists of one block, one distance between rows after the other for all lists at once."""
    known = pc.is_null(t["mark"])
    head, t = t.filter(known), t.filter(pc.invert(known))
    size = t.num_rows
    if size < 2:
        return
    order = np.argsort(np.asarray(head["id"]))
    every = np.asarray(head["id"])[order]
    bins = np.frombuffer(b"".join(head["bins"].to_pylist()), np.uint8).reshape(-1, BINS)[order]
    ids, n, comp, side, mark = (np.asarray(t[c]) for c in ("id", "n", "comp", "side", "mark"))
    doc = np.searchsorted(every, ids)
    one = t["x"][0].as_py() == t["y"][0].as_py()
    starts = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
    stop = np.append(starts[1:], size)
    end = np.repeat(stop, stop - starts)  # of the row's list
    rows, apart, parts, held = np.arange(size), 1, [], 0
    while True:
        rows = rows[rows + apart < end[rows]]
        if not len(rows):
            break
        j = rows + apart
        keep = (comp[rows] != comp[j]) & (one | (side[rows] != side[j])) & (np.minimum(n[rows], n[j]) * den >= np.maximum(n[rows], n[j]) * num)
        i, j = doc[rows[keep]], doc[j[keep]]
        parts.append(np.minimum(i, j) * len(every) + np.maximum(i, j))
        held, apart = held + len(i), apart + 1
        if held > 1 << 23:  # the lists of a family repeat its pairs
            parts = [np.unique(np.concatenate(parts))]
            held = len(parts[0]) // 2
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    size_of = np.zeros(len(every), np.int64)
    size_of[doc] = n
    for a in range(0, len(found), 1 << 17):
        i, j = found[a: a + (1 << 17)] // len(every), found[a: a + (1 << 17)] % len(every)
        apart = np.abs(bins[i].astype(np.int16) - bins[j]).sum(axis=1)
        keep = apart <= size_of[i] + size_of[j] - 2 * least_overlap(size_of[i], size_of[j], num, den)
        yield pa.RecordBatch.from_arrays([pa.array(every[i[keep]]), pa.array(every[j[keep]])], names=["a", "b"])


def similar_documents(documents: DataFrame, n_words: int = N_WORDS, num: int = NUM, den: int = DEN, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """One row per row of ``documents``: key, n_shingles, component_id.

    Words are runs of other than ASCII white space, A-Z lower-cased. Two
    documents link when den * shared >= num * union of their distinct
    n-word shingles; component_id is the least key that links reach. Documents
    without words (null, empty, blank) have no shingle and no link. Rows with
    a null key get null as their component_id and link with nothing; rows
    that repeat count one by one; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cells = (rows.select("text").mapInArrow(tidy(_frequent("text", n_words)), "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count"))
             .select("cell", F.ceil(F.log2(F.col("count") + 1)).cast("tinyint").alias("level")).toArrow())  # CELLS rows at most
    level = np.zeros(CELLS, np.uint8)
    level[np.asarray(cells["cell"])] = np.asarray(cells["level"])
    sent = spark.sparkContext.broadcast(level)
    meta = materialize(rows.mapInArrow(tidy(_describe("id", "text", n_words, num, den, sent)),
                                       "id long, n long, sig1 long, sig2 long, bins binary, fine binary, marks array<long>, parts array<int>"), "sets")
    same = ["n", "sig1", "sig2"]
    live = meta.where("n > 0 and id is not null")
    # Equal sets are one class, whose least id stands for it.
    classes = materialize(live.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    reps = live.join(classes.withColumnRenamed("rep", "id"), [*same, "id"], "left_semi").dropDuplicates(["id"])
    index = (reps.select("id", "n", F.explode(F.arrays_zip("marks", "parts")).alias("m"))
             .select(F.col("m.marks").alias("mark"), F.pmod(F.xxhash64("id"), F.col("m.parts")).cast("int").alias("part"), F.col("m.parts").alias("parts"), "id", "n"))
    lists = materialize(index.repartition(n_parts, "mark", "part").sortWithinPartitions("mark", "part", "n", "id").mapInArrow(_lists, LISTS), "lists")
    fits = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num
    # First round: neighbours, block heads, and the first rows of the parts of a list.
    near = (lists.where((F.col("prev") != F.col("id")) & fits(F.col("n"), F.col("prev_n"))).select("id", F.col("prev").alias("x"))
            .union(lists.where((F.col("head") != F.col("id")) & fits(F.col("n"), F.col("head_n"))).select("id", F.col("head").alias("x"))))
    leads = lists.where("lead").groupBy("mark").agg(F.min_by("id", F.struct("n", "id")).alias("x"), F.count("*").alias("k")).where("k > 1")
    near = near.union(lists.where("lead").join(leads, "mark").where("x <> id").select("id", "x"))
    near = near.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    bins = materialize(reps.select("id", "n", "bins", "fine"), "bins")
    texts = rows.where("id is not null")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        left = bins.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fine_a"))
        right = bins.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fine_b"))
        possible = materialize(pairs.join(left, "a").join(right, "b").where(fits(F.col("na"), F.col("nb"))).mapInArrow(_bounded(num, den), "a long, b long"), name)
        wanted = possible.select("a", F.col("b").alias("id")).union(possible.select("a", F.col("a").alias("id")).distinct())
        # Few pairs find their texts where these lie; more pairs meet them in a shuffle by document.
        few = possible.count() <= BROADCAST_ROWS
        return materialize(texts.join(F.broadcast(wanted) if few else wanted, "id").groupBy("a").applyInPandas(_try(n_words, num, den), "a long, b long"), name + "-links")

    first = links(near, "near")
    groups = components(first)
    # Second round: lists that still hold more than one group, and only pairs across groups.
    grouped = lists.select("mark", "id", "n").join(groups, "id", "left").select("mark", "id", "n", F.coalesce("component_id", "id").alias("comp"))
    mixed = grouped.groupBy("mark").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("mark")
    lists2 = materialize(grouped.join(mixed, "mark", "left_semi"), "mixed")
    # Rows of a list are cut into blocks; every two blocks meet once. Lists of one family of copies mostly hold
    # its least document: by that root they come together, so that a pair is looked at once and not once a list.
    blocks = lists2.groupBy("mark").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("k"), F.min("id").alias("root"))
    dealt = (lists2.join(blocks, "mark").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "mark",
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "comp", F.lit(None).cast("binary").alias("bins")))
    shapes = dealt.select("root", "x", "y", "id").distinct().join(bins.select("id", "bins"), "id").select(
        "root", "x", "y", F.lit(None).cast("long").alias("mark"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("comp"), "bins")
    across = (dealt.union(shapes).repartition(n_parts, "root", "x", "y").sortWithinPartitions("root", "x", "y", F.asc_nulls_first("mark"), "side", "id")
              .mapInArrow(_across(num, den), "a long, b long").distinct().join(near, ["a", "b"], "left_anti"))
    second = links(across, "across")
    final = components(first.union(second)) if second.take(1) else groups
    return (meta.join(classes, same, "left").join(final.withColumnRenamed("id", "rep"), "rep", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "id").alias("component_id")))


def op4_t_occurrence(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return similar_documents(documents, n_words=3, num=9, den=10)
