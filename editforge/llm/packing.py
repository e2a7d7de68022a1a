"""Operator 6: best-two-fit packing of documents into sequences.

A sequence is filled greedily with the longest piece that still fits. Then
its smallest piece is taken out when two unpacked pieces fill the widened gap
more tightly; the smallest goes back among the unpacked.

Documents are tokenized once where they lie; what is shuffled is one narrow
row a piece. Pieces are dealt at random into groups of about
``group_rows``, each packed by one task; the loss against one global packing
is less than one sequence a group.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.llm.bpe import (Pieces, Vocabulary, default_tokenizer, encode_texts, tokenizer_bytes,
                               worker_store)
from editforge.llm.common import text_column
from editforge.session import materialize

MAX_TOKENS = 1024
END_OF_TEXT = 2
GROUP_ROWS = 8192
PIECES = "piece int, start long, length long, ids_crc32 long"


def fast_merges(raw: bytes) -> tuple[Pieces, dict]:
    """The worker's pieces with the same merges applied by a compiled library.

    The file's ids are in merge order, so they serve as its ranks.
    """
    store, name = worker_store(), "fast-" + hashlib.md5(raw).hexdigest()
    if name not in store:
        import tiktoken
        v = Vocabulary(raw)
        ranks = {s: i for i, s in v.strings.items() if i not in v.added.values()}
        core = tiktoken.Encoding("packing", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        store[name] = Pieces(lambda pieces: [core.encode_single_piece(x.encode()) for x in pieces]), v.added
    return store[name]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first have ``most``."""
    first = n - (-(-n // most) - 1) * most
    return [(0, first), *((s, most) for s in range(first, n, most))] if n else []


def pack_lengths(lengths, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-two-fit: (bin, offset) of each length, all between 1 and ``most``."""
    pool: list[list[int]] = [[] for _ in range(most + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        pool[lengths[i]].append(i)
    present = mirrored = 0  # bit n, and bit most - n: an unpacked piece of n tokens is there
    for n in range(1, most + 1):
        if pool[n]:
            present |= 1 << n
            mirrored |= 1 << (most - n)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n):
        nonlocal present, mirrored
        i = pool[n].pop()
        if not pool[n]:
            present &= ~(1 << n)
            mirrored &= ~(1 << (most - n))
        return i

    def give_back(n, i):
        nonlocal present, mirrored
        pool[n].append(i)
        present |= 1 << n
        mirrored |= 1 << (most - n)

    number = 0
    while present:
        held, gap = [], most
        while gap and (fits := present & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        while gap and present and len(held) > 1:
            small, i = held[-1]  # greedy filling leaves the smallest last
            pair = None
            for total in range(small + gap, small, -1):
                both = present & (mirrored >> (most - total)) & ((1 << total) - 2)
                if both & 1 << (total // 2) and total % 2 == 0 and len(pool[total // 2]) < 2:
                    both &= ~(1 << (total // 2))
                if both:
                    b = both.bit_length() - 1
                    pair = (b, total - b)
                    break
            if pair is None:
                break
            held.pop()
            held += [(pair[0], take(pair[0])), (pair[1], take(pair[1]))]
            give_back(small, i)
            gap -= sum(pair) - small
            held.sort(key=lambda x: -x[0])
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(df: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end: int = END_OF_TEXT,
         group_rows: int = GROUP_ROWS, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids, when asked for).

    A document is its token ids and the id ``end``; only documents of more
    than ``max_tokens`` are cut, and only their first piece may be shorter.
    Null and empty texts are the end id alone. Rows that repeat are packed
    each; a null key stays null; other columns are left out; an empty table
    gives an empty result.
    """
    spark = df.sparkSession
    raw = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer or default_tokenizer()))
    kind = df.schema[key].dataType.simpleString()
    extra = ", ids array<int>" if keep_ids else ""
    last = np.array([end], np.int32)

    def run(batches):
        pieces, added = fast_merges(raw.value)
        for batch in batches:
            row, number, starts, lengths, sums, kept = [], [], [], [], [], []
            for r, ids in enumerate(encode_texts(text_column(batch, text).to_pylist(), pieces, added)):
                ids = np.concatenate([ids, last])
                for p, (s, n) in enumerate(cut(len(ids), max_tokens)):
                    row.append(r), number.append(p), starts.append(s), lengths.append(n)
                    sums.append(zlib.crc32(ids[s: s + n].astype("<u4").tobytes()))
                    if keep_ids:
                        kept.append(ids[s: s + n])
            columns = [batch.column(key).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()),
                       pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    pieces = materialize(df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {PIECES}{extra}"), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "piece"], kind="stable", ignore_index=True)
        bins, offsets = pack_lengths(rows["length"].tolist(), max_tokens)
        return rows.assign(sequence_id=(rows["_group"].to_numpy(np.int64) << 32) + bins, offset=offsets).drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(place, f"`{key}` {kind}, {PIECES}{extra}, sequence_id long, offset long")


def op6_best_two_fit(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return pack(documents).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
