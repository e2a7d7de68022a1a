"""Operator 13: alignment of two tokenizers over the bytes of the same texts.

Every document has two lists of token ends. One numpy vector holds a pair of
pointers for each of many documents and moves all of them together: a step
links the two tokens it stands on, moves the side whose token ends first, and
cuts where both end. Documents that are through leave the vector. A long
document begins several times, at places where both lists are seen to have an
end, so the number of steps is bounded by a lane and not by the longest text.

Links between tokens of one group are counted as (id, id) pairs a document, and
the pairs' document counts are joined back: the heaviest pairs, of which only
so many can be, travel to every task; the others are joined by a shuffle
in which no pair is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.llm.bpe import Vocabulary, default_tokenizer, encode_texts, tokenizer_bytes, worker_store
from editforge.llm.common import text_column
from editforge.llm.packing import fast_merges
from editforge.session import materialize

#: Tokens of the first side after which a document begins another lane at the next common end.
LANE = 256
#: Characters of text that go through the lanes at once (one text is never cut).
CHUNK_CHARS = 1 << 18
#: At most this many pairs hold 1 / HEAVY or more of all rows of the pair counts each; these are broadcast (24 bytes each).
HEAVY = 1 << 17
#: A group of up to this many pairs is written out at once; of larger ones only different ids are paired.
SMALL_GROUP = 4096


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A vocabulary: the bytes and decimal spelling of each id, as Arrow arrays to take from."""

    def __init__(self, strings: list[bytes]):
        self.strings = pa.array(strings, pa.large_binary())
        self.size = np.array(list(map(len, strings)), np.int64)
        self.count = len(strings)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return joined(self.strings, ids)


def joined(table: pa.Array, at: np.ndarray) -> np.ndarray:
    """The bytes of the table's entries, one after the other."""
    raw = table.take(pa.array(at)).buffers()[2] if len(at) else None
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


class Tokenizers:
    """Both tokenizers of a worker. A: byte-level merges of a file. B: pieces with byte fallback, which puts a space before a text."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        import sentencepiece
        self.pieces, _ = fast_merges(raw_a)
        strings = Vocabulary(raw_a).strings
        self.a = Side([strings.get(i, b"") for i in range(max(strings) + 1)])
        self.b_model = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        self.b = Side([self._piece(i) for i in range(self.b_model.get_piece_size())])
        decimal = [str(i).encode() for i in range(max(self.a.count, self.b.count))]
        #: Decimal spellings followed by each of the four characters that end an id in a digest's text.
        self.spelled = pa.array([d + end for end in (b",", b"|", b";", b"") for d in decimal], pa.large_binary())
        self.decimals = len(decimal)

    def _piece(self, i: int) -> bytes:
        piece = self.b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b_model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]):
        """Flat ids and offsets of either side; a text that either side does not give back has no tokens."""
        asked = [" " + t if t else "" for t in texts]
        ids = list(encode_texts(asked, self.pieces, {}))
        a, at_a = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64), np.cumsum([0, *map(len, ids)])
        ids = [i if t else [] for i, t in zip(self.b_model.encode(texts, num_threads=1), texts)]
        b, at_b = np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))), np.cumsum([0, *map(len, ids)])
        raw = [t.encode() for t in asked]
        want, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        good = same(self.a, a, at_a, want, at) & same(self.b, b, at_b, want, at)
        if not good.all():
            a, at_a = keep(a, at_a, good)
            b, at_b = keep(b, at_b, good)
        return a, at_a, b, at_b


def same(side: Side, ids, at, want, want_at) -> np.ndarray:
    """Per text: do the bytes of its ids equal its own?"""
    got, upto = side.joined(ids), np.concatenate([[0], np.cumsum(side.size[ids])])[at]
    if len(got) == len(want) and (upto == want_at).all() and (got == want).all():
        return np.ones(len(at) - 1, bool)
    return np.array([np.array_equal(got[i:j], want[k:m]) for i, j, k, m in zip(upto[:-1], upto[1:], want_at[:-1], want_at[1:])], bool)


def keep(ids, at, good):
    """Flat ids and offsets with nothing for texts that are not ``good``."""
    size = np.where(good, np.diff(at), 0)
    return ids[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(size)])


def ends(side: Side, ids, at) -> np.ndarray:
    """Byte offset in its own text at which each token ends."""
    upto = np.concatenate([[0], np.cumsum(side.size[ids])])
    return upto[1:] - np.repeat(upto[at[:-1]], np.diff(at))


def lanes(end_a, at_a, end_b, at_b, lane: int = LANE):
    """Where the pointers begin and stop: (a, stop of a, b). Long documents have several, parted at common ends."""
    begin = [at_a[:-1][np.diff(at_a) > 0]]
    begin_b = [at_b[:-1][np.diff(at_a) > 0]]
    for d in np.flatnonzero(np.diff(at_a) > 2 * lane):
        a, stop, low, high = at_a[d], at_a[d + 1], at_b[d], at_b[d + 1]
        look, last = a + lane, stop - lane
        while look < last:
            seen = end_a[look: min(look + 64, last)]
            place = low + np.searchsorted(end_b[low:high], seen)
            hit = np.flatnonzero(end_b[np.minimum(place, high - 1)] == seen)
            if not len(hit):
                look += 64
                continue
            begin.append(np.array([look + hit[0] + 1]))
            begin_b.append(np.array([place[hit[0]] + 1]))
            low, look = place[hit[0]] + 1, look + hit[0] + 1 + lane
    a, b = np.concatenate(begin), np.concatenate(begin_b)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return a, np.append(a[1:], len(end_a)), b


def lockstep(end_a, end_b, a, stop, b):
    """Move all pointers together. Returns the links (a token, b token) and the groups (first, after last of a; the same of b), in order of a."""
    link_a, link_b, cuts = [], [], []
    from_a, from_b = a.copy(), b.copy()
    a, b = a.copy(), b.copy()
    while len(a):
        x, y = end_a[a], end_b[b]
        link_a.append(a.copy())
        link_b.append(b.copy())
        a += x <= y
        b += y <= x
        at = np.flatnonzero(x == y)
        if len(at):
            cuts.append(np.stack([from_a[at], a[at], from_b[at], b[at]]))
            from_a[at], from_b[at] = a[at], b[at]
        live = a < stop
        if not live.all():
            a, b, from_a, from_b, stop = a[live], b[live], from_a[live], from_b[live], stop[live]
    if not cuts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((4, 0), np.int64)
    cuts = np.concatenate(cuts, axis=1)
    return np.concatenate(link_a), np.concatenate(link_b), cuts[:, np.argsort(cuts[0], kind="stable")]


def spread(first, size) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] of them, for all i."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def summed(keys, times):
    """Each different key once, with the sum of its times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def linked_pairs(ids_a, ids_b, width: int, link_a, link_b, groups, owner):
    """Links as (document, pair of ids, times), each pair once a document.

    A link crosses a group from any of its A tokens to any B token. With one
    token on a side these are the links of the walk; else the ids of the sides
    are crossed, different ids once with their product of times, so a large
    group costs its different ids.
    """
    m, n = groups[1] - groups[0], groups[3] - groups[2]
    many = (m > 1) & (n > 1)
    group = np.searchsorted(groups[0], link_a, "right") - 1
    plain = ~many[group]
    doc = [owner[group[plain]]]
    key = [ids_a[link_a[plain]] * width + ids_b[link_b[plain]]]
    times = [np.ones(len(key[0]), np.int64)]
    small = many & (m * n <= SMALL_GROUP)
    if small.any():
        fa, fb, sa, sb = groups[0][small], groups[2][small], m[small], n[small]
        a = spread(fa, sa)                       # every A token of these groups ...
        across = np.repeat(sb, sa)               # ... meets all B tokens of its group
        key.append(np.repeat(ids_a[a], across) * width + ids_b[spread(np.repeat(fb, sa), across)])
        doc.append(np.repeat(np.repeat(owner[small], sa), across))
        times.append(np.ones(len(key[-1]), np.int64))
    for g in np.flatnonzero(many & ~small):
        a, ta = np.unique(ids_a[groups[0, g]: groups[1, g]], return_counts=True)
        b, tb = np.unique(ids_b[groups[2, g]: groups[3, g]], return_counts=True)
        key.append((a[:, None] * width + b[None, :]).ravel())
        times.append((ta[:, None] * tb[None, :]).ravel())
        doc.append(np.full(len(key[-1]), owner[g]))
    doc, key, times = np.concatenate(doc), np.concatenate(key), np.concatenate(times)
    both, times = summed((doc << 42) | key, times)
    return both >> 42, both & ((1 << 42) - 1), times


def digests(t: Tokenizers, ids_a, ids_b, groups, owner, n_docs: int) -> list[str]:
    """SHA-256 of each document's groups as text; empty without tokens."""
    a_ends, b_ends = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)  # 0 comma, 1 bar, 2 semicolon, 3 nothing
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
    a_ends[groups[1] - 1] = 1
    b_ends[groups[3] - 1] = 2
    b_ends[groups[3][last] - 1] = 3
    m, n = groups[1] - groups[0], groups[3] - groups[2]
    # A tokens stand after the B tokens of earlier groups, B tokens after the A tokens of their own group too.
    code = np.zeros(len(ids_a) + len(ids_b), np.int64)
    code[np.arange(len(ids_a)) + np.repeat(groups[2], m)] = a_ends * t.decimals + ids_a
    code[np.arange(len(ids_b)) + np.repeat(groups[1], n)] = b_ends * t.decimals + ids_b
    text = joined(t.spelled, code)
    size = np.concatenate([[0], np.cumsum(np.diff(t.spelled_offsets)[code])]) if len(code) else np.zeros(1, np.int64)
    out = [""] * n_docs
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    for d, i, j in zip(owner[last].tolist(), size[groups[0][begin] + groups[2][begin]].tolist(), size[groups[1][last] + groups[3][last]].tolist()):
        out[d] = hashlib.sha256(text[i:j]).hexdigest()
    return out


def tokenizers(raw_a: bytes, raw_b: bytes) -> Tokenizers:
    store, name = worker_store(), "aligned-" + hashlib.md5(raw_a + raw_b).hexdigest()
    if name not in store:
        t = Tokenizers(raw_a, raw_b)
        t.spelled_offsets = np.frombuffer(t.spelled.buffers()[1], np.int64)[: len(t.spelled) + 1]
        store[name] = t
    return store[name]


def runs(texts: list[str], most: int = CHUNK_CHARS):
    """(first, after last) of runs of texts of about ``most`` characters."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= most):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _lists(values, sizes, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair}>, times array<long>"


def align(df: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, text: str = "text", keep_groups: bool = False, lane: int = LANE) -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text.

    ``pairs`` holds every linked pair of ids once, as A id * size of
    vocabulary B + B id, and ``times`` how many links it has. With
    ``keep_groups`` also ids_a, ids_b, ends_a and ends_b (where each group ends in either list).
    Texts that are null or empty, or that either tokenizer does not give back
    byte for byte (with a space before), have no tokens: zeros, empty lists, an
    empty digest. Columns of ``df`` with these names are replaced; an empty
    table stays empty. A text is never cut; its memory is that of its own tokens and different pairs.
    """
    raw_a = df.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer_a or default_tokenizer()))
    raw_b = df.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer_b or default_pieces()))
    local = tokenizers(raw_a.value, raw_b.value)
    pair = "int" if local.a.count * local.b.count < 1 << 31 else "long"
    pair_type = pa.int32() if pair == "int" else pa.int64()
    added = FOUND.format(pair=pair) + (", ids_a array<int>, ids_b array<int>, ends_a array<int>, ends_b array<int>" if keep_groups else "")
    new = [c.split(" ")[0] for c in added.split(", ")]
    names = [c for c in df.columns if c.lower() not in new]

    def run(batches):
        t = tokenizers(raw_a.value, raw_b.value)
        for batch in batches:
            every = text_column(batch, text).to_pylist()
            for first, stop in runs(every):
                n = stop - first
                a, at_a, b, at_b = t.encode(every[first:stop])
                end_a, end_b = ends(t.a, a, at_a), ends(t.b, b, at_b)
                link_a, link_b, groups = lockstep(end_a, end_b, *lanes(end_a, at_a, end_b, at_b, lane))
                owner = np.searchsorted(at_a, groups[0], "right") - 1
                doc, pairs, times = linked_pairs(a, b, t.b.count, link_a, link_b, groups, owner)
                per, size = np.bincount(doc, minlength=n), np.concatenate([[0], np.cumsum(times)])
                edge = np.concatenate([[0], np.cumsum(per)])
                columns = [np.diff(at_a), np.diff(at_b), np.bincount(owner, minlength=n), size[edge[1:]] - size[edge[:-1]]]
                out = [*(batch.column(c).slice(first, n) for c in names), *(pa.array(c, pa.int64()) for c in columns),
                       pa.array(digests(t, a, b, groups, owner, n), pa.string()), _lists(pairs, per, pair_type), _lists(times, per, pa.int64())]
                if keep_groups:
                    have = np.bincount(owner, minlength=n)
                    out += [_lists(a, np.diff(at_a), pa.int32()), _lists(b, np.diff(at_b), pa.int32()),
                            _lists(groups[1] - at_a[owner], have, pa.int32()), _lists(groups[3] - at_b[owner], have, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, names=[*names, *new])

    kept = df.select(*names) if text in names else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
    return kept.mapInArrow(run, f"{schema}, {added}")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best) of every linked pair: rows that hold it, and whether no pair of its A id is held by more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")).withColumn("a", F.expr(f"pair div {width}"))
    counts = materialize(counts, "paircounts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row an id of vocabulary A
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def corpus_links(df: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``df``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows that hold it linked, so repeated rows
    count each; a null key stays null. Texts without tokens (see ``align``)
    have zeros and an empty digest; other columns are left out; an empty table
    gives an empty result.
    """
    spark = df.sparkSession
    asked = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = materialize(align(asked, tokenizer_a, tokenizer_b, "_text").drop("_text"), "aligned")
    width = tokenizers(tokenizer_bytes(tokenizer_a or default_tokenizer()), tokenizer_bytes(tokenizer_b or default_pieces())).b.count
    weights = materialize(pair_counts(found, width), "weights")
    total = weights.agg(F.sum("docs")).first()[0] or 0
    # Fewer than ``heavy`` pairs can hold more than a share of 1 / heavy of all rows.
    top = weights.where(F.col("docs") * heavy > total).toArrow()
    order = np.argsort(top["pair"].to_numpy(), kind="stable")
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "docs", "best")))
    pair = found.schema["pairs"].dataType.elementType.simpleString()

    def run(batches):
        pairs, docs, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            size = np.asarray(lists.value_lengths(), dtype=np.int64)
            flat, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten())
            place = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            hit = pairs[place] == flat if len(pairs) else np.zeros(len(flat), bool)
            place = np.where(hit, place, 0)
            edge = np.concatenate([[0], np.cumsum(size)])
            held = np.zeros(len(flat), np.int64)
            held[hit] = times[hit]

            def sums(values):
                upto = np.concatenate([[0], np.cumsum(values)])
                return upto[edge[1:]] - upto[edge[:-1]]
            rest = sums((~hit).astype(np.int64))
            n_best, count_sum = (sums(held * best[place]), sums(held * docs[place])) if len(pairs) else (np.zeros(len(size), np.int64),) * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in plain), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                 _lists(flat[~hit], rest, lists.type.value_type), _lists(times[~hit], rest, pa.int64())],
                names=[*plain, "n_best", "count_sum", "pairs", "times"])

    plain = [c for c in found.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in plain)
    first = materialize(found.mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<{pair}>, times array<long>"), "heavy")
    light = first.where(F.size("pairs") > 0).select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    light = (light.join(weights, "pair").groupBy("_row")
             .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum")))
    return first.join(light, "_row", "left").select(
        F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def op13_lockstep(spark, sf_dir):
    return corpus_links(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
