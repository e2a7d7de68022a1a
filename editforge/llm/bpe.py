"""Operator 7: byte-level BPE encoding and decoding.

Encoding of one piece: its bytes are a doubly linked list of symbols; a heap
holds (merge rank, place) of adjacent pairs; the least is applied, its two new
neighbours are pushed, and entries whose symbols have changed since are
skipped when they come up. Decoding concatenates vocabulary strings.

Texts are cut into pieces by code-point classes with numpy, and a piece that
a worker has seen before is not merged again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from editforge.llm.common import text_column

#: Pieces, and characters of them, that a worker remembers before it starts afresh.
REMEMBERED, REMEMBERED_CHARS = 600_000, 1 << 23
#: Code points handled at once.
CHUNK_CHARS = 1 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Endings after an apostrophe that the pre-tokenizer's pattern splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks."""
    return sys.modules.setdefault("_editforge_worker_store", types.ModuleType("_editforge_worker_store")).__dict__


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for
    themselves, the others numbered from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and strings of a byte-level BPE tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.base = [ids[s] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        back = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s.encode() for s, i in self.added.items()})

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        merges, symbol = self.merges, [self.base[b] for b in piece]
        n = len(symbol)
        if n < 2:
            return symbol
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = merges.get((symbol[i], symbol[i + 1]))
            if m is not None:
                heap.append((m[0], i, m[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, made, left, right = pop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((made, symbol[k]))
                if m is not None:
                    push(heap, (m[0], i, m[1], made, symbol[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((symbol[h], made))
                if m is not None:
                    push(heap, (m[0], h, m[1], symbol[h], made))
        return [s for s in symbol if s >= 0]

    def decode(self, ids) -> str:
        """Text of token ids: the vocabulary strings one after the other, as UTF-8."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    store = worker_store()
    if "classes" not in store:
        import regex
        every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        out = np.zeros(0x110000, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                out[m.start():m.end()] = kind
        store["classes"] = out
    return store["classes"]


def piece_bounds(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of several texts laid one after the other.

    The pre-tokenizer's pattern: an apostrophe's ending; letters, numbers or
    other characters with at most one blank before; white space, of which the
    last one before something else stays behind.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new |= edge[:n]
    space = kind == SPACE
    # The last white space before something else of the same text begins a piece; if it is a blank, the next run joins it.
    last = space[:-1] & ~space[1:] & ~edge[1:n]
    at = np.flatnonzero(last)
    new[at] = True
    blank = at[points[at] == 0x20]
    new[blank + 1] = False
    # An apostrophe that begins a piece, with one of the endings right after it.
    marks = np.flatnonzero((points == 0x27) & new)
    text_end = offsets[np.searchsorted(offsets, marks, "right")] if len(marks) else marks
    for i, stop in zip(marks.tolist(), text_end.tolist()):
        tail = points[i + 1: min(i + 3, stop)]
        for ending in CONTRACTIONS:
            k = len(ending)
            if len(tail) >= k and all(tail[j] == ord(ending[j]) for j in range(k)):
                new[i + 1] = False
                if k == 2:
                    new[i + 2] = False
                if i + 1 + k < n and not edge[i + 1 + k]:
                    new[i + 1 + k] = True
                break
    return np.flatnonzero(new)


class Pieces:
    """Token ids of the pieces a worker has met, looked up by the piece itself."""

    def __init__(self, merge):
        self.merge = merge
        self.clear()

    def clear(self):
        self.entry, self.used, self.chars = {}, 0, 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.int32)

    def _add(self, keys: list[str]):
        found = self.merge(keys)
        have, flat = len(self.entry), [i for ids in found for i in ids]
        while have + len(keys) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        self.size[have: have + len(keys)] = sizes
        self.start[have: have + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used: self.used + len(flat)] = flat
        self.used += len(flat)
        self.chars += sum(map(len, keys))
        self.entry.update(zip(keys, range(have, have + len(keys))))

    def encode(self, texts: list[str]):
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.entry) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *map(len, texts)])
        starts = piece_bounds(points, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = starts.tolist()
        cut = [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])]
        places = list(map(self.entry.get, cut))
        if None in places:
            self._add(list({c for c, p in zip(cut, places) if p is None}))
            places = map(self.entry.__getitem__, cut)
        places = np.fromiter(places, np.int64, len(cut))
        sizes = self.size[places].astype(np.int64)
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[places] - (upto - sizes), sizes) + np.arange(upto[-1])]
        edge = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return ids, np.diff(edge)


def own_merges(raw: bytes) -> Pieces:
    """The worker's pieces, merged by this module."""
    store, name = worker_store(), "own-" + hashlib.md5(raw).hexdigest()
    if name not in store:
        v = Vocabulary(raw)
        p = Pieces(lambda pieces: [v.merge(x.encode()) for x in pieces])
        p.vocabulary = v
        store[name] = p
    return store[name]


def encode_texts(texts: list[str], pieces: Pieces, added: dict[str, int]):
    """Yields the ids (an int32 array) of each text, in order.

    Strings of added tokens inside a text become their ids; what lies between
    is encoded on its own.
    """
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        parts, owner, fixed = [], [], {}
        for k, text in enumerate(texts[at:end]):
            if any(a in text for a in added):
                for segment, token in _around(text, added):
                    parts.append(segment)
                    owner.append(k)
                    if token is not None:
                        fixed[len(parts) - 1] = token
            else:
                parts.append(text)
                owner.append(k)
        ids, sizes = pieces.encode(parts)
        stops = np.cumsum(sizes)
        if not fixed:
            yield from np.split(ids, stops[:-1])
        else:
            out = [[] for _ in range(end - at)]
            for i, (k, a, b) in enumerate(zip(owner, (stops - sizes).tolist(), stops.tolist())):
                out[k].append(ids[a:b])
                if i in fixed:
                    out[k].append(np.array([fixed[i]], np.int32))
            yield from (np.concatenate(x) for x in out)
        at = end


def _around(text: str, added: dict[str, int]):
    """(text before, id) for each added token in a text from left to right, then (rest, None)."""
    at = 0
    while True:
        hit = min(((p, -len(a), a) for a in added if (p := text.find(a, at)) >= 0), default=None)
        if hit is None:
            yield text[at:], None
            return
        yield text[at: hit[0]], added[hit[2]]
        at = hit[0] + len(hit[2])


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, tokenizer: str | None = None, text: str = "text", output: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text in the array column ``output``.

    Null and empty texts get an empty array; equal texts get equal ids; a
    column already named ``output`` is replaced; an empty table stays empty.
    """
    raw = df.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer or default_tokenizer()))
    kept = df.drop(output)
    names = kept.columns

    def run(batches):
        pieces = own_merges(raw.value)
        for batch in batches:
            ids = list(encode_texts(text_column(batch, text).to_pylist(), pieces, pieces.vocabulary.added))
            sizes = np.cumsum([0, *map(len, ids)])
            column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], names=[*names, output])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{output}` array<int>")


def decode(df: DataFrame, tokenizer: str | None = None, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of token ids in ``output``; a null array gives a null text, an unknown id is an error."""
    raw = df.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer or default_tokenizer()))
    kept = df.drop(output)
    names = kept.columns

    def run(batches):
        decode = own_merges(raw.value).vocabulary.decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, output])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{output}` string")


def op7_bpe(spark, sf_dir):
    """Per document the digests of its ids and of their decoding.

    Ids are digested where they are made: passing a billion ids between
    processes twice would cost more than the encoding. The steps are those of
    ``encode`` and ``decode``.
    """
    documents = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    raw = spark.sparkContext.broadcast(tokenizer_bytes(default_tokenizer()))

    def run(batches):
        pieces = own_merges(raw.value)
        v = pieces.vocabulary
        decimal = [str(i) for i in range(max(v.strings) + 1)]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in encode_texts(text_column(batch).to_pylist(), pieces, v.added):
                ids = ids.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
