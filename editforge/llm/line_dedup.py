"""Operator 9: removal of repeated runs by winnowing over line hashes.

Shared passages begin and end anywhere, so a line here is not what stands
between two line breaks but the LINE_WORDS words that begin at a word; every
word begins one. Of the neighbouring line hashes of MIN_WORDS words the least is a
fingerprint, so each run of MIN_WORDS words is told by one, and equal runs by
equal ones at the same place in them. A fingerprint's stretch is what the runs
it tells cover together. Places of equal stretches hold the same runs: the
first stays, the others are deleted. Where the places of a fingerprint differ
in their stretches, the first place of each is compared run by run, so that an
earlier place that shares fewer than MIN_WORDS words hides no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editforge.llm.common import chunks, fresh, mix64, text_column, tidy, words
from editforge.session import materialize

LINE_WORDS = 32
MIN_WORDS = 50
#: Rows whose texts are rewritten at once.
ROWS = 1000
#: Hashes of runs are polynomials modulo this prime; modulo a power of two some long runs would meet whatever the base.
PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x1342543DE82EF95


def times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it: products of halves of 30 and 31 bits."""
    low, u = np.uint64((1 << 31) - 1), np.uint64
    a1, a0, b1, b0 = a >> u(31), a & low, b >> u(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << u(1)) + (middle >> u(30)) + ((middle & u((1 << 30) - 1)) << u(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


_POWERS: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... of n places at least, kept between calls."""
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, times(p, np.uint64(pow(base, len(p), int(PRIME))))])
    if len(p) <= 1 << 22:
        _POWERS[base] = p
    return p


class Sums:
    """Hashes of any run of words, from running sums over their hashes."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.inverse = powers(pow(_BASE, -1, int(PRIME)), n + 1)
        value, low = times(reduced(h), powers(_BASE, n)[:n]), np.uint64((1 << 31) - 1)
        self.total = np.zeros(n + 1, np.uint64)
        high = reduced(np.cumsum(value >> np.uint64(31)))
        self.total[1:] = reduced(times(high, np.uint64(1 << 31)) + reduced(np.cumsum(value & low)))

    def between(self, start, stop, inverse) -> np.ndarray:
        return mix64(times(reduced(self.total[stop] + PRIME - self.total[start]), inverse))

    def lines(self, k: int = LINE_WORDS) -> np.ndarray:
        """Hash of the k words that begin at each word, for all but the last k - 1."""
        if len(self.total) <= k:
            return np.zeros(0, np.uint64)
        n = len(self.total) - k
        return self.between(slice(n), slice(k, n + k), self.inverse[:n])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to its stop."""
        return self.between(start, stop, self.inverse[start])


def _window(min_words: int) -> int:
    """So many neighbouring lines that a run of ``min_words`` always holds a fingerprint."""
    return max(1, min_words - LINE_WORDS + 1)


def fingerprints(lines: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS):
    """(place, start, stop) of the window minima (of equal ones the leftmost) among the line hashes of several texts.

    ``first``: the first word of each text, and the end of the last one. From
    start to stop reach the runs of ``min_words`` words that the place is the minimum of.
    """
    window = _window(min_words)
    n, none = len(lines), np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    bits = np.uint64(int(n).bit_length())
    least = ((lines >> bits) << bits) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    # Windows that lie within one text: of its w words, w - min_words + 1 begin one.
    begin = _each(first[:-1], np.maximum(np.diff(first) - min_words + 1, 0))
    if not len(begin):
        return none, none, none
    place = (least[begin] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1))  # places never fall from window to window
    return place[new], begin[new], begin[np.append(new[1:], len(begin)) - 1] + min_words


def _each(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` numbers from each start on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


#: A place where the words from start to stop, hashed to run, stand; done: they stand earlier too.
PLACE = "mark long, run long, doc long, start int, stop int, done boolean"
NAMES = ["mark", "run", "doc", "start", "stop", "done"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
SPAN = "array<struct<start: int, stop: int, run: long>>"


def _emit(columns, step: int = 50_000):
    for a in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[a: a + step], t) for c, t in zip(columns, TYPES)], names=NAMES)


def _classes(mark, run, doc, start, min_words: int):
    """Of sorted places: (which begin a mark's run, which repeat its first place, which stand there twice).

    The same place comes twice when a row repeats: it is not a copy of itself,
    nor is a place that overlaps the first one.
    """
    new, twice = np.ones(len(mark), bool), np.zeros(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (run[1:] != run[:-1])
    twice[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    lead = np.flatnonzero(new)
    lead = np.repeat(lead, np.diff(np.append(lead, len(mark))))
    return new, ~new & ~twice & ((doc != doc[lead]) | (start - start[lead] >= min_words)), twice


def _of_task(places, min_words: int):
    """Places of a task, those done that repeat one of it."""
    places = [np.concatenate(x) for x in zip(*places)]
    if not places:
        return
    order = np.lexsort(places[3::-1])
    places = [x[order] for x in places]
    _, done, twice = _classes(*places[:4], min_words)
    yield from _emit([x[~twice] for x in (*places, done)])


def _stretches(key: str, text: str, min_words: int):
    """Stretches of all fingerprints."""
    def places(batches):
        for batch in batches:
            ids = np.asarray(batch.column(key).cast(pa.int64()))
            for row, n, data, offsets in chunks(text_column(batch, text)):
                h, first, _, _ = words(data, offsets, lower=False)
                sums = Sums(h)
                lines = sums.lines(min(LINE_WORDS, min_words))
                at, start, stop = fingerprints(lines, first, min_words)
                doc = np.searchsorted(first, at, "right") - 1
                yield (lines[at].view(np.int64), sums.runs(start, stop).view(np.int64), ids[row + doc],
                       (start - first[doc]).astype(np.int32), (stop - first[doc]).astype(np.int32))
    return lambda batches: _of_task(places(batches), min_words)


def _lists(column: pa.Array):
    """(length of each list, the fields of all their elements) of a column of lists of structures."""
    flat = column.flatten()
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64), [np.asarray(x) for x in flat.flatten()]


def _windows(key: str, text: str, asked: str, min_words: int):
    """Every run of ``min_words`` words in the stretches asked for."""
    def places(batches):
        for batch in batches:
            ids = np.asarray(batch.column(key).cast(pa.int64()))
            size, (start, stop) = _lists(batch.column(asked))
            ends = np.concatenate([[0], np.cumsum(size)])
            for row, n, data, offsets in chunks(text_column(batch, text)):
                h, first, _, _ = words(data, offsets, lower=False)
                here = slice(ends[row], ends[row + n])
                doc = np.repeat(np.arange(n), size[row: row + n])
                inside = stop[here] <= np.diff(first)[doc]  # else found in another row of this id
                doc, a, b = doc[inside], start[here][inside], stop[here][inside]
                count = b - a - min_words + 1
                at, doc = _each(first[doc] + a, count), np.repeat(doc, count)
                run, place = Sums(h).runs(at, at + min_words).view(np.int64), (at - first[doc]).astype(np.int32)
                yield run, run, ids[row + doc], place, place + np.int32(min_words)
    return lambda batches: _of_task(places(batches), min_words)


def _settle(min_words: int):
    """Rows come sorted by done, mark, run, doc, start: out come the places done, and of marks with several runs the others."""
    def run(batches):
        held, told, several = None, 0, False  # of the last mark: places still needed, how many of them went out, whether it has several runs
        for batch in batches:
            rows = [np.asarray(batch.column(c)) for c in NAMES[:5]]
            old = np.asarray(batch.column("done").cast(pa.int8())).astype(bool)
            yield from _emit([*(x[old] for x in rows), old[old]])
            rows = [x[~old] for x in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            mark, _, doc, start, _ = rows
            new, done, twice = _classes(*rows[:4], min_words)
            edge = np.ones(len(mark), bool)
            edge[1:] = mark[1:] != mark[:-1]
            of = np.cumsum(edge) - 1
            many = np.bincount(of, new) > 1
            many[0] |= several
            rest = ~done & ~twice
            last = of == of[-1]
            open_ = rest & many[of]
            open_[:told] = False
            out = done | open_
            yield from _emit([*(x[out] for x in rows), done[out]])
            several = bool(many[-1])
            if several:  # the first place of the run that may go on
                keep, told = np.flatnonzero(new)[-1:], 1
            else:
                keep, told = np.flatnonzero(rest & last), 0
            held = [x[keep] for x in rows]
    return run


def _repeats(places: DataFrame, n: int, min_words: int) -> DataFrame:
    """The tasks' places meet by their mark; those done already go by their document."""
    return (places.repartition(n, F.when(F.col("done"), F.xxhash64("doc")).otherwise(F.col("mark")))
            .sortWithinPartitions("done", "mark", "run", "doc", "start").mapInArrow(tidy(_settle(min_words)), PLACE))


def delete(text: str, starts: np.ndarray, stops: np.ndarray, runs: np.ndarray):
    """(text without the words from starts to stops, its words before, word spans deleted); runs: the hashes of what is deleted."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    h, _, first, last = words(data, np.array([0, len(data)]), lower=False)
    n = len(h)
    inside = stops <= n
    starts, stops, runs = starts[inside], stops[inside], runs[inside]
    same = Sums(h).runs(starts, stops).view(np.int64) == runs  # else found in another row of this id
    gone = np.cumsum(np.bincount(starts[same], minlength=n + 1) - np.bincount(stops[same], minlength=n + 1)) > 0
    if not gone.any():
        return text, n, []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:n].astype(np.int8), [0]])))
    spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    parts, at = [], 0
    for a, b in spans:
        if b < n:
            parts.append(raw[at: first[a]])
            at = first[b]
        else:  # up to the last word: what white space follows it stays
            parts.append(raw[at: last[a - 1] if a else 0])
            at = last[b - 1] if a else len(raw)
    parts.append(raw[at:])
    return b"".join(parts).decode(), n, spans


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with repeated runs deleted from their texts, and n_words, removed (word spans) appended.

    Of equal runs of ``min_words`` words the first by (key, place) stays.
    Documents of fewer words cannot hold a run and stay as they are, as do null texts
    and rows with a null key (removed is then empty). Rows that repeat with
    their key are one document, treated alike; a repeat within a document
    must begin ``min_words`` after its first place. Columns named n_words or
    removed are replaced; an empty table stays empty.
    """
    documents = documents.drop("n_words", "removed")
    columns = documents.columns
    at_doc, at_runs, at_asked = fresh(documents, "_doc"), fresh(documents, "_runs"), fresh(documents, "_asked")
    known = documents.where(F.col(key).isNotNull())
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = known.select(F.col(key).cast("long").alias(key), text).mapInArrow(tidy(_stretches(key, text, min_words)), PLACE)
    found = materialize(_repeats(stretches, n, min_words).drop("mark"), "runs")
    asked = (found.where("not done").groupBy(F.col("doc").alias(at_doc)).agg(F.collect_list(F.struct("start", "stop")).alias(at_asked)))
    windows = (known.join(asked, F.col(key) == F.col(at_doc)).select(F.col(key).cast("long").alias(key), text, at_asked)
               .mapInArrow(tidy(_windows(key, text, at_asked, min_words)), PLACE))
    whole = (found.where("done").union(_repeats(windows, n, min_words).drop("mark"))
             .groupBy(F.col("doc").alias(at_doc)).agg(F.collect_list(F.struct("start", "stop", "run")).alias(at_runs)))
    joined = known.join(whole, F.col(key) == F.col(at_doc), "left").drop(at_doc)

    def run(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts, counts, spans = [], [], []
            size, found = _lists(batch.column(at_runs))
            ends = np.concatenate([[0], np.cumsum(size)])
            for i, t in enumerate(batch.column(text)):
                t = t.as_py()
                if t is None or not size[i]:
                    texts.append(t), counts.append(len(_split(t))), spans.append([])
                    continue
                t, k, s = delete(t, *(x[ends[i]: ends[i + 1]] for x in found))
                texts.append(t), counts.append(k), spans.append([{"start": a, "stop": b} for a, b in s])
            out = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                                             names=[*columns, "n_words", "removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields) + ", n_words long, removed array<struct<start: int, stop: int>>"
    done = joined.mapInArrow(tidy(run), fields)
    loose = documents.where(F.col(key).isNull()).withColumn(at_runs, F.lit(None).cast(SPAN))
    return done.union(loose.mapInArrow(run, fields))


def _split(text) -> list:
    """Words as ``words`` finds them: white space is ASCII's."""
    return text.encode().split() if text else []


def op9_winnowing(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    return remove_repeats(documents).select("doc_id", "n_words", "removed", "text")
