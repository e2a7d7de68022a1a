"""L1 exactly as a scanner reads a log from top to bottom (``compat`` of ``diagnostics.error_lines``).

After a header the scanner looks for a location in the next lines and goes on where it
stopped looking, so a header or an inline error in between is skipped. Whether a
line is read therefore depends on all lines before it. The scanner is a finite
automaton: its state is the number of lines left to look at (0: reading). A block
of lines is a function from the state before it to the state after; functions of
blocks, and then of groups of blocks, are composed, and the states come back
down the same tree, so a log of any length stays split over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .diagnostics import HEADER_PREFIX, INLINE_RE, LOCATION_RE, LOOKAHEAD, _num

#: Lines of a block, and blocks (or groups of them) whose functions are composed at once.
BLOCK, FAN = 1 << 16, 1 << 10
STATES = LOOKAHEAD + 1


def scan(header, loc, inline, state: int = 0):
    """(state after the lines, errors found as (place, is header, line number or None)).

    ``header``: places of header lines in order; ``loc`` and ``inline``: line numbers by place, 0 for none.
    A header before these lines has a negative place.
    """
    n, at, found = len(loc), 0, []
    begin = state - STATES  # place of the header that is being looked for, if any
    while True:
        if state:
            seen = np.flatnonzero(loc[at: at + state])
            if len(seen):
                at += int(seen[0])
                found.append((begin, True, int(loc[at])))
            elif n - at < state:
                return state - (n - at), found
            else:
                at += state
        nxt = bisect_left(header, at)
        begin = header[nxt] if nxt < len(header) else n
        read = np.flatnonzero(inline[at:begin]) + at
        found += [(i, False, int(inline[i])) for i in read.tolist()]
        if begin >= n:
            return 0, found
        found.append((begin, True, None))
        at, state = begin + 1, LOOKAHEAD


def _blocks(batch):
    """(positions, header places, locations, inline errors) of each block of an Arrow batch."""
    sizes, rows = pc.list_value_length(batch.column("rows")).to_pylist(), batch.column("rows").flatten()
    pos, hdr, loc, inl = (np.asarray(rows.field(f)) for f in ("pos", "hdr", "loc", "inl"))
    at = 0
    for n in sizes:
        here = slice(at, at + n)
        yield pos[here], np.flatnonzero(hdr[here]).tolist(), loc[here], inl[here]
        at += n


def _functions(batches):
    """State after a block for each state before it."""
    for batch in batches:
        after = [[scan(*block, s)[0] for s in range(STATES)] for _, *block in _blocks(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.list_(pa.int64()))], names=[*batch.schema.names, "f"])


def _errors(batches):
    for batch in batches:
        row, places, kinds, found = [], [], [], []
        for i, ((pos, *block), state) in enumerate(zip(_blocks(batch), batch.column("state").to_pylist())):
            for place, kind, line in scan(*block, state)[1]:
                row.append(i)
                places.append(int(pos[0]) + place)
                kinds.append(kind)
                found.append(line)
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row, pa.int64())), pa.array(places, pa.int64()), pa.array(kinds, pa.bool_()), pa.array(found, pa.int64())],
                                         names=["doc", "pos", "hdr", "line_no"])


def _composed(blocks: DataFrame, fan: int) -> DataFrame:
    """(doc, blk, parts, f): groups of ``fan`` blocks (doc, blk, f), in order in ``parts``, and the function of each group."""
    groups = blocks.groupBy("doc", F.floor(F.col("blk") / fan).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("blk", "f"))).alias("parts"))
    whole = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(STATES - 1).cast("bigint")), lambda s: F.aggregate("parts", s, lambda at, x: F.get(x["f"], at.cast("int"))))
    return groups.select("doc", F.col("up").alias("blk"), "parts", whole.alias("f"))


def _entered(groups: DataFrame) -> DataFrame:
    """(doc, blk, state): the state before each block of a group, from the ``state`` before the group."""
    start = F.struct(F.col("state"), F.array().cast("array<struct<blk: bigint, state: bigint>>").alias("before"))
    step = lambda at, x: F.struct(F.get(x["f"], at["state"].cast("int")).alias("state"), F.concat(at["before"], F.array(F.struct(x["blk"].alias("blk"), at["state"].alias("state")))).alias("before"))
    return groups.select("doc", F.explode(F.aggregate("parts", start, step, lambda at: at["before"])).alias("b")).select("doc", "b.blk", "b.state")


def _with_state(level: DataFrame, states: DataFrame) -> DataFrame:
    """``level`` with the state before each of its blocks; files of states are far smaller than their rows and not to be broadcast."""
    s = states.select(F.col("doc").alias("s_doc"), F.col("blk").alias("s_blk"), "state").hint("merge")
    return level.join(s, F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("blk") == F.col("s_blk"))).drop("s_doc", "s_blk")


def scan_errors(log: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(doc, pos, kind, line_no) of the errors a sequential scan finds, as ``diagnostics.error_lines`` returns them.

    ``log`` is (doc, pos, t) with positions 1, 2, ... without gaps in each doc. Null
    texts are blank lines; rows with a null doc are one doc; other columns are left out; an
    empty log gives an empty result. The number of composing rounds is the
    logarithm to ``fan`` of the blocks of the longest log.
    """
    kind = log.schema["doc"].dataType.simpleString()
    s = log.select("doc", "pos", T.strip_ws(F.col("t")).alias("s"))
    lines = s.select("doc", F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.col("s").startswith(HEADER_PREFIX), F.lit(False)).alias("hdr"),
                     F.coalesce(_num(LOCATION_RE, F.col("s")), F.lit(0)).alias("loc"), F.coalesce(_num(INLINE_RE, F.col("s")), F.lit(0)).alias("inl"),
                     F.floor((F.col("pos") - 1) / block).cast("bigint").alias("blk"))
    rows = "rows array<struct<pos: bigint, hdr: boolean, loc: bigint, inl: bigint>>"
    # A block is one row: its lines are shuffled once and read again where its state is known.
    rowed = lines.groupBy("doc", "blk").agg(F.sort_array(F.collect_list(F.struct("pos", "hdr", "loc", "inl"))).alias("rows"))
    levels = [materialize(rowed.mapInArrow(_functions, f"doc {kind}, blk bigint, {rows}, f array<bigint>"), "blocks")]
    blocks = (levels[0].agg(F.max("blk")).first()[0] or 0) + 1
    while blocks > 1:
        levels.append(materialize(_composed(levels[-1].select("doc", "blk", "f"), fan), "blocks"))
        blocks = -(-blocks // fan)
    states = levels[-1].select("doc", "blk", F.lit(0).cast("bigint").alias("state"))
    for level in levels[:0:-1]:
        states = _entered(_with_state(level, states))
    read = _with_state(levels[0], states).select("doc", "rows", "state")
    found = read.mapInArrow(_errors, f"doc {kind}, pos bigint, hdr boolean, line_no bigint")
    # A header is told where it is read, and once more where its location is found.
    return (found.groupBy("doc", "pos", "hdr").agg(F.max("line_no").alias("line_no"))
            .select("doc", "pos", F.when(F.col("hdr"), F.lit("header")).otherwise(F.lit("inline")).alias("kind"), "line_no"))
