"""B2 and B4 turn by turn, where a path's order depends on what repair has done so far.

The closed form of ``deps.repair_closure`` needs a fixed order and repair
without a bound. Two rules of the sequential loop break that: when repair
removes the protected header, protection passes to the next header line (B2), and
repair of one deletion ends after a number of passes, each of which deletes
the lines that are invalid at its beginning (B4). What is still invalid then
is carried into the next turn, and such a state is not recorded.

A path is walked once, by its events: a turn takes the next unprotected line in order, a
pass the lines whose requirement went in the pass before. Every line and
every requirement is looked at once, so a path costs its lines and edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deps import built_documents, document_arrays, document_schema
from .paths import HEADER_RE

#: Fixed value: passes of repair after one deletion.
MAX_PASSES = 50


def walk(order, headers, needed_by, max_passes: int | None):
    """(turn, step) of each line, and the number of recorded steps.

    ``order``: lines as they would be deleted; ``headers``: header lines from the
    top; ``needed_by[i]``: lines that require line i. A line's step is the
    first recorded state without it.
    """
    n = len(order)
    turn_of, step_of = [0] * n, [0] * n
    left, turn, recorded, at, head = n, 0, 0, 0, 0
    invalid: list[int] = []
    while left:
        turn += 1
        while head < len(headers) and turn_of[headers[head]]:
            head += 1
        protected = headers[head] if head < len(headers) else -1
        # A line that is protected once stays so while it is there: it can be passed over for good.
        while at < n and (turn_of[order[at]] or order[at] == protected):
            at += 1
        doomed, passes, valid = [order[at] if at < n else protected], -1, False
        carried = invalid
        while True:
            hit: list[int] = []
            for i in doomed:
                if not turn_of[i]:
                    turn_of[i], step_of[i] = turn, recorded + 1
                    left -= 1
                    hit += needed_by[i]
            invalid = [i for i in dict.fromkeys(carried + hit) if not turn_of[i]]
            carried, passes = [], passes + 1
            if max_passes is not None and passes >= max_passes:
                break
            if not left or not invalid:
                valid = True
                break
            doomed = invalid
        recorded += valid or not left  # the empty text is always recorded
    return turn_of, step_of, recorded


def _walks(max_passes):
    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("lines"))).astype(np.int64)
            lines = batch.column("lines").flatten()
            ln, rank, header = (np.asarray(lines.field(f)) for f in ("ln", "rank", "header"))
            edges = batch.column("edges").to_pylist()
            turns, steps, totals, at = [], [], [], 0
            for size, asked in zip(sizes.tolist(), edges):
                here = slice(at, at + size)
                at += size
                by_line = np.argsort(ln[here], kind="stable")
                place = {int(v): i for i, v in enumerate(ln[here])}
                needed_by: list[list[int]] = [[] for _ in range(size)]
                for e in asked or ():
                    if e["ln"] in place and e["req"] in place:
                        needed_by[place[e["req"]]].append(place[e["ln"]])
                turn, step, total = walk(np.argsort(rank[here], kind="stable").tolist(), by_line[header[here][by_line]].tolist(), needed_by, max_passes)
                turns += turn
                steps += step
                totals += [total] * size
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column("path_id").take(row), pa.array(ln), pa.array(turns, pa.int64()), pa.array(steps, pa.int64()), pa.array(totals, pa.int64())],
                names=["key", "path_id", "ln", "removal", "step", "total_steps"])
    return run


def repair_turns(lines: DataFrame, ranks: DataFrame, edges: DataFrame, max_passes: int | None = MAX_PASSES, key: str = "ok") -> DataFrame:
    """(key, path_id, ln, removal, step, total_steps) of every rank: B2 with header hand-over and B4 with its bound on passes.

    ``lines`` (key, ln, t) tell headers, ``ranks`` (key, path_id, ln, rank)
    the order, ``edges`` (key, ln, req) the requirements; an edge to a line that
    is not there is void. ``removal`` is the turn in which a line goes. ``max_passes=None`` repairs
    without a bound. One row a path holds its lines and the document's edges;
    documents are one input record each. No path is lost; an empty table gives an empty result.
    """
    kind = lambda c: ranks.schema[c].dataType.simpleString()
    marked = ranks.join(lines.select(key, "ln", F.regexp_like(F.col("t"), F.lit(HEADER_RE)).alias("_h")), [key, "ln"], "left")
    entry = F.struct(F.col("ln").cast("bigint").alias("ln"), F.col("rank").cast("bigint").alias("rank"), F.coalesce("_h", F.lit(False)).alias("header"))
    per_path = marked.groupBy(key, "path_id").agg(F.collect_list(entry).alias("lines"))
    per_doc = edges.groupBy(key).agg(F.collect_list(F.struct(F.col("ln").cast("bigint").alias("ln"), F.col("req").cast("bigint").alias("req"))).alias("edges"))
    rows = per_path.join(per_doc, key, "left").select(key, "path_id", "lines", "edges")
    return (rows.mapInArrow(_walks(max_passes), f"key {kind(key)}, path_id {kind('path_id')}, ln bigint, removal bigint, step bigint, total_steps bigint")
            .withColumnRenamed("key", key))


def _document_walks(max_passes):
    def run(batches):
        for batch in batches:
            n_paths, path_ids, sizes, _, ln, rank, lines, reqs = document_arrays(batch)
            headers = batch.column("headers").to_pylist()
            by_row = np.argsort(reqs, kind="stable")
            lines, reqs = lines[by_row], reqs[by_row]
            turns, steps, totals, at = [], [], [], 0
            for doc, size in zip(np.repeat(np.arange(len(n_paths)), n_paths).tolist(), sizes.tolist()):
                needed_by: list[list[int]] = [[] for _ in range(size)]
                a, b = np.searchsorted(reqs, [at, at + size])
                for line, req in zip((lines[a:b] - at).tolist(), (reqs[a:b] - at).tolist()):
                    needed_by[req].append(line)
                of = set(headers[doc] or ())
                head = [i for i, n in enumerate(ln[at: at + size].tolist()) if n in of]
                turn, step, total = walk(np.argsort(rank[at: at + size], kind="stable").tolist(), head, needed_by, max_passes)
                turns += turn
                steps += step
                totals.append(total)
                at += size
            yield built_documents(batch, n_paths, path_ids, sizes, turns, steps, totals)
    return run


def document_turns(docs: DataFrame, max_passes: int | None = MAX_PASSES, key: str = "ok") -> DataFrame:
    """``repair_turns`` on whole documents (key, lines, seeds, header, edges) -> (key, lines, paths), in the row of the document. Without ``edges``, B3 as well."""
    headers = F.filter("lines", lambda x: F.regexp_like(x["t"], F.lit(HEADER_RE))).getField("ln")
    return (docs.withColumn("headers", headers)
            .mapInArrow(_document_walks(max_passes), document_schema(docs, key)).withColumnRenamed("key", key))
