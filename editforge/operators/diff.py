"""Edit sequences on row lineage: E1-E4, P12-P14, F3.

Deletion paths only remove lines, so the forward sequence (empty -> full)
only inserts. Forward step ``j`` (1..m) adds the lines with
``step = m - j + 1``; its text is ``lines with step >= m - j + 1``. A line is
shown when an added line is within 3 positions (the unified-diff context); a
hunk is a run of shown lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import capped, row_pairs, whole_paths

# --- fixed values ----------------------------------------------------------------
CONTEXT = 3
JOIN_SEPARATOR = "\n"
TAGGED_SEPARATOR = "\n<|next_edit|>\n"
#: Paths of so many lines keep those left as a list, where a step moves the rest of it; longer ones as linked lines.
SHORT_PATH = 1 << 12
#: Lines whose texts are held at once beside the results.
PIECE_LINES = 1 << 14
# -----------------------------------------------------------------------------------


def _range(start0: int, length: int) -> str:
    """Unified-diff range text: ``s``, ``s,l`` or ``s-1,0`` (1-based s)."""
    return f"{start0 + 1}" if length == 1 else f"{start0},0" if length == 0 else f"{start0 + 1},{length}"


def _ordered_join(arr: Column, sep: str) -> Column:
    return F.array_join(F.sort_array(arr).getField("v"), sep)


def _steps_lines(steps: list[int], m: int) -> dict[int, list[int]]:
    by_step: dict[int, list[int]] = {}
    for i, s in enumerate(steps):
        if s <= m:
            by_step.setdefault(s, []).append(i)
    return by_step


def _short_path_hunks(steps: list[int], texts: list[str], m: int, context: int, compat: bool):
    """``_path_hunks`` of a path of few lines: the lines left are a list, a step cuts its hunks out of it."""
    left, shown = list(range(len(steps))), [" " + t for t in texts]
    by_step = _steps_lines(steps, m)
    for s in range(1, m + 1):
        added = by_step.get(s, ())
        if len(added) == 1:
            k = bisect_left(left, added[0])
            a = k - context if k > context else 0
            rows = shown[a: k + context + 1]
            n, t = len(rows), texts[added[0]]
            rows[k - a: k - a + 1] = () if compat and t.startswith("++") else ("+" + t,)
            yield m - s + 1, "\n".join([f"@@ -{a + 1},{n - 1} +{a + 1},{n} @@" if n > 2 else f"@@ -{_range(a, n - 1)} +{_range(a, n)} @@", *rows])
            del left[k], shown[k]
            continue
        at = [bisect_left(left, i) for i in added]
        cuts: list[list[int]] = []  # begin and end of a hunk among the lines left, places of its added lines
        for k in at:
            a, b = max(0, k - context), min(len(left), k + context + 1)
            if cuts and a <= cuts[-1][1]:
                cuts[-1][1] = b
                cuts[-1].append(k)
            else:
                cuts.append([a, b, k])
        parts, done = [], 0  # done: lines of this step shown in earlier hunks
        for a, b, *new in cuts:
            rows = shown[a:b]
            for k in reversed(new):
                t = texts[left[k]]
                rows[k - a: k - a + 1] = () if compat and t.startswith("++") else ("+" + t,)
            parts.append(f"@@ -{_range(a - done, b - a - len(new))} +{_range(a, b - a)} @@")
            parts += rows
            done += len(new)
        if parts:
            yield m - s + 1, "\n".join(parts)
        for k in reversed(at):
            del left[k], shown[k]


def _path_hunks(steps: list[int], texts: list[str], m: int, context: int, compat: bool):
    """(forward step, diff) of one path; ``steps`` and ``texts`` are in line order.

    States only shrink, so the lines left are a doubly linked list that the
    steps empty one after the other; a count tree gives a line's number among
    those left. A step costs its own lines and their context, not the state.
    """
    n = len(steps)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    tree = [i & -i for i in range(n + 1)]
    by_step = _steps_lines(steps, m)
    for s in range(1, m + 1):
        added = by_step.get(s, [])
        hunks, shown, done = [], [], 0  # done: lines of this step shown in earlier hunks
        for i in added:
            lead, j = [], before[i]
            while j >= 0 and len(lead) < context and (not shown or j > shown[-1]):
                lead.append(j)
                j = before[j]
            if shown and i > shown[-1] != j:  # a gap to what is shown already
                hunks.append(shown)
                shown = []
            shown += reversed(lead)
            if not shown or shown[-1] < i:
                shown.append(i)
            j, k = after[i], 0
            while j < n and k < context:
                if j > shown[-1]:
                    shown.append(j)
                j, k = after[j], k + 1
        if shown:
            hunks.append(shown)
        parts = []
        for rows in hunks:
            at, i = 0, rows[0]  # lines left before the hunk
            while i > 0:
                at += tree[i]
                i &= i - 1
            new = sum(steps[r] == s for r in rows)
            parts.append(f"@@ -{_range(at - done, len(rows) - new)} +{_range(at, len(rows))} @@")
            parts += [("+" if steps[r] == s else " ") + texts[r] for r in rows if not (compat and steps[r] == s and texts[r].startswith("++"))]
            done += new
        if parts:
            yield m - s + 1, "\n".join(parts)
        for i in added:
            p, q = before[i], after[i]
            if p >= 0:
                after[p] = q
            if q < n:
                before[q] = p
            i += 1
            while i <= n:
                tree[i] -= 1
                i += i & -i


def _batch_hunks(context: int, compat: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            lines = batch.column("lines")
            sizes = np.asarray(pc.list_value_length(lines)).tolist()
            steps, texts = lines.flatten().field("step").to_pylist(), lines.flatten().field("t")
            hunks, first, at, size = [], 0, 0, 0
            piece, begin = [], 0  # texts of the next lines, at least those of a path
            for r, (n, m) in enumerate(zip(sizes, batch.column("m").to_pylist())):
                if at + n > begin + len(piece):
                    piece, begin = texts[at: at + max(n, PIECE_LINES)].to_pylist(), at
                path = _short_path_hunks if n <= SHORT_PATH else _path_hunks
                hunks.append(list(path(steps[at: at + n], piece[at - begin: at - begin + n], m, context, compat)))
                at += n
                size += sum(len(d) for _, d in hunks[-1])
                if size > 1 << 24:
                    yield _hunk_rows(batch.slice(first, r + 1 - first), names, hunks)
                    hunks, first, size = [], r + 1, 0
            yield _hunk_rows(batch.slice(first), names, hunks)
    return run


def _hunk_rows(batch, names, hunks):
    flat = [h for of in hunks for h in of]
    pairs = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int64()), pa.array([v for _, v in flat], pa.string())], names=["k", "v"])
    ends = pa.array(np.cumsum([0, *map(len, hunks)]), pa.int32())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(ends, pairs)], names=[*names, "hunks"])


def _repeated_lines(lns, texts, steps):
    """Lines of a repeated document: (texts in line order, steps, texts by step) of each step with each text of its line."""
    of: dict = {}
    for n, t in zip(lns, texts):
        of.setdefault(n, []).append(t)
    pairs = [(n, t, s) for n, s in zip(lns, steps) for t in of[n]]
    pairs.sort()
    by_step = sorted((n, s, t) for n, t, s in pairs)
    return [t for _, t, _ in pairs], [s for _, _, s in pairs], [s for _, s, _ in by_step], [t for _, _, t in by_step]


#: Rows of documents whose texts are held at once beside the results.
PIECE_ROWS = 256


def _batch_sequences(cap: int | None, context: int, compat: bool, sep: str, kept: list[str], build=iter):
    """One row per path with m >= 1 from the rows of documents that ``build`` makes of a task's batches: texts are read once for all paths of a document."""
    def rows_of(batch):
        lines, paths = batch.column("lines"), batch.column("paths").flatten()
        texts, lns = lines.flatten().field("t").to_pylist(), lines.flatten().field("ln").to_pylist()
        n_paths, at = pc.list_value_length(batch.column("paths")).to_pylist(), 0
        numbers, totals, every = (paths.field("path_id").to_pylist(), paths.field("total_steps").to_pylist(), pc.list_flatten(paths.field("step")).to_pylist())
        first = path = 0
        for d, n in enumerate(pc.list_value_length(lines).to_pylist()):
            text, ln = texts[first: first + n], lns[first: first + n]
            first += n
            single, whole = len(set(ln)) == n, "\n".join(text)
            for p in range(path, path + n_paths[d]):
                steps, at = every[at: at + n], at + n
                m = totals[p] if cap is None else min(totals[p], cap)
                if m < 1:
                    continue
                shown, initial, ordered, gone = text, whole, text, steps
                if not single:
                    shown, gone, steps, ordered = _repeated_lines(ln, text, steps)
                    initial = "\n".join(shown)
                make = _short_path_hunks if len(steps) <= SHORT_PATH else _path_hunks
                parts = [v for _, v in make(steps, ordered, m, context, compat) if v]
                parts.reverse()
                final = "" if m >= totals[p] else "\n".join([t for t, k in zip(shown, gone) if k > m])
                yield d, numbers[p], initial, final, sep.join(parts), len(parts)
            path += n_paths[d]

    def run(batches):
        for batch in build(batches):
            for begin in range(0, batch.num_rows, PIECE_ROWS):
                piece, rows, size = batch.slice(begin, PIECE_ROWS), [], 0
                for row in rows_of(piece):
                    rows.append(row)
                    size += len(row[2]) + len(row[4])
                    if size > 1 << 24:
                        yield _sequence_rows(piece, rows, kept)
                        rows, size = [], 0
                if rows:
                    yield _sequence_rows(piece, rows, kept)
    return run


def _sequence_rows(batch, rows, kept):
    doc, *columns = zip(*rows)
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
    doc = pa.array(doc, pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0).take(doc), *(pa.array(c, t) for c, t in zip(columns, types)), *(batch.column(c).take(doc) for c in kept)],
                                      names=["key", "path_id", "initial_code", "final_code", "edit_sequence", "steps_count", *kept])


def document_sequences(documents: DataFrame, cap: int | None = None, key: str = "ok", context: int = CONTEXT, compat: bool = False,
                       sep: str = JOIN_SEPARATOR, build: tuple[Callable, Sequence[str]] | None = None) -> DataFrame:
    """E1 and E2 in the row of built documents: ``row_sequence`` of ``row_hunks`` with the texts of ``paths.summary_columns``.

    (key, path_id, initial_code, final_code, edit_sequence, steps_count) and the documents' further columns, one row per path with a step.
    ``build`` makes built documents (Arrow batches) of others, in the same pass, and names the columns that it needs beside key and lines.
    """
    make, needed = build or (iter, ("paths",))
    kept = [c for c in documents.columns if c not in (key, "lines", *needed)]
    fields = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.select(key, "lines", *needed, *kept).mapInArrow(
        _batch_sequences(cap, context, compat, sep, kept, make),
        f"key {documents.schema[key].dataType.simpleString()}, path_id int, initial_code string, final_code string, edit_sequence string, steps_count bigint{fields}").withColumnRenamed("key", key)


def _by_step() -> Column:
    """A path's lines, those of one number (of repeated documents) by their steps."""
    repeated = F.size(F.array_distinct(F.col("lines.ln"))) < F.size("lines")
    row = F.transform("lines", lambda x: F.struct(x["ln"].alias("ln"), x["step"].alias("step"), x["t"].alias("t")))
    return F.when(repeated, F.sort_array(row)).otherwise(row)


def row_hunks(rows: DataFrame, cap: int | None = None, key: str = "ok", context: int = CONTEXT, compat: bool = False,
              keep: dict[str, Column] | None = None) -> DataFrame:
    """E1 in the row of the path: (key, path_id, m, hunks) with hunks (k: forward step, v: diff), from ``paths.path_rows``.

    ``keep`` names further columns, made from the path's row; m is the number of recorded steps, 1 at least.
    """
    s = capped(rows, cap).where(F.col("m") >= 1).select(key, "path_id", "m", *(c.alias(n) for n, c in (keep or {}).items()), _by_step().alias("lines"))
    names = [c for c in s.columns if c != "lines"]
    fields = ", ".join(f"`{c}` {s.schema[c].dataType.simpleString()}" for c in names)
    return s.mapInArrow(_batch_hunks(context, compat, names), f"{fields}, hunks array<struct<k: bigint, v: string>>")


def diff_hunks(steps: DataFrame, lines: DataFrame, cap: int | None = None, key: str = "ok",
               context: int = CONTEXT, compat: bool = False) -> DataFrame:
    """(key, path_id, fwd, diff) with one unified-diff text per forward step.

    One row per path holds its lines (a document is one input record); the
    hunks of all its steps come from one walk over them, O(n log n).
    ``compat=True`` also drops added lines that start with ``++`` (the reference
    filters every diff line starting ``+++``/``---`` to remove file headers).
    """
    return hunk_rows(row_hunks(whole_paths(steps, lines, key), cap, key, context, compat), key)


def hunk_rows(hunks: DataFrame, key: str = "ok") -> DataFrame:
    """(key, path_id, fwd, diff) of ``row_hunks``."""
    return hunks.select(key, "path_id", F.explode("hunks").alias("h")).select(key, "path_id", F.col("h.k").alias("fwd"), F.col("h.v").alias("diff"))


def edit_sequence(diffs: DataFrame, key: str = "ok", sep: str = JOIN_SEPARATOR) -> DataFrame:
    """(key, path_id, edit_sequence, steps_count); empty diffs are not parts."""
    d = diffs.where(F.col("diff") != "")
    return d.groupBy(key, "path_id").agg(
        _ordered_join(F.collect_list(F.struct(F.col("fwd").alias("k"), F.col("diff").alias("v"))), sep)
        .alias("edit_sequence"),
        F.count(F.lit(1)).cast("bigint").alias("steps_count"))


def row_sequence(hunks: DataFrame, sep: str = JOIN_SEPARATOR) -> DataFrame:
    """``edit_sequence`` in the row of ``row_hunks``: edit_sequence and steps_count (0: no part) in the place of its hunks."""
    parts = F.filter("hunks", lambda h: h["v"] != "")
    return hunks.select(*[c for c in hunks.columns if c != "hunks"], _ordered_join(parts, sep).alias("edit_sequence"), F.size(parts).cast("bigint").alias("steps_count"))


def final_code_pick(final_code: Column, initial_code: Column, first_state: Column | None = None) -> Column:
    """``final_code or initial_code or snapshots[0]``."""
    cols = [F.nullif(final_code, F.lit("")), F.nullif(initial_code, F.lit(""))]
    if first_state is not None:
        cols.append(first_state)
    return F.coalesce(*cols)


def edit_records(seqs: DataFrame, summary: DataFrame, key: str = "ok") -> DataFrame:
    """E4 (+F3): {original_line_no, path_id, final_code, edit_sequence, steps_count}.

    Inner join keeps only paths with at least one state change and one part.
    """
    s = summary.where(F.col("total_steps") >= 1)
    return (seqs.where(F.col("steps_count") > 0).join(s, [key, "path_id"])
            .select(F.col(key).alias("original_line_no"), "path_id",
                    final_code_pick(F.col("final_code"), F.col("initial_code")).alias("final_code"),
                    "edit_sequence", "steps_count"))


def row_records(rows: DataFrame, key: str = "ok", keep: Sequence[str] = ()) -> DataFrame:
    """``edit_records`` of rows that hold both a path's sequence and its texts (``paths.summary_columns``), with the further columns ``keep``."""
    return rows.where(F.col("steps_count") > 0).select(
        F.col(key).alias("original_line_no"), "path_id", final_code_pick(F.col("final_code"), F.col("initial_code")).alias("final_code"),
        "edit_sequence", "steps_count", *keep)


def _closed(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(c, F.lit("\n")))


def adjacent_pairs(states: DataFrame, key: str = "ok") -> DataFrame:
    """Forward (prev, curr) pairs, each closed with a trailing newline unless empty.

    ``states`` is (key, path_id, state, code) from B5; forward order is the
    reverse of ``state``.
    """
    w = Window.partitionBy(key, "path_id").orderBy(F.col("state").desc())
    p = states.select(key, "path_id", "state", F.row_number().over(w).cast("bigint").alias("fwd_pos"),
                      F.lag("code").over(w).alias("prev"), F.col("code").alias("curr"))
    return p.where(F.col("fwd_pos") > 1).select(key, "path_id", (F.col("fwd_pos") - 1).alias("fwd"),
                                                _closed(F.col("prev")).alias("prev"), _closed(F.col("curr")).alias("curr"))


def row_adjacent_pairs(rows: DataFrame, cap: int | None = None, key: str = "ok") -> DataFrame:
    """``adjacent_pairs`` of the paths of ``paths.path_rows``; state k follows state k + 1 and is forward step m - k."""
    return row_pairs(rows, cap, key).select(key, "path_id", (F.col("m") - F.col("state")).alias("fwd"),
                                            _closed(F.col("prev")).alias("prev"), _closed(F.col("curr")).alias("curr"))
