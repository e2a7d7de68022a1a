"""Line dependencies and their closure: B3, B4, B7, L7.

B3 stands in for the compile check: a line is invalid when a line it
requires is gone. Rules (pluggable: any ``lines -> (key, ln, req)`` function):

* R1  a block opener and its closer require each other;
* R2  a line inside a block requires the innermost enclosing opener;
* R3  a use of an identifier declared elsewhere requires its first declaration.

Braces and identifiers are read after blanking out string literals. Block
structure comes from a running brace depth (window sum) and an as-of lookup
per nesting level (window ``last(.. ignore nulls)``), so no range join is needed.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
LITERAL_RE = "\"(?:[^\"\\\\]++|\\\\.)*+\"|'(?:[^'\\\\]++|\\\\.)*+'"
IDENT_RE = "[A-Za-z_][A-Za-z0-9_]*"
DECL_RE = ("^\\s*(?:uint[0-9]*|int[0-9]*|string|address|bool|bytes[0-9]*|byte)\\b"
           "(?:\\s+(?:public|private|internal|constant|memory|storage|payable))*\\s+([A-Za-z_][A-Za-z0-9_]*)")
# --------------------------------------------------------------------------------


def _blanked(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(key, "ln", F.regexp_replace("t", LITERAL_RE, "\"\"").alias("bt"))


def _rows(lines: DataFrame, key: str) -> DataFrame:
    """One generated row per (line, block level) and per (line, identifier).

    Block rows: an opener emits one row per level it opens (``kind`` 0); every
    line emits a row for its innermost level and, for a closer, for each level
    it closes (``kind`` 1). Identifier rows: one per distinct identifier of the
    line, flagged when it is the name the line declares.
    Both share the window key ``(key, g)`` with ``g`` = ``L<level>`` or ``N<name>``.
    """
    b = _blanked(lines, key)
    cnt = lambda ch: F.length("bt") - F.length(F.replace(F.col("bt"), F.lit(ch), F.lit("")))
    run = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    b = (b.withColumn("net", cnt("{") - cnt("}"))
         .withColumn("decl", F.regexp_extract("bt", DECL_RE, 1))
         .withColumn("d_after", F.sum("net").over(run))
         # names declared anywhere in the document (same window partition, whole frame)
         .withColumn("declared", F.collect_set(F.nullif("decl", F.lit(""))).over(Window.partitionBy(key)))
         .withColumn("d_before", F.col("d_after") - F.col("net")))
    row = lambda g, kind, flag: F.struct(g.alias("g"), F.lit(kind).alias("kind"), flag.alias("flag"))
    lvl = lambda lv: F.concat(F.lit("L"), lv.cast("string"))
    opens = F.transform(F.sequence(F.col("d_before") + 1, F.greatest(F.col("d_after"), F.col("d_before"))),
                        lambda lv: row(lvl(lv), 0, F.lit(False)))
    opens = F.when(F.col("net") > 0, opens).otherwise(F.array())
    member = F.transform(F.sequence(F.least(F.col("d_after") + 1, F.col("d_before")), F.col("d_before")),
                         lambda lv: row(lvl(lv), 1, lv > F.col("d_after")))
    # only identifiers declared somewhere in the document can produce an edge
    used = F.array_intersect(F.regexp_extract_all("bt", F.lit(IDENT_RE), 0), F.col("declared"))
    idents = F.transform(used,
                         lambda nm: row(F.concat(F.lit("N"), nm), 2, nm == F.col("decl")))
    return b.select(key, "ln", F.explode(F.concat(opens, member, idents)).alias("r")) \
        .select(key, "ln", "r.g", "r.kind", "r.flag")


def line_dependencies(lines: DataFrame, key: str = "ok") -> DataFrame:
    """Distinct requirement edges (key, ln, req) with ``req != ln``.

    One window pass over ``(key, g)`` ordered by line: for block rows the
    as-of opener (``last`` opener at that level up to this row), for
    identifier rows the first declaring line of the name.
    """
    r = _rows(lines, key)
    w = Window.partitionBy(key, "g").orderBy("ln", "kind")
    r = (r.withColumn("o", F.last(F.when(F.col("kind") == 0, F.col("ln")), ignorenulls=True)
                      .over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("first_decl", F.min(F.when((F.col("kind") == 2) & F.col("flag"), F.col("ln")))
                     .over(Window.partitionBy(key, "g"))))
    block_req = F.when((F.col("kind") == 1) & F.col("o").isNotNull(), F.array(
        F.struct(F.col("ln").alias("a"), F.col("o").alias("b")),
        F.when(F.col("flag"), F.struct(F.col("o").alias("a"), F.col("ln").alias("b")))))
    ident_req = F.when((F.col("kind") == 2) & ~F.col("flag") & F.col("first_decl").isNotNull(),
                       F.array(F.struct(F.col("ln").alias("a"), F.col("first_decl").alias("b"))))
    e = r.select(key, F.explode(F.coalesce(block_req, ident_req)).alias("e")) \
        .select(key, F.col("e.a").alias("ln"), F.col("e.b").alias("req"))
    return e.where(F.col("req").isNotNull() & (F.col("ln") != F.col("req"))).distinct()


def _least_reachable(rank, lines, reqs):
    """Per line the least rank among it and all lines that it transitively requires.

    ``lines`` requires ``reqs``, edge by edge (numpy arrays of positions). Only
    lines that a round lowered can lower others in the next one; there is
    no bound on rounds, and each lowers a line for good, so they end.
    """
    value, order = rank.copy(), np.argsort(reqs, kind="stable")
    lines, reqs = lines[order], reqs[order]
    first = np.searchsorted(reqs, np.arange(len(rank) + 1))
    changed = np.unique(reqs)
    while len(changed):
        sizes = first[changed + 1] - first[changed]
        upto = np.cumsum(sizes)
        edge = np.repeat(first[changed] - (upto - sizes), sizes) + np.arange(upto[-1])
        to, new = lines[edge], np.repeat(value[changed], sizes)
        lower = new < value[to]
        to, new = to[lower], new[lower]
        np.minimum.at(value, to, new)
        changed = np.unique(to)
    return value


def _closures(batches):
    """Rows of one document and path each: ranks in line order, and the document's edges."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("ranks")))
        rank = batch.column("ranks").flatten()
        lns, ranks = np.asarray(rank.field("ln")), np.asarray(rank.field("rank"))
        n_edges = np.asarray(pc.fill_null(pc.list_value_length(batch.column("edges")), 0))
        edge = batch.column("edges").flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Lines of all rows have one numbering: found by (row, line number).
        span = max(1, int(lns.max(initial=0)) + 1)
        place = row * span + lns
        order = np.argsort(place, kind="stable")
        spot = lambda f: order[np.searchsorted(place[order], np.repeat(np.arange(len(sizes)), n_edges) * span + np.asarray(edge.field(f)))]
        value = _least_reachable(ranks, spot("ln"), spot("req")) if len(edge) else ranks
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column("path_id").take(at), pa.array(lns), pa.array(value)],
                                         names=["key", "path_id", "ln", "removal"])


def repair_closure(ranks: DataFrame, edges: DataFrame, key: str = "ok") -> DataFrame:
    """``removal = min(rank over the line and everything it transitively requires)``.

    A document is one input record, so its lines and edges are brought to
    one row per path and the fixpoint is found there, in vectorised rounds over
    all rows of an Arrow batch: chains of any length, one shuffle by document,
    no job per round. Returns (key, path_id, ln, removal) for every rank.
    """
    kind = lambda c: ranks.schema[c].dataType.simpleString()
    per_path = ranks.groupBy(key, "path_id").agg(F.collect_list(F.struct(F.col("ln").cast("bigint").alias("ln"), F.col("rank").cast("bigint").alias("rank"))).alias("ranks"))
    per_doc = edges.groupBy(key).agg(F.collect_list(F.struct(F.col("ln").cast("bigint").alias("ln"), F.col("req").cast("bigint").alias("req"))).alias("edges"))
    rows = per_path.join(per_doc, key, "left").select(key, "path_id", "ranks", "edges")
    return (rows.mapInArrow(_closures, f"key {kind(key)}, path_id {kind('path_id')}, ln bigint, removal bigint")
            .withColumnRenamed("key", key))


def document_edges(edges: DataFrame, key: str = "ok") -> DataFrame:
    """(key, edges): one row per document with its (ln, req)."""
    return edges.groupBy(key).agg(F.collect_list(F.struct(F.col("ln").cast("bigint").alias("ln"), F.col("req").cast("bigint").alias("req"))).alias("edges"))


# The same patterns for Arrow's matcher: its ``.`` and ``\\s`` hold other line ends.
_LITERAL_ARROW = "|".join(f"{q}(?:[^{q}\\\\]|\\\\[^\n\r\x85\u2028\u2029])*{q}" for q in "\"'")
_DECL_ARROW = DECL_RE.replace("\\s", "[ \\t\\n\\x0b\\f\\r]").replace("([A-Za-z_]", "(?P<name>[A-Za-z_]")


def _distinct_edges(doc, ln, req):
    order = np.lexsort((req, ln, doc))
    doc, ln, req = doc[order], ln[order], req[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ln[1:] != ln[:-1]) | (req[1:] != req[:-1])
    new &= ln != req
    return doc[new], ln[new], req[new]


def _block_edges(doc, ln, opens, closes, known):
    """(document, line, requirement) from the braces of lines in line order; lines without a text (not ``known``) have no level."""
    net = np.where(known, opens - closes, 0)
    upto = np.cumsum(net)
    start = np.searchsorted(doc, doc)
    after = upto - np.where(start > 0, upto[start - 1], 0)
    before = after - net

    def levels(rows, first, count):
        at = np.repeat(rows, count)
        return at, np.repeat(first, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)

    up, rows = np.flatnonzero(net > 0), np.flatnonzero(known)
    opener, level = levels(up, before[up] + 1, net[up])
    member, inner = levels(rows, np.minimum(after[rows] + 1, before[rows]), np.maximum(1, -net[rows]))
    if not len(opener):
        return (np.zeros(0, np.int64),) * 3
    low, deep = min(level.min(), inner.min()), min(ln.min(), 0)
    group = lambda at, lv: doc[at] * (max(level.max(), inner.max()) - low + 1) + lv - low
    code = lambda g, at: g * (ln.max() - deep + 1) + ln[at] - deep
    g = group(opener, level)
    order = np.argsort(code(g, opener), kind="stable")
    opener, g = opener[order], g[order]
    of = group(member, inner)
    last = np.searchsorted(code(g, opener), code(of, member), side="right") - 1
    found = (last >= 0) & (g[last] == of)
    member, opener = member[found], opener[last[found]]
    closer = net[member] < 0
    return (np.concatenate([doc[member], doc[member[closer]]]), np.concatenate([ln[member], ln[opener[closer]]]),
            np.concatenate([ln[opener], ln[member[closer]]]))


def _name_edges(doc, ln, blanked):
    """(document, line, requirement) from each use of a name to its first declaration."""
    words = pc.replace_substring_regex(pc.replace_substring_regex(blanked, "[^A-Za-z0-9_]+", " "), "(^| )[0-9]+", "\\1")
    words = pc.split_pattern(pc.fill_null(words, ""), " ")
    row = np.repeat(np.arange(len(doc)), np.asarray(pc.list_value_length(words)))
    words = words.flatten().dictionary_encode()
    declared = pc.struct_field(pc.extract_regex(blanked, _DECL_ARROW), "name")
    name = np.asarray(pc.fill_null(pc.index_in(declared, words.dictionary), -1)).astype(np.int64)
    lines, n = np.flatnonzero(name >= 0), max(1, len(words.dictionary))
    if not len(lines):
        return (np.zeros(0, np.int64),) * 3
    known, first = np.unique(doc[lines] * n + name[lines], return_index=True)
    word = np.asarray(words.indices).astype(np.int64)
    want = doc[row] * n + word
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    uses = (known[at] == want) & (name[row] != word)
    row = row[uses]
    return doc[row], ln[row], ln[lines[first[at[uses]]]]


def document_dependencies(n_lines, ln, texts):
    """``line_dependencies`` in the rows of documents, for all lines of an Arrow batch at once: numbers of edges of each document, lines and requirements.

    ``n_lines`` counts the lines of each document, ``ln`` and ``texts`` are those lines in line order.
    """
    blanked = pc.replace_substring_regex(texts, _LITERAL_ARROW, '""')
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    count = lambda ch: np.asarray(pc.fill_null(pc.count_substring(blanked, ch), 0)).astype(np.int64)
    known = np.asarray(pc.is_valid(blanked))
    parts = [_block_edges(doc, ln, count("{"), count("}"), known), _name_edges(doc, ln, blanked)] if len(ln) else [(doc,) * 3]
    of, lines, reqs = _distinct_edges(*(np.concatenate(x) for x in zip(*parts)))
    return np.bincount(of, minlength=len(n_lines)), lines, reqs


def _ranks(seeds, header, row, ln):
    """B2: the place of each line in its path's order, by the md5 of ``seed:line``, the first header last (``paths.deletion_order``)."""
    digests = b"".join([md5(b"%d:%d" % at).digest() for at in zip(seeds[row].tolist(), ln.tolist())])
    high, low = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.lexsort((ln, low, high, header, row))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(1, len(row) + 1)
    return rank - np.searchsorted(row, row)


def document_arrays(batch):
    """Numbers of an Arrow batch of documents (``lines``, ``seeds``, ``header``, ``edges``), one row per path.

    (documents' path counts, path ids, path sizes, row, ln, rank in line order, and row, line and requirement of each edge as positions;
    edges with a line that is not there are void.) Without ``edges`` they are those of ``line_dependencies``.
    """
    n_paths = np.asarray(pc.list_value_length(batch.column("seeds"))).astype(np.int64)
    n_lines = np.asarray(pc.list_value_length(batch.column("lines"))).astype(np.int64)
    paths, line = batch.column("seeds").flatten(), batch.column("lines").flatten()
    numbers = np.asarray(line.field("ln")).astype(np.int64)
    # The lines of a document for each of its paths.
    doc = np.repeat(np.arange(len(n_paths)), n_paths)
    sizes = n_lines[doc]
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.repeat((np.cumsum(n_lines) - n_lines)[doc] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    ln = numbers[at]
    header = batch.column("header")
    headed = np.asarray(pc.is_valid(header))[doc][row] & (np.asarray(pc.fill_null(header, 0))[doc][row] == ln)
    rank = _ranks(np.asarray(paths.field("seed")), headed, row, ln)
    if "edges" in batch.schema.names:
        n_edges = np.asarray(pc.fill_null(pc.list_value_length(batch.column("edges")), 0)).astype(np.int64)
        edge = batch.column("edges").flatten()
        edge_ln, edge_req = np.asarray(edge.field("ln")), np.asarray(edge.field("req"))
    else:
        n_edges, edge_ln, edge_req = document_dependencies(n_lines, numbers, line.field("t"))
    # The edges of a document for each of its paths.
    per_path = n_edges[doc]
    at = np.repeat((np.cumsum(n_edges) - n_edges)[doc] - (np.cumsum(per_path) - per_path), per_path) + np.arange(per_path.sum())
    edge_row = np.repeat(np.arange(len(sizes)), per_path)
    # Lines of all rows have one numbering: found by (row, line number).
    low = int(ln.min(initial=0))
    span = max(1, int(ln.max(initial=0)) - low + 1)
    place = row * span + (ln - low)

    def spot(values):
        found = values[at] - low
        want = np.where((found >= 0) & (found < span), edge_row * span + found, -1)
        s = np.minimum(np.searchsorted(place, want), max(0, len(place) - 1))
        return s, place[s] == want

    if len(at):
        (lines, here), (reqs, there) = spot(edge_ln), spot(edge_req)
        both = here & there
        lines, reqs = lines[both], reqs[both]
    else:
        lines = reqs = np.zeros(0, np.int64)
    return n_paths, paths.field("path_id"), sizes, row, ln, rank, lines, reqs


def _kept_columns(names, key: str) -> list[str]:
    """Columns of documents that repair hands on as they are."""
    return [c for c in names if c not in (key, "lines", "seeds", "header", "edges")]


def built_documents(batch, n_paths, path_ids, sizes, removal, step, total):
    """The Arrow batch with ``paths`` (path_id, total_steps, removal, step) in the place of what they are made from; other columns stay."""
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
    path = pa.StructArray.from_arrays([path_ids, pa.array(total, pa.int64()), lists(sizes, pa.array(removal, pa.int64())), lists(sizes, pa.array(step, pa.int64()))],
                                      names=["path_id", "total_steps", "removal", "step"])
    kept = _kept_columns(batch.schema.names, batch.schema.names[0])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column("lines"), lists(n_paths, path), *(batch.column(c) for c in kept)], names=["key", "lines", "paths", *kept])


def close_documents(batches):
    """``document_repair`` of the Arrow batches of a task."""
    for batch in batches:
        n_paths, path_ids, sizes, row, _, rank, lines, reqs = document_arrays(batch)
        removal = _least_reachable(rank, lines, reqs) if len(lines) else rank
        # Dense rank of the removals of a path.
        order = np.lexsort((removal, row))
        r, v = row[order], removal[order]
        new_row = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
        count = np.cumsum(new_row | np.concatenate([[True], v[1:] != v[:-1]]) if len(r) else new_row)
        first = count[new_row]
        step = np.empty_like(removal)
        step[order] = count - first[r] + 1 if len(r) else count
        total = np.maximum.reduceat(step, np.cumsum(sizes) - sizes) if len(step) else np.zeros(0, np.int64)
        yield built_documents(batch, n_paths, path_ids, sizes, removal, step, total)


def document_schema(docs: DataFrame, key: str) -> str:
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in _kept_columns(docs.columns, key))
    return (f"key {docs.schema[key].dataType.simpleString()}, lines {docs.schema['lines'].dataType.simpleString()}, "
            f"paths array<struct<path_id: int, total_steps: bigint, removal: array<bigint>, step: array<bigint>>>{kept}")


def document_repair(docs: DataFrame, key: str = "ok") -> DataFrame:
    """B2, B4 and its steps on whole documents (key, lines, seeds, header, edges): ``paths.deletion_order``, ``repair_closure`` and
    ``paths.steps_from_removal`` in the row of the document -> (key, lines, paths). No shuffle. Without ``edges``, B3 as well."""
    return docs.mapInArrow(close_documents, document_schema(docs, key)).withColumnRenamed("key", key)


def repair_by_error_lines(lines: DataFrame, errors: DataFrame, key: str = "ok") -> DataFrame:
    """One bulk repair round.

    Delete every reported line (numbers outside ``1..n`` ignored); a document
    with errors but nothing deletable drops its last line. Survivors are
    renumbered: (key, ln, old_ln, t).
    """
    errs = errors.select(key, "ln").distinct()
    hit = lines.select(key, "ln").join(errs, [key, "ln"], "left_semi") \
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_hit"))
    erring = errs.select(key).distinct().join(hit, key, "left")
    last = (lines.groupBy(key).agg(F.max("ln").alias("ln"))
            .join(erring.where(F.col("n_hit").isNull()), key, "left_semi"))
    doomed = errs.unionByName(last)
    kept = lines.join(doomed, [key, "ln"], "left_anti")
    w = Window.partitionBy(key).orderBy("ln")
    return kept.select(key, F.row_number().over(w).cast("bigint").alias("ln"), F.col("ln").alias("old_ln"), "t")


#: Lines of documents whose states are worked out at once.
PIECE_LINES = 1 << 17


def _pieces(batch):
    """Slices of an Arrow batch of documents with about ``PIECE_LINES`` lines, one document at least."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column("lines")), 0)).astype(np.int64))
    at = 0
    while at < len(upto):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_LINES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _state_counts(batch, cap: int | None):
    """``snapshot_validity`` of an Arrow batch of documents (``lines``, ``paths`` and, where the rule is one's own, ``edges``)."""
    n_paths = np.asarray(pc.list_value_length(batch.column("paths"))).astype(np.int64)
    n_lines = np.asarray(pc.list_value_length(batch.column("lines"))).astype(np.int64)
    paths, line = batch.column("paths").flatten(), batch.column("lines").flatten()
    numbers, step = np.asarray(line.field("ln")).astype(np.int64), np.asarray(pc.list_flatten(paths.field("step"))).astype(np.int64)
    doc = np.repeat(np.arange(len(n_paths)), n_paths)
    sizes, m = n_lines[doc], np.asarray(paths.field("total_steps")).astype(np.int64)
    m = m if cap is None else np.minimum(m, cap)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ln = numbers[np.repeat((np.cumsum(n_lines) - n_lines)[doc] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    if "edges" in batch.schema.names:
        n_edges = np.asarray(pc.fill_null(pc.list_value_length(batch.column("edges")), 0)).astype(np.int64)
        edge = batch.column("edges").flatten()
        edge_ln, edge_req = np.asarray(edge.field("ln")), np.asarray(edge.field("req"))
    else:
        n_edges, edge_ln, edge_req = document_dependencies(n_lines, numbers, line.field("t"))
    # One place per path and line number (those of repeated documents stand several times), and its steps in order.
    low = int(ln.min(initial=0))
    span = max(1, int(ln.max(initial=0)) - low + 1)
    place = row * span + (ln - low)
    order = np.lexsort((step, place))
    known, first, of = np.unique(place[order], return_index=True, return_inverse=True)
    step, row = step[order], row[order]
    # The edges of a document for each of its paths; those with a line that is not there are void.
    per_path = n_edges[doc]
    at = np.repeat((np.cumsum(n_edges) - n_edges)[doc] - (np.cumsum(per_path) - per_path), per_path) + np.arange(per_path.sum())
    edge_row = np.repeat(np.arange(len(sizes)), per_path)

    def spot(values):
        found = values[at] - low
        want = np.where((found >= 0) & (found < span), edge_row * span + found, -1)
        s = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
        return s, known[s] == want

    never = np.iinfo(np.int64).max
    since = np.full(len(known), never)
    if len(at) and len(known):
        (lines, here), (reqs, there) = spot(edge_ln), spot(edge_req)
        both = here & there
        np.minimum.at(since, lines[both], step[first[reqs[both]]])
    # A line's bad states run from its first lost requirement to its last state; lines of one number and step are one.
    least = np.minimum(step, m[row] + 1)
    new = np.ones(len(step), bool)
    new[1:] = (of[1:] != of[:-1]) | (step[1:] != step[:-1])
    bad = new & (since[of] < least)
    begin = np.cumsum(m + 1) - (m + 1)  # of a path's states
    n_states, d = int((m + 1).sum()), np.zeros(int((m + 1).sum()), np.int64)
    for states, sign in ((since[of[bad]], 1), (least[bad], -1)):
        inside = (states >= 0) & (states <= m[row[bad]])
        d += sign * np.bincount(begin[row[bad][inside]] + states[inside], minlength=n_states)
    goes = (step >= 0) & (step <= m[row])
    gone = np.bincount(begin[row[goes]] + step[goes], minlength=n_states)
    path = np.repeat(np.arange(len(m)), m + 1)
    running = lambda x: np.cumsum(x) - (np.cumsum(x) - x)[begin][path]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(doc[path])), paths.field("path_id").take(pa.array(path)), pa.array(np.arange(n_states) - begin[path]),
         pa.array(sizes[path] - running(gone)), pa.array(running(d))], names=["key", "path_id", "state", "n_lines", "violations"])


def document_validity(documents: DataFrame, edges: DataFrame | None = None, cap: int | None = None, key: str = "ok") -> DataFrame:
    """``snapshot_validity`` in the row of built documents (key, lines, paths), without a shuffle of steps or edges.

    Without ``edges`` they are those of ``line_dependencies``, worked out in the row as well; others are brought to it by document."""
    rows = documents.select(key, "lines", "paths").where(F.size("paths") > 0)
    if edges is not None:
        rows = rows.join(document_edges(edges, key).hint("merge"), key, "left").select(key, "lines", "paths", "edges")

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch):
                yield _state_counts(piece, cap)

    return (rows.mapInArrow(run, f"key {documents.schema[key].dataType.simpleString()}, path_id int, state bigint, n_lines bigint, violations bigint")
            .withColumnRenamed("key", key))


def snapshot_validity(steps: DataFrame, edges: DataFrame | None, cap: int | None = None, key: str = "ok") -> DataFrame:
    """Per recorded state, number of lines and of lines whose requirement is gone.

    A line in state k (``step > k``) violates when some ``req`` has ``step <= k``;
    that is ``k`` in ``[step(req), step(line))``. Expected 0 for every state
    (a self-check of B4); state 0 is the input itself.

    ``steps`` is a table of steps from any source, or built documents (key, lines, paths): then states are worked out in
    their rows, and ``edges`` may be None for those of ``line_dependencies`` (``document_validity``).
    """
    if "paths" in steps.columns:
        return document_validity(steps, edges, cap, key)
    s = steps.withColumn("m", F.col("total_steps") if cap is None else F.least("total_steps", F.lit(cap)))
    req = s.select(key, "path_id", F.col("ln").alias("req"), F.col("step").alias("req_step"))
    # One interval of bad states per line, from its first lost requirement on.
    # Files of steps are far smaller than their rows: they are not to be broadcast.
    bad = (edges.join(s.select(key, "path_id", "ln", "step", "m").hint("merge"), [key, "ln"]).join(req.hint("merge"), [key, "path_id", "req"])
           .where(F.col("req_step") < F.least(F.col("step"), F.col("m") + 1))
           .groupBy(key, "path_id", "ln", "step", "m").agg(F.min("req_step").alias("since")))
    # Bad states run from that one to the line's last: one more at the first, one less behind the last, and a running sum over states.
    change = lambda at, d: bad.select(key, "path_id", F.least(at, F.col("m") + 1).alias("state"), F.lit(d).alias("d"))
    change = change(F.col("since"), 1).union(change(F.col("step"), -1)).groupBy(key, "path_id", "state").agg(F.sum("d").alias("d"))
    # Lines left in a state: all but those of the steps up to it.
    gone = s.groupBy(key, "path_id", F.col("step").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    totals = s.groupBy(key, "path_id").agg(F.max("m").alias("m"), F.count(F.lit(1)).alias("total"))
    states = totals.select(key, "path_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("state"))
    run = Window.partitionBy(key, "path_id").orderBy("state").rowsBetween(Window.unboundedPreceding, 0)
    sized = (states.join(gone.hint("merge"), [key, "path_id", "state"], "left")
             .join(change.hint("merge"), [key, "path_id", "state"], "left"))
    return sized.select(key, "path_id", "state", (F.col("total") - F.sum(F.coalesce("n", F.lit(0))).over(run)).cast("bigint").alias("n_lines"),
                        F.sum(F.coalesce("d", F.lit(0))).over(run).cast("bigint").alias("violations"))
