"""DuckDB side of the query registry: an independent SQL spelling of each query.

Fixture views come from ``oracle_fixtures``; the deletion-path closure uses a
recursive CTE (reachability) instead of the Spark fixpoint loop, and hunks use
``pos - row_number()`` islands instead of the Spark running-sum form.
"""

from __future__ import annotations

from .oracle_fixtures import cte, sqlstr, with_ctes

CAP = 1 << 40   # no cap
CAP_SMALL = 5

WS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEADER_RE = "^" + WS + "*pragma solidity"
LITERAL_RE = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
IDENT_RE = "[A-Za-z_][A-Za-z0-9_]*"
DECL_RE = (r"^\s*(?:uint[0-9]*|int[0-9]*|string|address|bool|bytes[0-9]*|byte)\b"
           r"(?:\s+(?:public|private|internal|constant|memory|storage|payable))*\s+([A-Za-z_][A-Za-z0-9_]*)")

cte("docs_ok", ["clean_lines"], "SELECT ok, count(*) AS n_lines FROM clean_lines GROUP BY ok HAVING count(*) >= 6")
cte("lines_ok", ["clean_lines", "docs_ok"], "SELECT ok, ln, t FROM clean_lines WHERE ok IN (SELECT ok FROM docs_ok)")
cte("paths", ["docs_ok"], """
  SELECT ok, CAST(p AS BIGINT) AS path_id, 42 + ok * 1000 + p AS seed FROM docs_ok, range(0, 3) r(p)""")
cte("ranks", ["lines_ok", "paths"], f"""
  SELECT m.ok, p.path_id, m.ln,
         row_number() OVER (PARTITION BY m.ok, p.path_id
                            ORDER BY coalesce(m.ln = m.hdr_ln, false), md5(p.seed || ':' || m.ln), m.ln) AS rank
  FROM (SELECT ok, ln, min(CASE WHEN regexp_matches(t, {sqlstr(HEADER_RE)}) THEN ln END)
                       OVER (PARTITION BY ok) AS hdr_ln FROM lines_ok) m
  JOIN paths p ON p.ok = m.ok""")
cte("blanked", ["lines_ok"], f"""
  SELECT ok, ln, regexp_replace(t, {sqlstr(LITERAL_RE)}, '""', 'g') AS bt FROM lines_ok""")
cte("depth", ["blanked"], """
  SELECT *, d_after - net AS d_before FROM (
    SELECT *, CAST(sum(net) OVER (PARTITION BY ok ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS d_after
    FROM (SELECT ok, ln, bt, (length(bt) - length(replace(bt, '{', ''))) - (length(bt) - length(replace(bt, '}', '')))
                 AS net FROM blanked))""")
cte("block_rows", ["depth"], """
  SELECT ok, lvl AS level, ln, ln AS open_ln, 0 AS kind, false AS closes
  FROM depth, range(d_before + 1, d_after + 1) r(lvl) WHERE net > 0
  UNION ALL
  SELECT ok, lvl, ln, NULL, 1, lvl > d_after
  FROM depth, range(least(d_after + 1, d_before), d_before + 1) r(lvl)""")
cte("block_found", ["block_rows"], """
  SELECT * FROM (
    SELECT *, last_value(open_ln IGNORE NULLS) OVER (PARTITION BY ok, level ORDER BY ln, kind
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM block_rows)
  WHERE kind = 1 AND o IS NOT NULL""")
cte("ident_decl", ["blanked"], f"""
  SELECT ok, ln, bt, regexp_extract(bt, {sqlstr(DECL_RE)}, 1) AS decl FROM blanked""")
cte("ident_edges", ["ident_decl"], f"""
  SELECT u.ok, u.ln, d.req FROM
    (SELECT DISTINCT ok, ln, decl, unnest(regexp_extract_all(bt, {sqlstr(IDENT_RE)})) AS name FROM ident_decl) u
  JOIN (SELECT ok, decl AS name, min(ln) AS req FROM ident_decl WHERE decl <> '' GROUP BY ok, decl) d
    ON d.ok = u.ok AND d.name = u.name
  WHERE u.name <> u.decl AND d.req <> u.ln""")
cte("edges", ["block_found", "ident_edges"], """
  SELECT DISTINCT ok, ln, req FROM (
    SELECT ok, ln, o AS req FROM block_found
    UNION ALL SELECT ok, o, ln FROM block_found WHERE closes
    UNION ALL SELECT ok, ln, req FROM ident_edges) WHERE ln <> req""")
cte("reach", ["edges"], """
  SELECT ok, ln, req FROM edges
  UNION
  SELECT r.ok, r.ln, e.req FROM reach r JOIN edges e ON e.ok = r.ok AND e.ln = r.req""")
cte("removal", ["ranks", "reach"], """
  SELECT k.ok, k.path_id, k.ln, least(k.rank, coalesce(min(r2.rank), k.rank)) AS removal
  FROM ranks k
  LEFT JOIN reach r ON r.ok = k.ok AND r.ln = k.ln
  LEFT JOIN ranks r2 ON r2.ok = r.ok AND r2.path_id = k.path_id AND r2.ln = r.req
  GROUP BY k.ok, k.path_id, k.ln, k.rank""")
cte("steps", ["removal"], """
  SELECT *, max(step) OVER (PARTITION BY ok, path_id) AS total_steps FROM (
    SELECT *, dense_rank() OVER (PARTITION BY ok, path_id ORDER BY removal) AS step FROM removal)""")


def _capped(cap):
    return f"SELECT *, least(total_steps, {cap}) AS m FROM steps"


def _summary(cap):
    return f"""
  SELECT s.ok, s.path_id, max(s.m) AS total_steps,
         string_agg(l.t, chr(10) ORDER BY l.ln) AS initial_code,
         coalesce(string_agg(l.t, chr(10) ORDER BY l.ln) FILTER (WHERE s.step > s.m), '') AS final_code
  FROM ({_capped(cap)}) s JOIN lines_ok l ON l.ok = s.ok AND l.ln = s.ln
  GROUP BY s.ok, s.path_id"""


def _rng(s, n):
    return (f"CASE WHEN {n} = 1 THEN CAST({s} + 1 AS VARCHAR) WHEN {n} = 0 THEN {s} || ',0' "
            f"ELSE ({s} + 1) || ',' || {n} END")


def _diffs(cap):
    return f"""
  WITH x AS (
    SELECT s.ok, s.path_id, s.ln, j AS fwd, CASE WHEN s.step = s.m - j + 1 THEN 1 ELSE 0 END AS added
    FROM ({_capped(cap)}) s, range(greatest(1, s.m - s.step + 1), s.m + 1) r(j) WHERE s.m >= 1),
  xw AS (
    SELECT *, row_number() OVER (PARTITION BY ok, path_id, fwd ORDER BY ln) AS pos,
           max(added) OVER (PARTITION BY ok, path_id, fwd ORDER BY ln ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near,
           coalesce(CAST(sum(added) OVER (PARTITION BY ok, path_id, fwd ORDER BY ln
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS added_before
    FROM x),
  shown AS (
    SELECT *, pos - 1 - added_before AS old_idx,
           pos - row_number() OVER (PARTITION BY ok, path_id, fwd ORDER BY ln) AS grp
    FROM xw WHERE near = 1),
  hunks AS (
    SELECT h.ok, h.path_id, h.fwd, h.grp,
           '@@ -' || {_rng('i1', 'n_old')} || ' +' || {_rng('p0 - 1', 'n_new')} || ' @@' || chr(10) || body AS h
    FROM (SELECT s.ok, s.path_id, s.fwd, s.grp, min(s.pos) AS p0, count(*) AS n_new, sum(1 - s.added) AS n_old,
                 arg_min(s.old_idx, s.pos) AS i1,
                 string_agg(CASE WHEN s.added = 1 THEN '+' ELSE ' ' END || l.t, chr(10) ORDER BY s.pos) AS body
          FROM shown s JOIN lines_ok l ON l.ok = s.ok AND l.ln = s.ln
          GROUP BY s.ok, s.path_id, s.fwd, s.grp) h)
  SELECT ok, path_id, fwd, string_agg(h, chr(10) ORDER BY grp) AS diff FROM hunks GROUP BY ok, path_id, fwd"""


def _seqs(cap, sep="chr(10)"):
    return f"""
  SELECT ok, path_id, string_agg(diff, {sep} ORDER BY fwd) AS edit_sequence, count(*) AS steps_count
  FROM ({_diffs(cap)}) WHERE diff <> '' GROUP BY ok, path_id"""


def _records(cap, sep="chr(10)"):
    return f"""
  SELECT q.ok AS original_line_no, q.path_id,
         coalesce(nullif(m.final_code, ''), nullif(m.initial_code, '')) AS final_code,
         q.edit_sequence, q.steps_count
  FROM ({_seqs(cap, sep)}) q JOIN ({_summary(cap)}) m ON m.ok = q.ok AND m.path_id = q.path_id
  WHERE q.steps_count > 0 AND m.total_steps >= 1"""


def _q(names, body, recursive=False):
    sql = with_ctes(names, body)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else sql


ORACLE = {
    "min_lines": _q(["docs_ok"], "SELECT ok, n_lines FROM docs_ok"),
    "path_fanout": _q(["paths"], "SELECT ok, path_id, seed FROM paths"),
    "deletion_order": _q(["ranks"], "SELECT ok, path_id, ln, rank FROM ranks"),
    "line_dependencies": _q(["edges"], "SELECT ok, ln, req FROM edges"),
    "repair_closure": _q(["steps"], "SELECT ok, path_id, ln, removal, step FROM steps", True),
    "snapshots": _q(["steps", "lines_ok"], f"""
  SELECT st.ok, st.path_id, st.state,
         coalesce(string_agg(l.t, chr(10) ORDER BY l.ln) FILTER (WHERE s.ln IS NOT NULL), '') AS code
  FROM (SELECT DISTINCT ok, path_id, CAST(k AS BIGINT) AS state FROM ({_capped(CAP)}), range(0, m + 1) r(k)) st
  LEFT JOIN ({_capped(CAP)}) s ON s.ok = st.ok AND s.path_id = st.path_id AND s.step > st.state
  LEFT JOIN lines_ok l ON l.ok = s.ok AND l.ln = s.ln
  GROUP BY st.ok, st.path_id, st.state""", True),
    "step_cap": _q(["steps", "lines_ok"], f"SELECT ok, path_id, total_steps, final_code FROM ({_summary(CAP_SMALL)})",
                   True),
    "path_lengths": _q(["steps"], f"SELECT ok, path_id, max(m) AS total_steps FROM ({_capped(CAP)}) GROUP BY ok, path_id",
                       True),
    "path_diversity": _q(["steps"], f"""
  SELECT ok, CASE WHEN count(DISTINCT total_steps) > 1 THEN 'steps_differ'
                  WHEN count(DISTINCT fp) > 1 THEN 'states_differ' ELSE 'identical' END AS verdict
  FROM (SELECT ok, path_id, max(least(total_steps, {CAP})) AS total_steps,
               md5(string_agg(ln || ':' || least(step, {CAP} + 1), ',' ORDER BY ln)) AS fp FROM steps GROUP BY ok, path_id)
  GROUP BY ok""", True),
    "diff_hunks": _q(["steps", "lines_ok"], f"SELECT ok, path_id, fwd, diff FROM ({_diffs(CAP)})", True),
    "edit_sequence": _q(["steps", "lines_ok"], f"SELECT ok, path_id, edit_sequence, steps_count FROM ({_seqs(CAP)})",
                        True),
    "edit_records": _q(["steps", "lines_ok"], f"SELECT * FROM ({_records(CAP)})", True),
}


# ---------------------------------------------------------------- merge / clean
from .oracle_fixtures import normalise, strip, strip_comments, splitlines  # noqa: E402


def _js(f):
    return f"json_extract_string(raw, '$.{f}')"


cte("parsed", ["raw_lines"], f"""
  SELECT file_ord, line_no, raw,
         CASE WHEN {strip('raw')} = '' THEN 'blank'
              WHEN NOT json_valid(raw) THEN 'bad_json'
              WHEN NOT starts_with({strip('raw')}, '{{') THEN 'not_object'
              ELSE 'ok' END AS status
  FROM raw_lines""")
cte("recs", ["parsed"], f"""
  SELECT file_ord, line_no, raw, {_js('contract_address')} AS contract_address, {_js('func_name')} AS func_name,
         {_js('file_path')} AS file_path, {_js('class_code')} AS class_code, {_js('func_code')} AS func_code,
         {_js('contract')} AS contract
  FROM parsed WHERE status = 'ok'""")
cte("keyed", ["recs"], f"""
  SELECT *, CASE WHEN addr <> '' AND fn <> '' THEN 'addr:' || addr || '::fn:' || fn
                 WHEN fp <> '' AND fn <> '' THEN 'file:' || fp || '::fn:' || fn
                 ELSE 'codehash:' || sha256({strip("replace(coalesce(nullif(class_code, ''), nullif(func_code, ''), ''), chr(13) || chr(10), chr(10))")})
            END AS key
  FROM (SELECT *, lower({strip("coalesce(contract_address, '')")}) AS addr, {strip("coalesce(func_name, '')")} AS fn,
               {strip("coalesce(file_path, '')")} AS fp FROM recs)""")
cte("merged_first", ["keyed"], """
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_ord, line_no) AS rn
                              FROM keyed) WHERE rn = 1""")
cte("merged_last", ["keyed"], """
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_ord DESC, line_no DESC)
                              AS rn FROM keyed) WHERE rn = 1""")
_VER = "(\\d+\\.\\d+\\.\\d+)"
cte("cleaned", ["merged_first"], f"""
  SELECT file_ord, line_no,
         CASE WHEN code = '' OR body = '' THEN ''
              WHEN contains(lower(body), 'pragma solidity') THEN body
              ELSE 'pragma solidity ^' || coalesce(nullif(regexp_extract(raw_ver, {sqlstr(_VER)}, 1), ''), '0.4.0')
                   || ';' || chr(10) || body END AS contract,
         CASE WHEN code = '' THEN 'no_code' WHEN body = '' THEN 'empty_after_clean' ELSE 'ok' END AS reason
  FROM (SELECT *, {normalise(strip_comments('code'))} AS body FROM (
          SELECT file_ord, line_no, coalesce(nullif(class_code, ''), nullif(contract, ''), '') AS code,
                 coalesce(nullif({_js('compiler_version')}, ''), nullif({_js('original_meta.version')}, ''),
                          nullif({_js('version')}, ''), '') AS raw_ver
          FROM merged_first))""")
cte("dedup", ["cleaned"], """
  SELECT contract, arg_min(file_ord, (file_ord, line_no)) AS file_ord, arg_min(line_no, (file_ord, line_no)) AS line_no
  FROM cleaned WHERE reason = 'ok' GROUP BY contract""")

_RAW_VER = "coalesce(nullif(compiler_version, ''), nullif(original_version, ''), nullif(version, ''), '')"
_REC = "key, file_ord, line_no, contract_address, func_name, file_path, class_code"

ORACLE.update({
    "bad_record_route": _q(["parsed"], "SELECT file_ord, line_no, status AS reason FROM parsed "
                                       "WHERE status IN ('bad_json', 'not_object')"),
    "reject_examples": _q(["parsed"], "SELECT file_ord || ':' || line_no AS loc FROM parsed "
                                      "WHERE status IN ('bad_json', 'not_object') ORDER BY file_ord, line_no LIMIT 20"),
    "code_field_coalesce": _q(["recs"], "SELECT file_ord, line_no, coalesce(nullif(class_code, ''), "
                                        "nullif(contract, ''), '') AS code FROM recs"),
    "version_field_fallback": _q(["meta_records"], f"SELECT id, {_RAW_VER} AS raw_ver FROM meta_records"),
    "extract_version": _q(["meta_records"], f"SELECT id, nullif(regexp_extract({_RAW_VER}, {sqlstr(_VER)}, 1), '') "
                                            "AS version FROM meta_records"),
    "strip_comments": _q(["code_docs"], f"SELECT ok, {strip_comments('code')} AS code FROM code_docs"),
    "normalise_lines": _q(["clean_docs"], "SELECT ok, code FROM clean_docs"),
    "ensure_header": _q(["meta_records"], f"""
  SELECT id, CASE WHEN body = '' THEN ''
                  WHEN contains(lower(body), 'pragma solidity') THEN body
                  ELSE 'pragma solidity ^' || coalesce(nullif(regexp_extract({_RAW_VER}, {sqlstr(_VER)}, 1), ''),
                                                       '0.4.0') || ';' || chr(10) || body END AS contract
  FROM (SELECT *, {normalise(strip_comments('code'))} AS body FROM meta_records)"""),
    "code_hash": _q(["raw_records"], f"""
  SELECT file_ord, line_no, sha256({strip("replace(class_code, chr(13) || chr(10), chr(10))")}) AS code_hash
  FROM raw_records"""),
    "stable_key": _q(["raw_records"], f"""
  SELECT file_ord, line_no,
         CASE WHEN addr <> '' AND fn <> '' THEN 'addr:' || addr || '::fn:' || fn
              WHEN fp <> '' AND fn <> '' THEN 'file:' || fp || '::fn:' || fn
              ELSE 'codehash:' || sha256({strip("replace(coalesce(class_code, ''), chr(13) || chr(10), chr(10))")})
         END AS key
  FROM (SELECT *, lower({strip("coalesce(contract_address, '')")}) AS addr, {strip("coalesce(func_name, '')")} AS fn,
               {strip("coalesce(file_path, '')")} AS fp FROM raw_records)"""),
    "split_lines": f"""
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, ({splitlines('text')})[i] AS line
  FROM documents, range(1, len({splitlines('text')}) + 1) r(i)""",
    "merge_keep_first": _q(["merged_first"], f"SELECT {_REC} FROM merged_first"),
    "merge_keep_last": _q(["merged_last"], f"SELECT {_REC} FROM merged_last"),
    "drop_empty": _q(["cleaned"], "SELECT file_ord, line_no FROM cleaned WHERE reason = 'ok'"),
    "content_dedup": _q(["dedup"], "SELECT contract, file_ord, line_no FROM dedup"),
    "merge_report": _q(["parsed", "keyed"], """
  SELECT (SELECT count(DISTINCT file_ord) FROM parsed) AS files,
         (SELECT count(*) FROM parsed) AS lines,
         (SELECT count(*) FROM parsed WHERE status = 'ok') AS records_in,
         (SELECT count(*) FROM parsed WHERE status = 'bad_json') AS bad_json,
         (SELECT count(*) FROM parsed WHERE status = 'not_object') AS not_object,
         (SELECT count(DISTINCT key) FROM keyed) AS records_out,
         (SELECT count(*) FROM parsed WHERE status = 'ok') - (SELECT count(DISTINCT key) FROM keyed) AS dups"""),
    "clean_report": _q(["cleaned"], """
  SELECT count(DISTINCT contract) FILTER (WHERE reason = 'ok') AS kept,
         count(*) FILTER (WHERE reason = 'ok') - count(DISTINCT contract) FILTER (WHERE reason = 'ok') AS duplicates,
         count(*) FILTER (WHERE reason <> 'ok') AS rejected
  FROM cleaned"""),
    "clean_corpus": _q(["dedup"], "SELECT contract FROM dedup"),
})


# ---------------------------------------------------------------- diagnostics / versions
cte("diag_x", ["diagnostics"], f"""
  SELECT doc, pos, starts_with(s, 'Error:') AS hdr,
         CAST(nullif(regexp_extract(s, '^--> \\S+:(\\d+):\\d+:', 1), '') AS BIGINT) AS loc,
         CAST(nullif(regexp_extract(s, ':(\\d+):\\d+: Error:', 1), '') AS BIGINT) AS inl
  FROM (SELECT doc, pos, {strip('t')} AS s FROM diagnostics)""")
cte("l1", ["diag_x"], """
  SELECT doc, pos, hdr, CASE WHEN hdr THEN ahead ELSE inl END AS line_no FROM (
    SELECT *, first_value(loc IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos
                ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM diag_x)
  WHERE hdr OR inl IS NOT NULL""")
cte("doc_lines", ["clean_lines", "diagnostics"], """
  SELECT ok AS doc, ln, t FROM clean_lines WHERE ok IN (SELECT doc FROM diagnostics)""")
cte("l2", ["l1", "clean_lines"], """
  SELECT DISTINCT doc, line_no FROM (
    SELECT e.doc, CASE WHEN e.line_no IS NOT NULL THEN e.line_no
                       WHEN c.n_lines > 0 THEN 1 + (('0x' || substr(md5(e.doc || ':' || e.pos), 1, 8))::BIGINT % c.n_lines)
                  END AS line_no
    FROM l1 e LEFT JOIN (SELECT ok AS doc, count(*) AS n_lines FROM clean_lines GROUP BY ok) c ON c.doc = e.doc)
  WHERE line_no IS NOT NULL""")


def _bounds_sql(compat):
    src = "expr" if compat else "regexp_replace(expr, '(>=|<=|>|<|=|\\^)\\s+', '\\1', 'g')"
    lower_ops = "('>=', '>')" if compat else "('=', '>=', '>')"
    # A caret's version has one to three parts; missing ones are 0. What else follows a caret is no version.
    caret, bare, op = r"^\^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?$", r"^(\d+)\.(\d+)\.(\d+)$", r"^(>=|<=|>|<|=)\s*(\d+)\.(\d+)\.(\d+)"
    g = lambda pat, i: f"CAST(coalesce(nullif(regexp_extract(tok, {sqlstr(pat)}, {i}), ''), '0') AS INTEGER)"
    return f"""
  WITH every_tok AS (
    SELECT expr, CAST(i - 1 AS BIGINT) AS tok_no, arr[i] AS tok
    FROM (SELECT expr, regexp_split_to_array({strip(src)}, '\\s+') AS arr
          FROM (SELECT DISTINCT expr FROM pragma_exprs WHERE expr IS NOT NULL)), range(1, len(arr) + 1) r(i)),
  toks AS (SELECT * FROM every_tok WHERE expr NOT IN (
    SELECT expr FROM every_tok WHERE starts_with(tok, '^') AND NOT regexp_matches(tok, {sqlstr(caret)})))
  SELECT expr, tok_no, 'lower' AS side, '>=' AS op, {g(caret, 1)} AS major, {g(caret, 2)} AS minor, {g(caret, 3)} AS patch
  FROM toks WHERE regexp_matches(tok, {sqlstr(caret)})
  UNION ALL
  SELECT expr, tok_no, 'upper', '<', {g(caret, 1)}, {g(caret, 2)} + 1, 0 FROM toks WHERE regexp_matches(tok, {sqlstr(caret)})
  UNION ALL
  SELECT expr, tok_no, 'lower', '=', {g(bare, 1)}, {g(bare, 2)}, {g(bare, 3)} FROM toks
  WHERE regexp_matches(tok, {sqlstr(bare)})
  UNION ALL
  SELECT expr, tok_no, CASE WHEN regexp_extract(tok, {sqlstr(op)}, 1) IN {lower_ops} THEN 'lower' ELSE 'upper' END,
         regexp_extract(tok, {sqlstr(op)}, 1), {g(op, 2)}, {g(op, 3)}, {g(op, 4)}
  FROM toks WHERE regexp_matches(tok, {sqlstr(op)}) AND NOT regexp_matches(tok, {sqlstr(caret)})"""


def _resolve_sql(compat):
    skip = "WHERE NOT (side = 'upper' AND op = '=')" if compat else ""
    return f"""
  WITH b AS (SELECT *, major * 1000000 + minor * 1000 + patch AS n FROM ({_bounds_sql(compat)}) {skip}),
  cat AS (SELECT major * 1000000 + minor * 1000 + patch AS n FROM versions),
  sat AS (SELECT b.expr, c.n, count(*) AS k FROM b JOIN cat c ON
            CASE b.op WHEN '>=' THEN c.n >= b.n WHEN '>' THEN c.n > b.n WHEN '=' THEN c.n = b.n
                      WHEN '<=' THEN c.n <= b.n WHEN '<' THEN c.n < b.n END
          GROUP BY b.expr, c.n),
  best AS (SELECT s.expr, max(s.n) AS n FROM sat s JOIN (SELECT expr, count(*) AS nb FROM b GROUP BY expr) t
           ON t.expr = s.expr WHERE s.k = t.nb GROUP BY s.expr),
  res AS (SELECT p.id, coalesce(best.n, (SELECT max(n) FROM cat)) AS n FROM pragma_exprs p
          LEFT JOIN best ON best.expr = p.expr)
  SELECT id, (n // 1000000) || '.' || ((n // 1000) % 1000) || '.' || (n % 1000) AS version FROM res"""


_SCAN = """SELECT * FROM (
  WITH RECURSIVE st AS (
    SELECT doc, pos, CAST(0 AS BIGINT) AS state FROM diag_x WHERE pos = 1
    UNION ALL
    SELECT b.doc, b.pos + 1, CAST(CASE WHEN s.state > 0 AND b.loc IS NULL THEN s.state - 1 WHEN b.hdr THEN 4 ELSE 0 END AS BIGINT)
    FROM st s JOIN diag_x b ON b.doc = s.doc AND b.pos = s.pos),
  found AS (
    SELECT b.*, s.state, first_value(b.loc IGNORE NULLS) OVER (PARTITION BY b.doc ORDER BY b.pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead
    FROM diag_x b JOIN st s ON s.doc = b.doc AND s.pos = b.pos)
  SELECT doc, pos, CASE WHEN hdr THEN 'header' ELSE 'inline' END AS kind, CASE WHEN hdr THEN ahead ELSE inl END AS line_no
  FROM found WHERE (state = 0 OR loc IS NOT NULL) AND (hdr OR inl IS NOT NULL))"""

ORACLE.update({
    "error_line_extract_compat": _q(["diag_x"], _SCAN),
    "error_line_extract": _q(["l1"], "SELECT DISTINCT doc, line_no FROM l1 WHERE line_no IS NOT NULL"),
    "error_line_fallback": _q(["l2"], "SELECT doc, line_no FROM l2"),
    "error_context": _q(["l2", "doc_lines"], """
  SELECT doc, ln, CASE WHEN is_err = 1 THEN '>>' ELSE '  ' END AS marker, t FROM (
    SELECT *, max(is_err) OVER (PARTITION BY doc ORDER BY ln RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near,
              max(is_err) OVER (PARTITION BY doc) AS any_err
    FROM (SELECT l.*, CASE WHEN e.doc IS NULL THEN 0 ELSE 1 END AS is_err
          FROM doc_lines l LEFT JOIN l2 e ON e.doc = l.doc AND e.line_no = l.ln))
  WHERE near = 1 OR (any_err = 0 AND ln <= 10)"""),
    "repair_by_error_lines": _q(["l2", "doc_lines"], """
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ln) AS ln, ln AS old_ln, t FROM doc_lines l
  WHERE NOT EXISTS (SELECT 1 FROM l2 e WHERE e.doc = l.doc AND e.line_no = l.ln)
    AND NOT (l.doc IN (SELECT doc FROM l2)
             AND NOT EXISTS (SELECT 1 FROM l2 e JOIN doc_lines x ON x.doc = e.doc AND x.ln = e.line_no
                             WHERE e.doc = l.doc)
             AND l.ln = (SELECT max(ln) FROM doc_lines x WHERE x.doc = l.doc))"""),
    "pragma_extract": _q(["code_docs"], f"""
  SELECT ok, nullif({strip("regexp_extract(code, '(?i)pragma\\s+solidity\\s+([^;]+);', 1)")}, '') AS expr
  FROM code_docs"""),
    "version_bounds": _q(["pragma_exprs"], f"""
  SELECT p.id, b.tok_no, b.side, b.op, b.major, b.minor, b.patch FROM pragma_exprs p
  JOIN ({_bounds_sql(False)}) b ON b.expr = p.expr"""),
    "version_bounds_compat": _q(["pragma_exprs"], f"""
  SELECT p.id, b.tok_no, b.side, b.op, b.major, b.minor, b.patch FROM pragma_exprs p
  JOIN ({_bounds_sql(True)}) b ON b.expr = p.expr"""),
    "resolve_version": _q(["pragma_exprs", "versions"], f"SELECT * FROM ({_resolve_sql(False)})"),
    "resolve_version_compat": _q(["pragma_exprs", "versions"], f"SELECT * FROM ({_resolve_sql(True)})"),
})


# ---------------------------------------------------------------- SFT, reports, sampling, I/O
from ..operators.sft import SYSTEM_PROMPT, USER_PREFIX, USER_SUFFIX  # noqa: E402

_ELIG = f"SELECT * FROM ({_records(CAP)}) WHERE original_line_no IS NOT NULL AND length(final_code) >= 20"
_ONCE = f"""SELECT original_line_no, arg_min(path_id, path_id) AS path_id, arg_min(final_code, path_id) AS final_code
  FROM ({_ELIG}) GROUP BY original_line_no"""
_SFT = f"""SELECT e.*, {strip('r.instruction')} AS instruction FROM ({_ELIG}) e
  JOIN responses r ON r.original_line_no = e.original_line_no"""


def _edit_set(src):
    return (f"SELECT original_line_no, path_id, steps_count, instruction, '' AS input, edit_sequence AS output "
            f"FROM ({src})")


def _states(cap):
    return f"""
  SELECT st.ok, st.path_id, st.state,
         coalesce(string_agg(l.t, chr(10) ORDER BY l.ln) FILTER (WHERE s.ln IS NOT NULL), '') AS code
  FROM (SELECT DISTINCT ok, path_id, CAST(k AS BIGINT) AS state FROM ({_capped(cap)}), range(0, m + 1) r(k)) st
  LEFT JOIN ({_capped(cap)}) s ON s.ok = st.ok AND s.path_id = st.path_id AND s.step > st.state
  LEFT JOIN lines_ok l ON l.ok = s.ok AND l.ln = s.ln
  GROUP BY st.ok, st.path_id, st.state"""


_STATUS = f"""
  SELECT d.ok, CASE WHEN d.error IS NOT NULL THEN 'error' WHEN d.code = '' THEN 'empty_code'
                    WHEN len({splitlines('d.code')}) < 6 THEN 'skipped_too_short'
                    WHEN p.n IS NULL THEN 'failed_logic' ELSE 'success' END AS status,
         CASE WHEN d.error IS NULL AND d.code <> '' THEN coalesce(p.n, 0) ELSE 0 END AS n_paths
  FROM status_parsed d LEFT JOIN (SELECT ok, count(DISTINCT path_id) AS n FROM steps GROUP BY ok) p ON p.ok = d.ok"""
_SOUND = "(SELECT ok FROM status_parsed WHERE error IS NULL AND code <> '')"
_CLOSE = "CASE WHEN coalesce({0}, '') = '' THEN '' ELSE {0} || chr(10) END"

_Z2 = {
    "z2_docs": (["meta_records"], f"""
  SELECT min(id) AS ok, contract AS code FROM (
    SELECT id, CASE WHEN body = '' THEN ''
                    WHEN contains(lower(body), 'pragma solidity') THEN body
                    ELSE 'pragma solidity ^' || coalesce(nullif(regexp_extract({_RAW_VER}, {sqlstr(_VER)}, 1), ''),
                                                         '0.4.0') || ';' || chr(10) || body END AS contract
    FROM (SELECT *, {normalise(strip_comments('code'))} AS body FROM meta_records))
  WHERE contract <> '' GROUP BY contract"""),
    "z2_lines": (["z2_docs"], """
  SELECT ok, CAST(i AS BIGINT) AS ln, string_split(code, chr(10))[i] AS t
  FROM z2_docs, range(1, len(string_split(code, chr(10))) + 1) r(i)"""),
    "docs_ok": (["z2_lines"], "SELECT ok, count(*) AS n_lines FROM z2_lines GROUP BY ok HAVING count(*) >= 6"),
    "lines_ok": (["z2_lines", "docs_ok"], "SELECT ok, ln, t FROM z2_lines WHERE ok IN (SELECT ok FROM docs_ok)"),
}


def _qz(body):
    return with_ctes(["steps", "lines_ok", "responses"], body, extra=_Z2).replace("WITH ", "WITH RECURSIVE ", 1)


_VALIDITY = """SELECT * FROM (
  WITH s AS MATERIALIZED ({s}),
  st AS (SELECT ok, path_id, CAST(k AS BIGINT) AS state FROM (SELECT DISTINCT ok, path_id, m FROM s), range(0, m + 1) r(k)),
  gone AS (SELECT ok, path_id, step, count(*) AS n FROM s GROUP BY ALL),
  sz AS (SELECT st.ok, st.path_id, st.state, t.n - CAST(sum(coalesce(g.n, 0)) OVER (PARTITION BY st.ok, st.path_id ORDER BY st.state) AS BIGINT) AS n_lines
         FROM st JOIN (SELECT ok, path_id, count(*) AS n FROM s GROUP BY ALL) t ON t.ok = st.ok AND t.path_id = st.path_id
         LEFT JOIN gone g ON g.ok = st.ok AND g.path_id = st.path_id AND g.step = st.state),
  bad AS (SELECT s.ok, s.path_id, s.ln, s.step, s.m, min(r.step) AS since FROM s
            JOIN edges e ON e.ok = s.ok AND e.ln = s.ln
            JOIN s r ON r.ok = s.ok AND r.path_id = s.path_id AND r.ln = e.req AND r.step < s.step
          GROUP BY ALL),
  vi AS (SELECT ok, path_id, CAST(k AS BIGINT) AS state, count(*) AS violations
         FROM bad, range(since, least(step, m + 1)) r(k) GROUP BY ALL)
  SELECT st.ok, st.path_id, st.state, coalesce(sz.n_lines, 0) AS n_lines, coalesce(vi.violations, 0) AS violations
  FROM st LEFT JOIN sz USING (ok, path_id, state) LEFT JOIN vi USING (ok, path_id, state))"""

_LATE = "SELECT * REPLACE (CASE WHEN ln % 4 = 0 THEN least(step + 2, total_steps + 1) ELSE step END AS step), total_steps AS m FROM steps"

_SCOPED = {
    "scoped_lines": (["clean_lines"], """
  SELECT ok, row_number() OVER (PARTITION BY ok ORDER BY ln, k) AS ln, t FROM (
    SELECT ok, ln, k, parts[k] AS t FROM (
      SELECT ok, ln, CASE WHEN contains(t, 'function f')
                          THEN list_filter(['  function g' || ln || '() {', CASE WHEN ln % 2 = 0 THEN '    uint total = 1;' END,
                                            '    total += ' || regexp_extract(t, '(p[0-9]+);', 1) || ';', '  }'], lambda x: x IS NOT NULL)
                          WHEN starts_with(t, 'contract C') THEN [t, '  uint total = 0;'] ELSE [t] END AS parts
      FROM clean_lines), range(1, len(parts) + 1) r(k))"""),
    "docs_ok": (["scoped_lines"], "SELECT ok, count(*) AS n_lines FROM scoped_lines GROUP BY ok HAVING count(*) >= 6"),
    "lines_ok": (["scoped_lines", "docs_ok"], "SELECT ok, ln, t FROM scoped_lines WHERE ok IN (SELECT ok FROM docs_ok)"),
    "scoped_edges": (["ident_decl", "depth", "block_found"], f"""
  SELECT u.ok, u.ln, arg_max(d.req, d.scope * 1000 + d.level) AS req FROM
    (SELECT DISTINCT ok, ln, decl, unnest(regexp_extract_all(bt, {sqlstr(IDENT_RE)})) AS name FROM ident_decl) u
  JOIN (SELECT i.ok, i.decl AS name, h.d_before AS level, coalesce(b.o, 0) AS scope, min(i.ln) AS req
        FROM ident_decl i JOIN depth h ON h.ok = i.ok AND h.ln = i.ln
        LEFT JOIN block_found b ON b.ok = i.ok AND b.ln = i.ln AND b.level = h.d_before
        WHERE i.decl <> '' GROUP BY ALL) d ON d.ok = u.ok AND d.name = u.name
  LEFT JOIN (SELECT ok, level, o, min(ln) AS close FROM block_found WHERE closes GROUP BY ALL) c ON c.ok = d.ok AND c.level = d.level AND c.o = d.scope
  WHERE u.name <> u.decl AND (d.scope = 0 OR d.scope < u.ln AND u.ln <= coalesce(c.close, 1 << 40))
  GROUP BY u.ok, u.ln, u.name"""),
    "edges": (["block_found", "scoped_edges"], """
  SELECT DISTINCT ok, ln, req FROM (
    SELECT ok, ln, o AS req FROM block_found
    UNION ALL SELECT ok, o, ln FROM block_found WHERE closes
    UNION ALL SELECT ok, ln, req FROM scoped_edges) WHERE ln <> req"""),
}

# Two headers: where repair takes the first before the second goes, the second is last from then on.
_HANDOVER = {
    "header_lines": (["clean_lines"], """
  SELECT ok, row_number() OVER (PARTITION BY ok ORDER BY ln, k) AS ln, t FROM (
    SELECT ok, ln, 0 AS k, t FROM clean_lines WHERE NOT starts_with(t, 'pragma solidity')
    UNION ALL
    SELECT ok, 0, k, h FROM clean_lines, (VALUES (0, 'library L {'), (1, '  pragma solidity ^0.4.9;'), (2, '  uint h = 1;'), (3, '}'), (4, 'pragma solidity ^0.5.0;')) v(k, h)
    WHERE ln = 1)"""),
    "docs_ok": (["header_lines"], "SELECT ok, count(*) AS n_lines FROM header_lines GROUP BY ok HAVING count(*) >= 6"),
    "lines_ok": (["header_lines", "docs_ok"], "SELECT ok, ln, t FROM header_lines WHERE ok IN (SELECT ok FROM docs_ok)"),
    "ranks2": (["removal", "ranks", "docs_ok"], """
  SELECT k.ok, k.path_id, k.ln, CASE WHEN k.ln = 5 AND a.removal < d.n_lines AND b.removal > a.removal THEN d.n_lines + 1 ELSE k.rank END AS rank
  FROM ranks k JOIN docs_ok d ON d.ok = k.ok
  JOIN removal a ON a.ok = k.ok AND a.path_id = k.path_id AND a.ln = 2
  JOIN removal b ON b.ok = k.ok AND b.path_id = k.path_id AND b.ln = 5"""),
    "removal2": (["ranks2", "reach"], """
  SELECT k.ok, k.path_id, k.ln, least(k.rank, coalesce(min(r2.rank), k.rank)) AS removal
  FROM ranks2 k
  LEFT JOIN reach r ON r.ok = k.ok AND r.ln = k.ln
  LEFT JOIN ranks2 r2 ON r2.ok = r.ok AND r2.path_id = k.path_id AND r2.ln = r.req
  GROUP BY k.ok, k.path_id, k.ln, k.rank"""),
}


def _qx(names, body, extra):
    return with_ctes(names, body, extra=extra).replace("WITH ", "WITH RECURSIVE ", 1)


_PBJ = """
  SELECT ok AS original_line_no,
         to_json(list({{'path_id': path_id, 'initial_code': initial_code, 'final_code': final_code,
                       'valid_snapshots': valid_snapshots, 'total_steps': total_steps}} ORDER BY path_id)) AS json
  FROM (SELECT s.ok, s.path_id, m.initial_code, m.final_code, m.total_steps,
               list(s.code ORDER BY s.state) AS valid_snapshots
        FROM ({states}) s JOIN ({summary}) m ON m.ok = s.ok AND m.path_id = s.path_id
        GROUP BY s.ok, s.path_id, m.initial_code, m.final_code, m.total_steps)
  GROUP BY ok"""

ORACLE.update({
    "line_dependencies_scoped": _qx(["edges"], "SELECT ok, ln, req FROM edges", {k: v for k, v in _SCOPED.items()} | {
        "docs_ok": (["scoped_lines"], "SELECT ok, count(*) AS n_lines FROM scoped_lines GROUP BY ok")}),
    "repair_closure_scoped": _qx(["steps"], "SELECT ok, path_id, ln, removal, step FROM steps", _SCOPED),
    "header_handover": _qx(["removal2"], """
  SELECT ok, path_id, ln, step, max(step) OVER (PARTITION BY ok, path_id) AS total_steps FROM (
    SELECT *, dense_rank() OVER (PARTITION BY ok, path_id ORDER BY removal) AS step FROM removal2)""", _HANDOVER),
    "snapshot_validity_damaged": _q(["steps", "edges"], _VALIDITY.replace("{s}", _LATE), True),
    "instruct_eligible": _q(["steps", "lines_ok"], f"SELECT original_line_no, path_id FROM ({_ELIG})", True),
    "instruction_once": _q(["steps", "lines_ok"], _ONCE, True),
    "prompt_table": _q(["steps", "lines_ok"], f"""
  SELECT original_line_no,
         to_json([{{'role': 'system', 'content': {sqlstr(SYSTEM_PROMPT)}}},
                  {{'role': 'user', 'content': {sqlstr(USER_PREFIX)} || final_code
                                               || {sqlstr(USER_SUFFIX)}}}]) AS messages
  FROM ({_ONCE})""", True),
    "attach_instruction": _q(["steps", "lines_ok", "responses"],
                             f"SELECT original_line_no, path_id, instruction FROM ({_SFT})", True),
    "sft_edit_set": _q(["steps", "lines_ok", "responses"], _edit_set(_SFT), True),
    "sft_control_set": _q(["steps", "lines_ok", "responses"], f"""
  SELECT original_line_no, path_id, instruction, '' AS input, final_code AS output FROM ({_SFT})""", True),
    "dual_sink": _q(["steps", "lines_ok", "responses"],
                    f"SELECT count(*) AS n_edit, count(*) AS n_control, 0 AS key_sym_diff FROM ({_SFT})", True),
    "instruct_report": _q(["steps", "lines_ok"], f"""
  SELECT count(DISTINCT original_line_no) AS unique_contracts, count(DISTINCT original_line_no) AS calls,
         count(*) - count(DISTINCT original_line_no) AS cache_hits FROM ({_ELIG})""", True),
    "first_n_contracts": _q(["steps", "lines_ok"], f"""
  SELECT original_line_no, path_id FROM (
    SELECT *, dense_rank() OVER (ORDER BY original_line_no) AS c FROM ({_records(CAP)})) WHERE c <= 1000""", True),
    "sample_exact": _q(["raw_records"], """
  SELECT file_ord, line_no FROM raw_records
  ORDER BY md5('42:' || file_ord || ':' || line_no), file_ord, line_no LIMIT 25"""),
    "first_n_valid": _q(["cleaned"], "SELECT file_ord, line_no FROM cleaned WHERE reason = 'ok' "
                                     "ORDER BY file_ord, line_no LIMIT 5"),
    "changed_only": _q(["steps", "lines_ok"], f"""
  SELECT q.ok, q.path_id, q.steps_count FROM ({_seqs(CAP)}) q JOIN ({_summary(CAP)}) m
    ON m.ok = q.ok AND m.path_id = q.path_id WHERE q.steps_count > 0 AND m.total_steps >= 1""", True),
    "status_route": _q(["steps", "lines_ok", "status_parsed"], _STATUS, True),
    "error_channel": _q(["status_parsed"], "SELECT ok, error FROM status_parsed WHERE error IS NOT NULL"),
    "status_report": _q(["steps", "lines_ok", "status_parsed"], f"""
  SELECT k.status, coalesce(a.n_docs, 0) AS n_docs, coalesce(a.n_paths, 0) AS n_paths
  FROM (VALUES ('success'), ('skipped_too_short'), ('failed_logic'), ('empty_code'), ('error')) k(status)
  LEFT JOIN (SELECT status, count(*) AS n_docs, sum(n_paths) AS n_paths FROM ({_STATUS}) GROUP BY status) a
    ON a.status = k.status""", True),
    "diff_report": _q(["steps", "lines_ok", "status_parsed"], f"""
  SELECT t.n + e.n AS total, r.n AS processed, t.n - r.n AS skipped, e.n AS errors
  FROM (SELECT count(*) AS n FROM (SELECT DISTINCT ok, path_id FROM steps WHERE ok IN {_SOUND})) t,
       (SELECT count(*) AS n FROM ({_records(CAP)}) WHERE original_line_no IN {_SOUND}) r,
       (SELECT count(*) AS n FROM status_parsed WHERE error IS NOT NULL) e""", True),
    "text_diff": _q(["steps", "lines_ok"], f"""SELECT * FROM (
  WITH st AS (SELECT *, CASE WHEN code = '' THEN 0 ELSE len(string_split(code, chr(10))) END AS n FROM ({_states(CAP)})),
       mx AS (SELECT ok, path_id, max(state) AS m FROM st GROUP BY ok, path_id)
  SELECT c.ok, c.path_id, mx.m - c.state AS fwd, c.n - p.n AS added, 0 AS removed, md5(c.code) AS replayed_md5
  FROM st c JOIN mx ON mx.ok = c.ok AND mx.path_id = c.path_id
  JOIN st p ON p.ok = c.ok AND p.path_id = c.path_id AND p.state = c.state + 1)""", True),
    "text_diff_cleaned": _q(["code_docs", "clean_docs"], """
  SELECT r.ok, CASE WHEN c.code = '' THEN 0 ELSE len(string_split(c.code, chr(10))) END - CASE WHEN r.code = '' THEN 0 ELSE len(string_split(r.code, chr(10))) END AS net,
         r.code <> c.code AS changed, md5(c.code) AS replayed_md5, 0 AS bad_hunk
  FROM code_docs r JOIN clean_docs c ON c.ok = r.ok"""),
    "replay_records": _q(["steps", "lines_ok"], f"""
  SELECT original_line_no, path_id, md5(final_code) AS replayed_md5, steps_count AS steps, 0 AS bad_hunk FROM ({_records(CAP)})""", True),
    "replay_damaged": _q(["steps", "lines_ok"], f"""
  SELECT original_line_no, path_id, n_hunks, 1 + original_line_no % n_hunks AS bad_hunk FROM (
    SELECT original_line_no, path_id, len(string_split(chr(10) || edit_sequence, chr(10) || '@@ -')) - 1 AS n_hunks FROM ({_records(CAP)}))""", True),
    "adjacent_pairs": _q(["steps", "lines_ok"], f"""SELECT * FROM (
  WITH st AS ({_states(CAP)}), mx AS (SELECT ok, path_id, max(state) AS m FROM st GROUP BY ok, path_id)
  SELECT c.ok, c.path_id, mx.m - c.state AS fwd,
         length({_CLOSE.format('p.code')}) AS prev_len, md5({_CLOSE.format('p.code')}) AS prev_md5,
         length({_CLOSE.format('c.code')}) AS curr_len, md5({_CLOSE.format('c.code')}) AS curr_md5
  FROM st c JOIN mx ON mx.ok = c.ok AND mx.path_id = c.path_id
  JOIN st p ON p.ok = c.ok AND p.path_id = c.path_id AND p.state = c.state + 1)""", True),
    "consecutive_dedup": _q(["steps", "lines_ok"], f"""
  SELECT ok, path_id, state FROM (
    SELECT *, lag(code) OVER (PARTITION BY ok, path_id ORDER BY state) AS prev FROM ({_states(CAP)}))
  WHERE prev IS NULL OR prev <> code""", True),
    "edit_sequence_tagged": _q(["steps", "lines_ok"], f"""
  SELECT p.ok AS original_line_no, coalesce(q.edit_sequence, '') AS edit_sequence
  FROM (SELECT DISTINCT ok, path_id FROM steps WHERE total_steps >= 1) p
  LEFT JOIN ({_seqs(CAP, "chr(10) || '<|next_edit|>' || chr(10)")}) q ON q.ok = p.ok AND q.path_id = p.path_id""",
                               True),
    "snapshot_validity": _q(["steps", "edges"], _VALIDITY.replace("{s}", _capped(CAP)), True),
    "edit_corpus": _qz(f"SELECT * FROM ({_records(CAP)})"),
    "sft_corpus": _qz(_edit_set(f"""SELECT e.*, {strip('r.instruction')} AS instruction FROM ({_ELIG}) e
  JOIN responses r ON r.original_line_no = e.original_line_no""")),
    "jsonl_scan": _q(["raw_lines"], f"SELECT file_ord, line_no, raw FROM raw_lines WHERE {strip('raw')} <> ''"),
    "line_subset": _q(["raw_lines"], """
  SELECT k.file_ord, k.line_no, CASE WHEN r.raw IS NULL THEN 'absent' WHEN json_valid(r.raw) THEN 'found'
                                     ELSE 'malformed' END AS status, r.raw
  FROM (SELECT DISTINCT doc_id % 3 AS file_ord, doc_id % 500 + 1 AS line_no FROM labels) k
  LEFT JOIN raw_lines r ON r.file_ord = k.file_ord AND r.line_no = k.line_no"""),
    "jsonl_write": _q(["raw_records"], """
  SELECT to_json({'file_ord': file_ord, 'line_no': line_no, 'contract_address': contract_address,
                  'func_name': func_name, 'file_path': file_path}) AS json FROM raw_records"""),
    "path_bundle": _q(["steps", "lines_ok"], _PBJ.format(states=_states(CAP), summary=_summary(CAP)), True),
    "resume_append": _q(["done_keys"], """
  SELECT o_orderkey AS original_line_no FROM orders
  WHERE o_orderkey NOT IN (SELECT original_line_no FROM done_keys)"""),
})

# The same plans over one long document per text of ``documents``.
_LONG = {
    "long_lines": ([], """
  SELECT doc_id AS ok, CAST(2 * i - 1 + k AS BIGINT) AS ln,
         CASE WHEN k = 1 THEN 'string s' || (i - 1) || ' = "' || md5(string_split(text, chr(10))[i]) || '";'
              WHEN i = 1 THEN 'uint v0 = 1;' ELSE 'uint v' || (i - 1) || ' = v' || (i - 2) || ';' END AS t
  FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i), range(0, 2) q(k)"""),
    "docs_ok": (["long_lines"], "SELECT ok, count(*) AS n_lines FROM long_lines GROUP BY ok HAVING count(*) >= 6"),
    "lines_ok": (["long_lines", "docs_ok"], "SELECT ok, ln, t FROM long_lines WHERE ok IN (SELECT ok FROM docs_ok)"),
}


def _long(names, body):
    """A recursive query's SQL with its documents replaced by the long ones."""
    return with_ctes(names, body, extra=_LONG).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE.update({
    "resume_stream": "SELECT o_orderkey AS original_line_no, CASE WHEN o_orderkey % 5 = 0 THEN 'first' ELSE 'second' END AS run FROM orders",
    "resume_jsonl": with_ctes(["parsed", "keyed"], """
  SELECT DISTINCT 'done' AS kind, key AS value FROM keyed
  UNION ALL SELECT status, raw FROM parsed, range(0, CASE WHEN file_ord = 1 THEN 2 ELSE 1 END) WHERE status IN ('bad_json', 'not_object')"""),
    "repair_closure_long": _long(["steps"], "SELECT ok, path_id, ln, removal, step FROM steps"),
    "edit_records_long": _long(["steps", "lines_ok"], f"SELECT * FROM ({_records(CAP)})"),
    "snapshot_validity_long": _long(["steps", "edges"], _VALIDITY.replace("{s}", _capped(CAP))),
})

# The whole chain from the JSONL shards on; a contract's key is its line in the cleaned file.
_CHAIN = {
    "chain_docs": (["dedup"], "SELECT row_number() OVER (ORDER BY file_ord, line_no) AS ok, contract AS code FROM dedup"),
    "chain_lines": (["chain_docs"], """
  SELECT ok, CAST(i AS BIGINT) AS ln, string_split(code, chr(10))[i] AS t
  FROM chain_docs, range(1, len(string_split(code, chr(10))) + 1) r(i)"""),
    "docs_ok": (["chain_lines"], "SELECT ok, count(*) AS n_lines FROM chain_lines GROUP BY ok HAVING count(*) >= 6"),
    "lines_ok": (["chain_lines", "docs_ok"], "SELECT ok, ln, t FROM chain_lines WHERE ok IN (SELECT ok FROM docs_ok)"),
}


def _chain(body):
    return with_ctes(["steps", "lines_ok", "responses"], body, extra=_CHAIN).replace("WITH ", "WITH RECURSIVE ", 1)


_CHAIN_SFT = f"""SELECT e.*, {strip('r.instruction')} AS instruction FROM ({_ELIG}) e
  JOIN responses r ON r.original_line_no = e.original_line_no"""
ORACLE.update({
    "chain_edits": _chain(f"SELECT * FROM ({_records(CAP)})"),
    "chain_sft": _chain(_edit_set(_CHAIN_SFT)),
    "chain_sft_control": _chain(f"""
  SELECT original_line_no, path_id, instruction, '' AS input, final_code AS output FROM ({_CHAIN_SFT})"""),
})
