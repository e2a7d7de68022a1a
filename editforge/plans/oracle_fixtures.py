"""Fixture views in DuckDB SQL, the twins of ``sources/fixtures.py``.

Used only to build the independent SQL oracle of each query. DuckDB has RE2
regexes (no possessive quantifiers, ASCII ``\\s``), ``//`` for integer
division and ``string_agg(x, sep ORDER BY k)``.
"""

from __future__ import annotations


def jq(col: str) -> str:
    """JSON string literal for a column (null -> null); same rule as fixtures.record_json."""
    esc = (f"replace(replace(replace(replace(replace({col}, '\\', '\\\\'), '\"', '\\\"'), "
           f"chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')")
    return f"CASE WHEN {col} IS NULL THEN 'null' ELSE '\"' || {esc} || '\"' END"


# RE2 versions of the text patterns (same meaning on the test data and on ASCII text).
WS_CLASS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPLIT_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
COMMENT_RE = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?://[^\r\n]*|/\*[\s\S]*?\*/)"""


def sqlstr(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rstrip(c: str) -> str:
    return f"regexp_replace({c}, {sqlstr(WS_CLASS + '+$')}, '')"


def strip(c: str) -> str:
    return f"regexp_replace({rstrip(c)}, {sqlstr('^' + WS_CLASS + '+')}, '')"


def splitlines(c: str) -> str:
    """Python splitlines as a list (final terminator adds no element)."""
    parts = f"regexp_split_to_array({c}, {sqlstr(SPLIT_RE)})"
    return (f"(CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN {parts}[-1] = '' "
            f"THEN {parts}[1:len({parts})-1] ELSE {parts} END)")


def strip_comments(c: str) -> str:
    return f"regexp_replace({c}, {sqlstr(COMMENT_RE)}, '\\1', 'g')"


def normalise(c: str) -> str:
    return (f"array_to_string(list_filter(list_transform({splitlines(c)}, lambda x: {rstrip("x")}), "
            f"lambda x: length({strip("x")}) > 0), chr(10))")


CTE = {}
DEPS = {}


def cte(name, deps, sql):
    CTE[name] = sql
    DEPS[name] = deps


cte("raw_records", [], """
  SELECT doc_id % 3 AS file_ord,
         row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS line_no,
         doc_id,
         CASE WHEN doc_id % 4 < 2 THEN '0x' || substr(md5(text), 1, 8) END AS contract_address,
         CASE WHEN doc_id % 4 IN (0, 2) THEN 'f_' || lang END AS func_name,
         CASE WHEN doc_id % 4 >= 2 THEN 'src/' || source || '/' || (doc_id // 64) || '.sol' END AS file_path,
         text AS class_code
  FROM documents""")

cte("raw_json", ["raw_records"], f"""
  SELECT *, '{{"contract_address":' || {jq('contract_address')} || ',"func_name":' || {jq('func_name')}
            || ',"file_path":' || {jq('file_path')} || ',"class_code":' || {jq('class_code')} || '}}' AS json
  FROM raw_records""")

cte("raw_lines", ["raw_json"], f"""
  SELECT file_ord, row_number() OVER (PARTITION BY file_ord ORDER BY doc_id, k) AS line_no, raw FROM (
    SELECT file_ord, doc_id, 0 AS k, json AS raw FROM raw_json
    UNION ALL SELECT file_ord, doc_id, 1, '' FROM raw_json WHERE doc_id % 77 = 0
    UNION ALL SELECT file_ord, doc_id, 2, substr(json, 1, length(json) // 2) FROM raw_json WHERE doc_id % 50 = 0
    UNION ALL SELECT file_ord, doc_id, 3, '{{"func_code":' || {jq('class_code')} || ',"contract":' || {jq("'C' || doc_id")}
                     || ',"class_code":"","original_meta":{{"version":"v0.5.' || (doc_id % 10) || '"}}}}' FROM raw_json WHERE doc_id % 40 = 0
    UNION ALL SELECT file_ord, doc_id, 4, '{{"class_code":"// a comment","version":"0.6.1"}}' FROM raw_json WHERE doc_id % 90 = 0)""")

cte("li_items", [], """
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS item
  FROM lineitem""")

cte("code_lines_raw", ["li_items"], """
  SELECT o_orderkey AS ok, 0 AS sec, 0 AS sub,
         'pragma solidity ^0.' || (4 + o_custkey % 3) || '.' || (o_custkey % 10) || ';' AS t
  FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 1, 0, 'contract C' || o_orderkey || ' {' FROM orders
  UNION ALL SELECT o_orderkey, 3, 0, '}' FROM orders
  UNION ALL SELECT l_orderkey, 2, item * 4 + 0,
         '  uint p' || l_partkey || ' = ' || CAST(l_quantity AS BIGINT) || '; // ' || l_returnflag FROM li_items
  UNION ALL SELECT l_orderkey, 2, item * 4 + 1, '  string s' || l_suppkey || ' = "http://x/' || l_suppkey || '";'
         FROM li_items WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, 2, item * 4 + 2, '  function f' || item || '() { /* ' || l_returnflag
         FROM li_items WHERE l_linestatus = 'F'
  UNION ALL SELECT l_orderkey, 2, item * 4 + 3, '  */ total += p' || l_partkey || '; }'
         FROM li_items WHERE l_linestatus = 'F'""")

cte("code_lines", ["code_lines_raw"], """
  SELECT ok, row_number() OVER (PARTITION BY ok ORDER BY sec, sub) AS ln, t FROM code_lines_raw""")

cte("code_docs", ["code_lines"], """
  SELECT ok, string_agg(t, chr(10) ORDER BY ln) AS code FROM code_lines GROUP BY ok""")

cte("meta_records", ["code_docs"], """
  SELECT d.ok AS id, d.code,
         CASE WHEN o_orderkey % 4 = 0 THEN 'v0.4.' || (o_custkey % 27) || '+commit' END AS compiler_version,
         CASE WHEN o_orderkey % 4 = 1 THEN 'v0.5.' || (o_custkey % 27) || '+commit' END AS original_version,
         CASE WHEN o_orderkey % 4 = 2 THEN '0.6' END AS version
  FROM code_docs d JOIN orders o ON o.o_orderkey = d.ok""")

cte("clean_docs", ["code_docs"], f"""
  SELECT ok, {normalise(strip_comments('code'))} AS code FROM code_docs""")

cte("status_lines", ["clean_docs"], f"""
  SELECT ok, CASE WHEN ok % 97 = 0 THEN substr(line, 1, length(line) // 2)
                  WHEN ok % 101 = 0 THEN '{{"contract":' || ok || '}}'
                  WHEN ok % 103 = 0 THEN '[' || q || ']'
                  WHEN ok % 107 = 0 THEN '{{"contract":null}}'
                  WHEN ok % 109 = 0 THEN '{{"other":1}}' ELSE line END AS raw
  FROM (SELECT ok, {jq('code')} AS q, '{{"contract":' || {jq('code')} || '}}' AS line FROM clean_docs)""")
cte("status_parsed", ["status_lines"], """
  SELECT ok, raw, error, CASE WHEN error IS NULL THEN coalesce(json_extract_string(raw, '$.contract'), '') END AS code
  FROM (SELECT ok, raw, CASE WHEN NOT json_valid(raw) THEN 'bad_json' WHEN json_type(raw) <> 'OBJECT' THEN 'not_object'
                             WHEN json_type(raw, '$.contract') <> 'VARCHAR' THEN 'not_text' END AS error FROM status_lines)""")

cte("clean_lines", ["clean_docs"], """
  SELECT ok, CAST(i AS BIGINT) AS ln, string_split(code, chr(10))[i] AS t
  FROM clean_docs, range(1, len(string_split(code, chr(10))) + 1) r(i)
  WHERE code <> ''""")

cte("pragma_exprs", [], """
  SELECT c_custkey AS id,
         (['^0.4.3', '0.4.11', '>=0.4.2 <0.6.0', '>=0.4.0', '<=0.5.3', '~0.4.1', '=0.4.9', '>= 0.4.5', '^9.9.9',
           NULL, '^0.4', '^0', '^0.4.3-nightly', '^ 0.4.3', '0.4.*', '>=0.4.22 <0.9.0'])[c_custkey % 16 + 1] AS expr
  FROM customer""")

cte("versions", [], """
  SELECT 0 AS major, m AS minor, CAST(p AS INTEGER) AS patch
  FROM (VALUES (4, 26), (5, 17), (6, 12)) v(m, last), range(0, last + 1) r(p)""")

cte("diagnostics", [], """
  SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Error: v'
              WHEN event_type = 'error' THEN 'a.sol:' || (event_id % 40 + 1) || ':5: Error: x'
              WHEN event_type = 'view' THEN '--> a.sol:' || (event_id % 40 + 1) || ':7:'
              WHEN event_type = 'click' THEN 'Warning: w'
              WHEN event_type = 'signup' THEN 'TypeError: t'
              WHEN event_type = 'purchase' THEN '  |' END AS t
  FROM events""")

cte("responses", [], """
  SELECT o_orderkey AS original_line_no, f.instruction
  FROM orders JOIN (SELECT conv_id, arg_min(text, turn) AS instruction FROM conversations
                    WHERE role = 'assistant' GROUP BY conv_id) f ON o_orderkey % (SELECT max(conv_id) + 1 FROM conversations) = f.conv_id""")

cte("done_keys", [], "SELECT o_orderkey AS original_line_no FROM orders WHERE o_orderkey % 5 = 0")


def with_ctes(names: list[str], body: str, extra: dict | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``.

    ``extra`` adds query-local CTEs ``{name: (deps, sql)}`` in order.
    """
    extra = extra or {}
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        deps = extra[n][0] if n in extra else DEPS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    for n in extra:
        visit(n)
    parts = [f"{n} AS ({extra[n][1] if n in extra else CTE[n]})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body
