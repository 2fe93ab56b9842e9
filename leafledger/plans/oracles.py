"""SQL equivalents of the registered queries, in the dialect of DuckDB.

They are written from the definitions and not from the Spark plans: line state
comes from a window, order from lists of structs, running sums from one global
window, rules from testing every rule on every path.
"""

from __future__ import annotations

from leafledger.plans.expected import (
    BUDGET, COMMENTS, CONVERSATION_BUDGET, FENCES, LANGUAGES, QUOTA_BYTES, SPACES, STATUS_TEXT, TEXT_EXTENSIONS, TOKEN_FAMILIES,
)

SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SMALL = 8 * 1024
LARGE = 10 * 1024


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def values(table: dict[str, str]) -> str:
    return ", ".join(f"({quoted(pair)})" for pair in table.items())


def by_extension(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {ext: value for value, exts in table.items() for ext in exts}


CORPUS = """corpus AS (
  SELECT doc_id, source, lang, text,
    source || '/' || lang || '/' || (CASE WHEN doc_id % 41 = 0 THEN '.' ELSE '' END)
      || 'doc_' || CAST(doc_id AS VARCHAR)
      || CASE doc_id % 10 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.go'
           WHEN 3 THEN '.py' WHEN 4 THEN '.json' WHEN 5 THEN '.html' WHEN 6 THEN '.PY'
           WHEN 7 THEN '' WHEN 8 THEN '.tar.gz' ELSE '.log' END AS relpath,
    CAST(strlen(text) AS BIGINT) AS size_bytes,
    TIMESTAMP '2024-03-01 00:00:00' - to_minutes(doc_id * doc_id) AS mtime
  FROM documents)"""
PAGES = """page_corpus AS (
  SELECT page_id,
    regexp_replace(regexp_replace(p, '/$', '/index'), '\\.html$', '') || '-' || CAST(page_id AS VARCHAR) || '.html' AS relpath,
    CAST(strlen(html) AS BIGINT) AS size_bytes, replace(html, ' ', chr(10)) AS text
  FROM (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p FROM pages))"""
PROJECTS = """projects AS (
  SELECT CASE WHEN doc_id % 25 = 24 THEN '' ELSE 'p' || CAST(doc_id // 25 AS VARCHAR) || '/' END || CASE
      WHEN doc_id % 25 = 24                    THEN 'README-' || CAST(doc_id AS VARCHAR) || '.md'
      WHEN doc_id % 25 = 0 AND lang <> 'fr'    THEN 'README.md'
      WHEN doc_id % 25 = 1 AND n_chars % 2 = 0 THEN 'LICENSE'
      WHEN doc_id % 25 = 2 AND n_chars % 3 = 0 THEN '.gitignore'
      WHEN doc_id % 25 = 3 AND n_chars % 2 = 1 THEN 'tests/t.py'
      WHEN doc_id % 25 = 4                     THEN 'sub/README.md'
      WHEN doc_id % 25 = 5 AND n_chars % 5 = 0 THEN 'src/x_test.go'
      ELSE 'src/doc_' || CAST(doc_id AS VARCHAR) || '.txt' END AS relpath,
    CAST(strlen(text) AS BIGINT) AS size_bytes, text
  FROM documents)"""
SNIFFED = """sniffed AS (
  SELECT doc_id, relpath, size_bytes,
    CASE doc_id % 7 WHEN 0 THEN regexp_replace(text, '[aeiou ]', chr(1), 'g')
      WHEN 1 THEN replace(text, '. ', '.' || chr(0)) WHEN 2 THEN '' ELSE text END AS text
  FROM corpus)"""
BOTH = "both_ AS (SELECT relpath, size_bytes, text FROM corpus UNION ALL SELECT relpath, size_bytes, text FROM page_corpus)"
TRACKED = "tracked AS (SELECT relpath AS path FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels))"
STATUS = """status AS (
  SELECT CASE WHEN l.doc_id IS NULL THEN 'new/' ELSE '' END || c.relpath AS path,
    (['??', 'A ', ' M', 'M ', 'MM', 'D ', ' D', 'R ', 'C ', 'UU'])[c.doc_id % 10 + 1] AS xy
  FROM corpus c LEFT JOIN labels l ON c.doc_id = l.doc_id
  WHERE l.quality = 0 OR (l.doc_id IS NULL AND c.doc_id % 17 = 0))"""


def named(source: str) -> str:
    """Path parts of a corpus as ``f``."""
    return f"""f0 AS (SELECT *, regexp_extract(relpath, '[^/]*$') AS base FROM {source}),
f1 AS (SELECT *, regexp_extract(base, '\\.[^.]*$') AS ext FROM f0),
f AS (SELECT *, CASE WHEN ext <> '' THEN lower(substr(ext, 2)) END AS ext_key,
  CASE WHEN contains(relpath, '/') THEN regexp_replace(relpath, '/[^/]*$', '') ELSE '' END AS dir FROM f1)"""


LINES = """l0 AS (SELECT *, string_split(text, chr(10)) AS ls FROM f),
l1 AS (SELECT *, CASE WHEN text = '' THEN CAST([] AS VARCHAR[])
  WHEN ends_with(text, chr(10)) THEN ls[1:len(ls)-1] ELSE ls END AS lines FROM l0),
lines AS (SELECT relpath, ext_key, size_bytes, CAST(unnest(generate_series(1, len(lines))) AS INTEGER) AS line_no,
  regexp_replace(unnest(lines), '\\r$', '') AS line FROM l1)"""

ENTRIES = """dirs AS (SELECT DISTINCT unnest(list_transform(generate_series(1, len(string_split(dir, '/'))),
    lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS relpath FROM f WHERE dir <> ''),
e0 AS (SELECT relpath, false AS is_dir FROM f UNION ALL SELECT relpath, true FROM dirs),
entries AS (SELECT relpath,
  CASE WHEN contains(relpath, '/') THEN regexp_replace(relpath, '/[^/]*$', '') ELSE '' END AS parent,
  regexp_extract(relpath, '[^/]*$') AS name,
  CAST(len(string_split(relpath, '/')) AS INTEGER) AS depth, is_dir FROM e0)"""
WITH_EMPTY = """full_entries AS (SELECT * FROM entries UNION ALL
  SELECT relpath || '/empty', relpath, 'empty', depth + 1, true FROM entries WHERE is_dir)"""


SITE = """site AS (SELECT relpath, CAST(0 AS BIGINT) AS size_bytes, string_agg(
    CASE WHEN text = '' OR ends_with(text, chr(10)) THEN text ELSE text || chr(10) END, '' ORDER BY page_id) AS text
  FROM (SELECT *, 'site-' || CAST(page_id % 3 AS VARCHAR) || '.html' AS relpath FROM (SELECT page_id, text FROM page_corpus)) GROUP BY relpath)"""
FOLDERS = """folders AS (SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS folder,
  string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1)"""


def order_key(is_dir: str = "is_dir") -> str:
    parts = "string_split(relpath, '/')"
    return (
        f"list_transform({parts}, lambda x, i: "
        f"{{'leaf': (NOT {is_dir}) AND i = len({parts}), 'name': x}})"
    )


def case(column: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {column} IN ({quoted(e)}) THEN '{v}'" for v, e in table.items())
    return f"CASE {arms} ELSE {default} END"


def _syntax(part: int) -> str:
    arms = " ".join(
        f"WHEN ext_key IN ({quoted(extensions)}) THEN '{marks[part]}'"
        for marks, extensions in COMMENTS if marks[part]
    )
    return f"CASE {arms} END"


TRIM = f"trim(line, '{SPACES}')"
KINDS = f"""k0 AS (SELECT *, {_syntax(0)} AS lc, {_syntax(1)} AS bs, {_syntax(2)} AS be, {TRIM} AS t FROM lines),
k1 AS (SELECT *, coalesce(contains(line, bs), false) AS hs, coalesce(contains(line, be), false) AS he FROM k0),
k2 AS (SELECT *, coalesce(last_value(CASE WHEN he THEN false WHEN hs THEN true END IGNORE NULLS) OVER (
  PARTITION BY relpath ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM k1),
kinds AS (SELECT *, CASE WHEN t = '' THEN 'blank'
  WHEN inside OR hs OR coalesce(starts_with(t, lc), false) THEN 'comment' ELSE 'code' END AS kind FROM k2)"""
CONTROL = r"[\t\n\f\r ]+(if|for|while|switch)[\t\n\f\r ]+.*\{"
FUNCTION = r"[\t\n\f\r ]*func[\t\n\f\r ]+[0-9A-Za-z_]+[\t\n\f\r ]*\("
METRICS = f"""metrics AS (SELECT f.relpath, any_value(f.ext_key) AS ext_key, count(line_no) AS lines,
  count(*) FILTER (kind = 'code') AS code_lines, count(*) FILTER (kind = 'blank') AS blank_lines,
  count(*) FILTER (kind = 'comment') AS comments,
  coalesce(sum(CASE WHEN kind = 'code' THEN
    CASE WHEN regexp_matches(line, '{CONTROL}') THEN 1.0::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(line, '{FUNCTION}') THEN 0.5::DOUBLE ELSE 0 END END), 0::DOUBLE) AS complexity_score
  FROM f LEFT JOIN kinds k ON k.relpath = f.relpath WHERE f.ext_key IS NOT NULL GROUP BY f.relpath)"""


def words(text: str, extra: str = "") -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE}{extra}]+'))"


def code_tokens(line: str) -> str:
    cut = f"string_split(string_split({line}, '//')[1], '#')[1]"
    symbols = f"len(regexp_extract_all({cut}, '[{{}}()\\[\\];,.:+\\-*/=<>!&|%^~]'))"
    return f"CAST(trunc({words(cut)} * 1.3::DOUBLE + {symbols} * 0.5::DOUBLE) AS BIGINT)"


def data_tokens(line: str) -> str:
    return f"CAST(trunc({words(line, chr(34) + '{}' + chr(92) + '[' + chr(92) + '],:')} * 1.1::DOUBLE) AS BIGINT)"


def text_tokens(line: str) -> str:
    return f"CAST(trunc({words(line, chr(92) + 'p{P}')} * 1.3::DOUBLE) AS BIGINT)"


def default_tokens(line: str) -> str:
    return f"CAST(strlen({line}) // 4 AS BIGINT)"


def _family(name: str) -> str:
    return f"ext_key IN ({quoted(TOKEN_FAMILIES[name])})"


LINE_TOKENS = f"""CASE
  WHEN {_family('code')} THEN CASE WHEN {TRIM} = '' OR starts_with({TRIM}, '//') OR starts_with({TRIM}, '/*')
    THEN 0 ELSE {code_tokens(TRIM)} END
  WHEN {_family('script')} THEN CASE WHEN {TRIM} = '' OR starts_with({TRIM}, '#') OR starts_with({TRIM}, '//')
    THEN 0 ELSE {code_tokens(TRIM)} END
  WHEN {_family('data')} THEN {data_tokens(TRIM)}
  WHEN {_family('text')} THEN {text_tokens(TRIM)}
  ELSE {default_tokens('line')} END"""
TOKENS = f"""tokens AS (SELECT f.relpath, CAST(coalesce(sum({LINE_TOKENS.replace('ext_key', 'lines.ext_key')}), 0) AS BIGINT) AS tokens
  FROM f LEFT JOIN lines ON lines.relpath = f.relpath GROUP BY f.relpath)"""

# The text test, from the bytes in hexadecimal.  The texts are valid UTF-8, so no byte is bad.
_BYTE = "substr(whole, 2 * i + 1, 2)"
_CONTROLS = f"len(list_filter(generate_series(0, n - 1), lambda i: {_BYTE} < '20' AND {_BYTE} NOT IN ('08', '09', '0A', '0B', '0C', '0D')))"
SNIFF = f"""s0 AS (SELECT *, hex(encode(text)) AS whole, strlen(text) AS n FROM f),
sniff AS (SELECT *, contains(text, chr(0)) AS is_binary,
  CASE WHEN coalesce(ext_key IN ({quoted(TEXT_EXTENSIONS)}), false) THEN true
    WHEN n = 0 THEN true
    WHEN contains(text, chr(0)) THEN false
    WHEN {_CONTROLS}::DOUBLE / n > 0.3::DOUBLE THEN false ELSE true END AS is_text FROM s0)"""

RULES = r"""rule_lines AS (
  SELECT d.source || '/.gitignore' AS relpath, d.doc_id AS line_no, CASE d.doc_id % 9
      WHEN 0 THEN '# note ' || CAST(d.doc_id AS VARCHAR)
      WHEN 1 THEN 'doc_' || CAST(d.doc_id AS VARCHAR) || '.txt'
      WHEN 2 THEN '*_' || CAST(d.doc_id % 1000 AS VARCHAR) || '.*'
      WHEN 3 THEN '!doc_' || CAST(d.doc_id // 10 AS VARCHAR) || '*'
      WHEN 4 THEN d.lang || '/doc_' || CAST(d.doc_id + 1 AS VARCHAR) || '.*'
      WHEN 5 THEN '  ' || d.lang || '/ '
      WHEN 6 THEN '*' || CAST(d.doc_id % 100 AS VARCHAR) || '.log'
      WHEN 7 THEN 'doc_' || CAST(d.doc_id % 100 AS VARCHAR) || '?.*'
      ELSE '' END AS line
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r0 AS (SELECT relpath, line_no, trim(line) AS line FROM rule_lines),
r1 AS (SELECT *, starts_with(line, '!') AS is_negation,
  CASE WHEN starts_with(line, '!') THEN substr(line, 2) ELSE line END AS body
  FROM r0 WHERE line <> '' AND NOT starts_with(line, '#')),
rules AS (SELECT row_number() OVER (ORDER BY string_split(relpath, '/'), line_no) AS rule_no,
  CASE WHEN ends_with(body, '/') THEN left(body, length(body) - 1) ELSE body END AS pattern,
  is_negation, ends_with(body, '/') AS is_dir_only FROM r1),
rx AS (SELECT *, '(^|/)' || replace(replace(replace(pattern, '.', '\.'), '*', '[^/]*'), '?', '[^/]') || '$' AS regex FROM rules)"""


def judged(source: str, is_dir: str) -> str:
    return f"""judged AS (SELECT p.*, coalesce(NOT v.is_negation, false) AS is_ignored FROM {source} p LEFT JOIN (
  SELECT q.relpath, arg_max(rx.is_negation, rx.rule_no) AS is_negation FROM {source} q JOIN rx
    ON regexp_matches(q.relpath, rx.regex) AND (rx.is_negation OR NOT rx.is_dir_only OR {is_dir})
  GROUP BY q.relpath) v ON v.relpath = p.relpath)"""


SCOPED = r"""scoped_lines AS (
  SELECT CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN d.source ELSE d.source || '/' || d.lang END AS scope,
    d.doc_id AS line_no, CASE d.doc_id % 7
      WHEN 0 THEN 'doc_' || CAST(d.doc_id AS VARCHAR) || '.*'
      WHEN 1 THEN '*c_' || CAST(d.doc_id % 100 AS VARCHAR) || '*'
      WHEN 2 THEN '!*_' || CAST(d.doc_id % 50 AS VARCHAR) || '?.*'
      WHEN 3 THEN d.lang || '/doc_' || CAST(d.doc_id % 300 AS VARCHAR) || '*'
      WHEN 4 THEN '!doc_' || CAST(d.doc_id // 3 AS VARCHAR) || '*'
      WHEN 5 THEN d.lang || '/'
      ELSE '!' || d.lang END AS line
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
scoped_rules AS (
  SELECT scope, [CASE WHEN scope = '' THEN 0 ELSE len(string_split(scope, '/')) END, line_no] AS place,
    starts_with(line, '!') AS is_negation, ends_with(line, '/') AS is_dir_only,
    '(^|/)' || replace(replace(replace(trim(line, '!/'), '.', '\.'), '*', '[^/]*'), '?', '[^/]') || '$' AS regex
  FROM scoped_lines),
scoped AS (SELECT p.relpath, p.is_dir, coalesce(NOT v.is_negation, false) AS is_ignored FROM entries p LEFT JOIN (
  SELECT q.relpath, arg_max(r.is_negation, r.place) AS is_negation FROM entries q JOIN scoped_rules r
    ON (r.scope = '' OR starts_with(q.relpath, r.scope || '/'))
    AND regexp_matches(CASE WHEN r.scope = '' THEN q.relpath ELSE substr(q.relpath, length(r.scope) + 2) END, r.regex)
    AND (r.is_negation OR NOT r.is_dir_only OR q.is_dir)
  GROUP BY q.relpath) v ON v.relpath = p.relpath)"""


DOTTED = "regexp_matches(relpath, '(^|/)\\.')"
EXCLUDED = (
    "(regexp_matches(base, '^doc_1[^/]*$') OR regexp_matches(relpath, '^src3/[^/]*/[^/]*$')"
    " OR regexp_matches(base, '^[^/]*\\.html$'))"
)
WANTED = "ext IN ('.md', '.txt', '.go', '.py')"
IN_TRACKED = "relpath IN (SELECT path FROM tracked)"

WRITTEN = "CASE WHEN line_no < 10 THEN ' ' ELSE '' END || CAST(line_no AS VARCHAR) || ' | ' || line"
BUDGETED = f"""w0 AS (SELECT *, {WRITTEN} AS written, {order_key('false')} AS k FROM lines),
w AS (SELECT *, sum(CASE WHEN size_bytes > {SMALL} THEN 0 ELSE strlen(written) + 1 END)
  OVER (ORDER BY k, line_no ROWS UNBOUNDED PRECEDING) AS upto FROM w0),
kept AS (SELECT *, upto <= {BUDGET} AND size_bytes <= {SMALL} AS fits FROM w)"""
TRUNCATED = f"[Output truncated: reached character limit of {BUDGET}]"


def too_large_note(size: str) -> str:
    return f"printf('[File too large: %.1fMB - skipped (max: %.1fMB)]', {size} / 1048576.0::DOUBLE, {SMALL} / 1048576.0::DOUBLE)"


TREE = """newest AS (SELECT parent, arg_max(relpath, {'leaf': NOT is_dir, 'name': name}) AS relpath FROM entries GROUP BY parent),
marked AS (SELECT *, relpath IN (SELECT relpath FROM newest) AS is_last FROM entries),
above AS (SELECT relpath, unnest(generate_series(1, depth - 1)) AS level,
  array_to_string(string_split(relpath, '/')[1:unnest(generate_series(1, depth - 1))], '/') AS folder FROM marked),
rails AS (SELECT a.relpath, string_agg(CASE WHEN m.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY level) AS rail
  FROM above a JOIN marked m ON m.relpath = a.folder GROUP BY a.relpath),
tree AS (SELECT m.relpath, m.is_dir, coalesce(rail, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name
  || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM marked m LEFT JOIN rails USING (relpath))"""

FILE_STATUS = f"""codes(xy, description) AS (VALUES {values(STATUS_TEXT)}),
file_status AS (SELECT coalesce(t.path, s.path) AS path, coalesce(s.xy, '') AS status_code,
  CASE WHEN s.xy IS NULL THEN 'Unchanged' ELSE coalesce(description, 'Unknown status') END AS status,
  t.path IS NOT NULL AS tracked,
  t.path IS NOT NULL AND coalesce(contains(s.xy, 'M') OR contains(s.xy, 'D') OR contains(s.xy, 'R'), false) AS modified,
  coalesce(left(s.xy, 1) NOT IN (' ', '?'), false) AS staged
  FROM tracked t FULL OUTER JOIN status s ON t.path = s.path LEFT JOIN codes c ON c.xy = s.xy)"""

LANGS = f"langs(ext_key, language) AS (VALUES {values(by_extension(LANGUAGES))})"
PER_EXT = """per_ext AS (SELECT coalesce(language, 'Other') AS language, f.ext_key AS extension, count(*) AS files,
  CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM f LEFT JOIN langs ON langs.ext_key = f.ext_key
  WHERE f.ext_key IS NOT NULL GROUP BY ALL)"""
LANGUAGE_STATS = """SELECT language, CAST(sum(files) AS BIGINT) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  count(*) AS extension_count,
  CAST(sum(files) AS DOUBLE) / (SELECT sum(files) FROM per_ext)::DOUBLE * 100 AS percentage
  FROM per_ext GROUP BY language"""

SIZE_CLASS = """CASE WHEN size_bytes < 1024 THEN '0-1KB' WHEN size_bytes < 10240 THEN '1KB-10KB'
  WHEN size_bytes < 102400 THEN '10KB-100KB' WHEN size_bytes < 1048576 THEN '100KB-1MB'
  WHEN size_bytes < 10485760 THEN '1MB-10MB' ELSE '10MB+' END"""
NOW = "TIMESTAMP '2024-03-01 00:00:00'"
AGE_CLASS = f"""CASE WHEN {NOW} - mtime < INTERVAL 24 HOURS THEN 'last_24_hours'
  WHEN {NOW} - mtime < INTERVAL 168 HOURS THEN 'last_week' WHEN {NOW} - mtime < INTERVAL 720 HOURS THEN 'last_month'
  WHEN {NOW} - mtime < INTERVAL 8760 HOURS THEN 'last_year' ELSE 'older' END"""

HTML_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;')"


def escaped(text: str) -> str:
    return HTML_ESCAPED.format(text)


def _quota_bytes() -> str:
    rows = ", ".join(f"({i}, {'NULL' if q is None else q})" for i, q in enumerate(QUOTA_BYTES))
    return f"quotas(n, quota_bytes) AS (VALUES {rows})"


def sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


FILES = (CORPUS, named("corpus"))
ALL_FILES = (CORPUS, PAGES, BOTH, named("both_"))
SNIFFED_FILES = (CORPUS, SNIFFED, named("sniffed"))
PROJECT_FILES = (PROJECTS, named("projects"))


def health_sql(select: str, *ctes: str) -> str:
    checks = """bool_or(NOT is_dir AND inside IN ('README.md', 'readme.md')) AS has_readme,
  bool_or(NOT is_dir AND inside IN ('LICENSE', 'license')) AS has_license,
  bool_or(NOT is_dir AND inside = '.gitignore') AS has_gitignore,
  bool_or(is_dir AND inside IN ('tests', 'test')) AS has_tests,
  bool_or(NOT is_dir AND ends_with(inside, '_test.go')) AS has_test_files"""
    table = f"""inner_ AS (SELECT *, string_split(relpath, '/')[1] AS project,
  array_to_string(string_split(relpath, '/')[2:], '/') AS inside FROM full_entries),
checks AS (SELECT project, {checks} FROM inner_ WHERE is_dir OR contains(relpath, '/') GROUP BY project)"""
    return sql(select, *PROJECT_FILES, ENTRIES, WITH_EMPTY, table, *ctes)


EMPTY_DIRS = "SELECT relpath FROM full_entries WHERE is_dir AND relpath NOT IN (SELECT parent FROM full_entries)"


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["entries"] = sql("SELECT * FROM entries", *FILES, ENTRIES)
    q["path_columns"] = sql(
        """SELECT relpath, base, dir, ext, CAST(len(string_split(relpath, '/')) AS INTEGER) AS depth,
        string_split(relpath, '/')[1] AS top FROM f""", *FILES)
    q["filter_dotfiles"] = sql(f"SELECT relpath FROM f WHERE NOT {DOTTED}", *FILES)
    q["filter_extensions"] = sql(f"SELECT relpath FROM f WHERE {WANTED}", *FILES)
    q["exclude_globs"] = sql(f"SELECT relpath FROM f WHERE NOT {EXCLUDED}", *FILES)
    q["tracked_only"] = sql(f"SELECT relpath, size_bytes FROM f WHERE {IN_TRACKED}", *FILES, TRACKED)
    q["ignore_rules"] = sql("SELECT * FROM rules", RULES)
    q["ignore_rules_apply"] = sql(
        "SELECT relpath, is_dir, is_ignored FROM judged", *FILES, ENTRIES, RULES, judged("entries", "q.is_dir"))
    q["ignore_rules_scoped"] = sql("SELECT * FROM scoped", *FILES, ENTRIES, SCOPED)
    q["max_size"] = sql("SELECT relpath, size_bytes FROM f WHERE size_bytes <= 2048", *FILES)
    q["size_quota"] = sql(
        """SELECT relpath, size_bytes, CAST(quota_bytes AS BIGINT) AS quota_bytes, quota_bytes IS NULL AS quota_invalid
        FROM corpus JOIN quotas ON CAST(substr(source, 4) AS INTEGER) % 10 = n
        WHERE coalesce(quota_bytes, 0) = 0 OR size_bytes <= quota_bytes""", CORPUS, _quota_bytes())
    q["classify_text"] = sql("SELECT relpath, is_text FROM sniff", *SNIFFED_FILES, SNIFF)
    q["nul_sniff"] = sql("SELECT relpath, is_binary FROM sniff", *SNIFFED_FILES, SNIFF)
    q["select_files"] = sql(
        f"""SELECT relpath, size_bytes, text FROM sniffj WHERE NOT {DOTTED} AND {IN_TRACKED} AND NOT is_ignored
        AND NOT {EXCLUDED} AND {WANTED} AND is_text AND size_bytes <= {SMALL}""",
        *FILES, TRACKED, RULES, SNIFF, judged("sniff", "false"), "sniffj AS (SELECT * FROM judged)")
    q["selection_audit"] = sql(
        f"""SELECT CASE WHEN {DOTTED} THEN 'dotfile' WHEN NOT {IN_TRACKED} THEN 'untracked'
          WHEN is_ignored THEN 'ignored' WHEN {EXCLUDED} THEN 'excluded' WHEN NOT {WANTED} THEN 'extension'
          WHEN NOT is_text THEN 'binary' WHEN size_bytes > {SMALL} THEN 'too_large' ELSE 'selected' END AS reason,
        count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM judged GROUP BY 1""",
        *SNIFFED_FILES, TRACKED, RULES, SNIFF, judged("sniff", "false"))
    q["dry_run_manifest"] = sql(
        f"SELECT relpath FROM sniff WHERE NOT {DOTTED} AND NOT {EXCLUDED} AND is_text", *SNIFFED_FILES, SNIFF)

    q["split_lines"] = sql(
        "SELECT relpath, line_no, line, max(strlen(line)) OVER (PARTITION BY relpath) >= 65536 AS line_too_long FROM lines",
        *ALL_FILES, LINES)
    q["line_count"] = sql(
        """SELECT relpath, CAST(length(text) - length(replace(text, chr(10), ''))
          + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count FROM f""",
        *ALL_FILES)
    q["classify_lines"] = sql("SELECT relpath, line_no, kind FROM kinds", *ALL_FILES, LINES, KINDS)
    q["classify_line_rows"] = sql(
        "SELECT relpath, line_no, kind FROM kinds", PAGES, named("page_corpus"), LINES, KINDS)
    q["classify_blocks"] = sql(
        "SELECT relpath, CAST(line_no AS BIGINT) AS line_no, kind FROM kinds", PAGES, SITE, named("site"), LINES, KINDS)
    q["block_metrics"] = sql("SELECT * FROM metrics", PAGES, SITE, named("site"), LINES, KINDS, METRICS)
    q["read_lines"] = sql(
        """SELECT folder, CAST(unnest(generate_series(1, len(ls) - 1)) AS BIGINT) AS line_no, regexp_replace(unnest(ls[1:len(ls)-1]), '\\r$', '') AS line
        FROM (SELECT folder, string_split(text, chr(10)) AS ls FROM folders)""", FOLDERS)
    q["read_files"] = sql("SELECT folder, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS content_sha256 FROM folders", FOLDERS)
    q["list_files"] = sql(
        """SELECT folder, 1 AS depth, true AS is_dir, CAST(NULL AS BIGINT) AS size_bytes, true AS at_top FROM folders
        UNION ALL SELECT folder, 2, false, CAST(strlen(text) AS BIGINT), false FROM folders""", FOLDERS)
    q["file_metrics"] = sql("SELECT * FROM metrics", *ALL_FILES, LINES, KINDS, METRICS)
    q["number_lines"] = sql(f"SELECT relpath, line_no, {WRITTEN} AS numbered FROM lines", *FILES, LINES)
    for name, formula in (
        ("code", code_tokens), ("data", data_tokens), ("text", text_tokens), ("default", default_tokens)
    ):
        q[f"tokens_{name}"] = sql(
            f"SELECT relpath, line_no, {formula('line')} AS tokens FROM lines", *ALL_FILES, LINES)
    q["estimate_tokens"] = sql("SELECT relpath, tokens FROM tokens", *ALL_FILES, LINES, TOKENS)
    q["tokens_rough"] = sql("SELECT CAST(sum(size_bytes // 4) AS BIGINT) AS tokens FROM f", *FILES)

    q["basic_stats"] = sql(
        """SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size,
        count(*) FILTER (is_text) AS text_files, count(*) FILTER (NOT is_text) AS binary_files,
        CAST(sum(CASE WHEN is_text THEN tokens ELSE 0 END) AS BIGINT) AS estimated_tokens
        FROM sniff JOIN tokens USING (relpath)""", *SNIFFED_FILES, SNIFF, LINES, TOKENS)
    q["directory_count"] = sql(
        "SELECT count(*) FILTER (is_dir) + 1 AS total_directories FROM entries", *FILES, ENTRIES)
    q["average_file_size"] = sql(
        "SELECT CAST(sum(size_bytes) AS DOUBLE) / count(*) AS average_file_size FROM f", *ALL_FILES)
    q["extension_topk"] = sql(
        """SELECT ext AS extension, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
        FROM f WHERE ext <> '' GROUP BY ext ORDER BY files DESC, ext LIMIT 5""", *ALL_FILES)
    q["size_distribution"] = sql(
        f"""SELECT bucket, count(f.relpath) AS files FROM (VALUES ('0-1KB'), ('1KB-10KB'), ('10KB-100KB'),
        ('100KB-1MB'), ('1MB-10MB'), ('10MB+')) b(bucket) LEFT JOIN f ON {SIZE_CLASS} = bucket GROUP BY bucket""", *ALL_FILES)
    ages = ", ".join(
        f"count(*) FILTER (age = '{a}') AS {a}" for a in ("last_24_hours", "last_week", "last_month", "last_year", "older"))
    q["mtime_distribution"] = sql(
        f"SELECT {ages}, min(mtime) AS oldest_file, max(mtime) AS newest_file FROM (SELECT *, {AGE_CLASS} AS age FROM f)", *FILES)
    q["complexity_totals"] = sql(
        """SELECT CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines,
        CAST(sum(comments) AS BIGINT) AS comment_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines,
        CAST(sum(code_lines) AS DOUBLE) / CAST(sum(lines) AS DOUBLE) * 100 AS code_density FROM metrics""",
        *ALL_FILES, LINES, KINDS, METRICS)
    q["language_metrics"] = sql(
        """SELECT ext_key, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code_lines) AS BIGINT) AS code_lines,
        CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(comments) AS BIGINT) AS comments,
        CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM metrics)::DOUBLE * 100 AS percentage FROM metrics GROUP BY ext_key""",
        *ALL_FILES, LINES, KINDS, METRICS)
    q["complex_files"] = sql(
        "SELECT relpath, lines, complexity_score FROM metrics WHERE lines > 300 OR complexity_score > 20",
        *ALL_FILES, LINES, KINDS, METRICS)
    q["language_stats"] = sql(LANGUAGE_STATS, *ALL_FILES, LANGS, PER_EXT)
    q["language_extensions"] = sql("SELECT * FROM per_ext", *ALL_FILES, LANGS, PER_EXT)
    q["top_languages"] = sql(
        f"SELECT * FROM ({LANGUAGE_STATS}) ORDER BY files DESC, language LIMIT 4", *ALL_FILES, LANGS, PER_EXT)
    q["presence_checks"] = health_sql("SELECT * FROM checks")
    q["large_files"] = sql(
        f"""SELECT relpath, size_bytes, printf('%s (%.2fMB)', relpath, size_bytes / 1048576.0::DOUBLE) AS label
        FROM f WHERE size_bytes > {LARGE}""", *FILES)
    q["empty_directories"] = sql(EMPTY_DIRS, *FILES, ENTRIES, WITH_EMPTY)
    q["health_check"] = health_sql(
        """SELECT project, has_readme, has_license, has_gitignore, has_tests, has_test_files, large_files,
        empty_directories, binary_files, array_to_string(list_filter([
          CASE WHEN NOT has_readme THEN 'No README.md file found' END,
          CASE WHEN NOT has_license THEN 'No LICENSE file found' END,
          CASE WHEN NOT has_gitignore THEN 'No .gitignore file found' END,
          CASE WHEN NOT has_tests AND NOT has_test_files THEN 'No tests found' END,
          CASE WHEN large_files > 0 THEN 'Large files detected: ' || large_files END,
          CASE WHEN empty_directories > 0 THEN 'Empty directories: ' || empty_directories END,
          CASE WHEN binary_files > 0 THEN 'Binary files: ' || binary_files || ' (consider adding to .gitignore)' END],
          lambda x: x IS NOT NULL), '; ') AS warnings FROM counted""",
        f"empty_ AS ({EMPTY_DIRS})",
        f"""counted AS (SELECT c.*,
        (SELECT count(*) FROM f WHERE string_split(f.relpath, '/')[1] = project AND size_bytes > {LARGE}) AS large_files,
        (SELECT count(*) FROM empty_ WHERE string_split(empty_.relpath, '/')[1] = project) AS empty_directories,
        (SELECT count(*) FROM f WHERE string_split(f.relpath, '/')[1] = project AND contains(text, chr(0))) AS binary_files
        FROM checks c)""")
    measures = """count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
      CAST(sum(CASE WHEN is_text THEN tokens ELSE 0 END) AS BIGINT) AS tokens, count(lines) AS measured,
      CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, CAST(coalesce(sum(code_lines), 0) AS BIGINT) AS code_lines,
      CAST(coalesce(sum(blank_lines), 0) AS BIGINT) AS blank_lines, CAST(coalesce(sum(comments), 0) AS BIGINT) AS comments,
      coalesce(sum(complexity_score), 0::DOUBLE) AS complexity_score FROM wide"""
    wide = f"""wide AS (SELECT s.*, tokens, m.lines, code_lines, blank_lines, comments, complexity_score,
      CASE WHEN s.ext_key IS NULL THEN '' ELSE coalesce(language, 'Other') END AS language,
      {SIZE_CLASS} AS size_bucket, {AGE_CLASS} AS age_bucket, CASE WHEN is_text THEN 'text' ELSE 'binary' END AS kind
      FROM sniff s JOIN tokens USING (relpath) LEFT JOIN metrics m ON m.relpath = s.relpath
      LEFT JOIN langs ON langs.ext_key = s.ext_key)"""
    measures = measures.replace(" FROM wide", """, count(*) FILTER (lines > 300 OR complexity_score > 20) AS complex_files,
      min(mtime) AS oldest, max(mtime) AS newest,
      count(*) / (SELECT count(*) FROM wide)::DOUBLE * 100 AS percentage FROM wide""")
    empty = "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
    root = "contains(relpath, '/')"
    findings = {
        "has_readme": "count(*) FILTER (relpath IN ('README.md', 'readme.md')) > 0",
        "has_license": "count(*) FILTER (relpath IN ('LICENSE', 'license')) > 0",
        "has_gitignore": "count(*) FILTER (relpath = '.gitignore') > 0",
        "has_tests": f"any_value((SELECT count(*) FROM dirs WHERE NOT {root} AND relpath IN ('tests', 'test'))) > 0",
        "has_test_files": "count(*) FILTER (ends_with(relpath, '_test.go')) > 0",
        "large_files": "count(*) FILTER (size_bytes > 10485760)",
        "empty_directories": "any_value((SELECT count(*) FROM dirs WHERE relpath NOT IN (SELECT parent FROM entries)))",
        "binary_files": "count(*) FILTER (contains(text, chr(0)))",
    }
    sums = [f"SELECT '{d}' AS section, {d} AS item, {measures} GROUP BY {d}" for d in ("ext", "language", "size_bucket", "age_bucket", "kind")]
    sums.append(f"SELECT 'total' AS section, '' AS item, {measures}")
    sections = " UNION ALL ".join(
        sums
        + [f"SELECT 'directories', '', (SELECT count(*) + 1 FROM dirs), {empty}"]
        + [f"SELECT 'health', '{name}', CAST({count} AS BIGINT), {empty} FROM f" for name, count in findings.items()])
    left = [part.replace("FROM documents)", "FROM documents WHERE doc_id % 15 <> 0 OR doc_id % 30 = 0)") for part in FILES]
    q["profile_incremental"] = sql(" UNION ALL ".join(sums), *left, SNIFF, LINES, KINDS, METRICS, TOKENS, LANGS, wide)
    q["profile_report"] = sql(sections, *FILES, ENTRIES, SNIFF, LINES, KINDS, METRICS, TOKENS, LANGS, wide)

    q["tree_order"] = sql(
        f"SELECT relpath, is_dir, row_number() OVER (ORDER BY {order_key()}) AS position FROM entries", *FILES, ENTRIES)
    q["render_tree"] = sql("SELECT relpath, is_dir, line FROM tree", *FILES, ENTRIES, TREE)
    q["budget_cut"] = sql("SELECT relpath, line_no, written AS line FROM kept WHERE fits", *FILES, LINES, BUDGETED)
    q["truncation_rows"] = sql(
        f"""SELECT relpath, '{TRUNCATED}' AS message FROM kept WHERE size_bytes <= {SMALL}
        GROUP BY relpath HAVING bool_or(NOT fits)""", *FILES, LINES, BUDGETED)
    q["too_large_rows"] = sql(
        f"SELECT relpath, {too_large_note('size_bytes')} AS message FROM f WHERE size_bytes > {SMALL}", *FILES)
    q["budget_by_conversation"] = sql(
        f"""SELECT conv_id, turn, role, text, running FROM (SELECT *, CAST(sum(strlen(text)) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM conversations)
        WHERE running <= {CONVERSATION_BUDGET}""")

    q["file_status"] = sql("SELECT * FROM file_status", CORPUS, TRACKED, STATUS, FILE_STATUS)
    q["status_summary"] = sql(
        """SELECT count(*) AS total_files, count(*) FILTER (tracked) AS tracked_files,
        count(*) FILTER (NOT tracked) AS untracked_files, count(*) FILTER (modified) AS modified_files,
        count(*) FILTER (staged) AS staged_files FROM file_status""", CORPUS, TRACKED, STATUS, FILE_STATUS)
    q["changed_files"] = sql(
        "SELECT * FROM file_status WHERE status_code <> ''", CORPUS, TRACKED, STATUS, FILE_STATUS)
    q["parse_porcelain"] = sql("SELECT path, xy FROM status", CORPUS, STATUS)

    body = lambda row: f"coalesce(string_agg({row} || chr(10), '' ORDER BY line_no), '')"
    joined = "FROM f LEFT JOIN lines l ON l.relpath = f.relpath GROUP BY f.relpath"
    rule = "-" * 80
    q["render_text"] = sql(
        f"SELECT f.relpath, chr(10) || f.relpath || ':' || chr(10) || '{rule}' || chr(10) || {body(WRITTEN)} AS block {joined}",
        *FILES, LINES)
    fence = case("substr(any_value(f.ext), 2)", FENCES, "substr(any_value(f.ext), 2)")
    q["render_markdown"] = sql(
        f"""SELECT f.relpath, chr(10) || '### ' || f.relpath || chr(10) || '```' || {fence} || chr(10)
        || {body("CAST(line_no AS VARCHAR) || ' | ' || line")} || '```' || chr(10) AS block {joined}""", *ALL_FILES, LINES)
    span = f"""'<span class="line"><span class="line-number">' || CAST(line_no AS VARCHAR) || '</span>' || {escaped('line')} || '</span>'"""
    q["render_html"] = sql(
        f"""SELECT f.relpath, '        <div class="file">' || chr(10) || '            <div class="file-header">' || {escaped('f.relpath')}
        || '</div>' || chr(10) || '            <div class="file-content">' || chr(10) || {body(span)}
        || '            </div>' || chr(10) || '        </div>' || chr(10) AS block {joined}""", *ALL_FILES, LINES)
    reason = f"""CASE WHEN {DOTTED} THEN 'dotfile' WHEN {EXCLUDED} THEN 'excluded' WHEN NOT is_text THEN 'binary' ELSE '' END"""
    exported = f"""reasons AS (SELECT *, {reason} AS why FROM sniff),
chosen AS (SELECT * FROM reasons WHERE why = '')"""
    records = (
        f"""SELECT 'corpus/' || r.relpath AS path, r.relpath AS relative_path, 'text' AS type, r.size_bytes,
        CAST(length(r.text) - length(replace(r.text, chr(10), ''))
          + CASE WHEN r.text <> '' AND NOT ends_with(r.text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
        substr(r.ext, 2) AS extension,
        CASE WHEN why <> '' OR r.size_bytes > {SMALL} THEN '' WHEN coalesce(lost, false) THEN fitting ELSE r.text END AS content,
        why <> '' OR r.size_bytes > {SMALL} AS skipped,
        CASE WHEN why <> '' THEN why WHEN r.size_bytes > {SMALL} THEN 'too_large' ELSE '' END AS skip_reason,
        why = '' AND r.size_bytes <= {SMALL} AND coalesce(lost, false) AS truncated
        FROM reasons r LEFT JOIN (SELECT relpath, bool_or(NOT fits) AS lost,
          coalesce(string_agg(line || chr(10), '' ORDER BY line_no) FILTER (fits), '') AS fitting FROM kept GROUP BY relpath) k
        ON k.relpath = r.relpath""")
    recorded = (*SNIFFED_FILES, SNIFF, exported, LINES.replace(" FROM f)", " FROM chosen)"), BUDGETED)
    q["export_files"] = sql(records, *recorded)
    total = lambda name, value: f"SELECT 'total', '{name}', CAST({value} AS VARCHAR) FROM chosen"
    q["json_document"] = sql(
        f"""SELECT 'file' AS kind, path AS name, concat_ws('|', size_bytes, line_count, extension, skipped, skip_reason, truncated, sha256(content)) AS value
        FROM records UNION ALL SELECT 'tree', line, '' FROM tree
        UNION ALL {total('total_files', 'count(*)')} UNION ALL {total('total_directories', '(SELECT count(*) + 1 FROM dirs)').replace(' FROM chosen', '')}
        UNION ALL {total('total_size_bytes', 'CAST(sum(size_bytes) AS BIGINT)')}
        UNION ALL {total('estimated_tokens', 'CAST(sum(size_bytes // 4) AS BIGINT)')}
        UNION ALL {total('text_files', 'count(*) FILTER (is_text)')} UNION ALL {total('binary_files', 'count(*) FILTER (NOT is_text)')}
        UNION ALL {total('truncated', '(SELECT bool_or(truncated) FROM records)').replace(' FROM chosen', '')}""",
        *recorded, f"records AS ({records})", ENTRIES, TREE)
    q["export_metadata"] = sql(
        f"""SELECT 'corpus' AS target_directory, count(*) AS total_files,
        (SELECT count(*) + 1 FROM dirs) AS total_directories, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
        CAST(sum(size_bytes // 4) AS BIGINT) AS estimated_tokens, count(*) FILTER (is_text) AS text_files,
        count(*) FILTER (NOT is_text) AS binary_files, false AS truncated, 'md,txt,.go,py' AS extensions_filter,
        '8KB' AS max_file_size, CAST({BUDGET} AS BIGINT) AS character_limit FROM sniff""", *FILES, ENTRIES, SNIFF)
    chosen = f"chosen AS (SELECT * FROM sniff WHERE NOT {DOTTED} AND NOT {EXCLUDED} AND is_text)"
    chosen_lines = LINES.replace(" FROM f)", " FROM chosen)")
    text_bundle = f"""SELECT 1 AS section, relpath, line || chr(10) AS block FROM tree UNION ALL SELECT 2, '', chr(10) UNION ALL
        SELECT 3, c.relpath, chr(10) || c.relpath || ':' || chr(10) || '{rule}' || chr(10)
          || CASE WHEN c.size_bytes > {SMALL} THEN {too_large_note('c.size_bytes')} || chr(10) ELSE coalesce(b.body, '') END
        FROM chosen c LEFT JOIN (SELECT relpath,
            coalesce(string_agg(written || chr(10), '' ORDER BY line_no) FILTER (fits), '')
            || CASE WHEN bool_or(NOT fits) THEN '{TRUNCATED}' || chr(10) ELSE '' END AS body
          FROM kept GROUP BY relpath) b ON b.relpath = c.relpath"""
    parts = (*FILES, ENTRIES, TREE, SNIFF, chosen, chosen_lines)
    q["bundle"] = sql(text_bundle, *parts, BUDGETED)
    q["bundle_written"] = sql(
        f"""SELECT line, count(*) AS n FROM (
        SELECT unnest(string_split(regexp_replace(block, '\\n$', ''), chr(10))) AS line FROM ({text_bundle})) GROUP BY line""",
        *parts, BUDGETED)
    chosen_joined = "FROM chosen f LEFT JOIN lines l ON l.relpath = f.relpath GROUP BY f.relpath"
    q["bundle_markdown"] = sql(
        f"""SELECT 0 AS section, '' AS relpath, '# Project Structure' || chr(10) || chr(10) || '## Directory Tree' || chr(10) || '```' || chr(10) AS block
        UNION ALL SELECT 1, relpath, line || chr(10) FROM tree
        UNION ALL SELECT 2, '', chr(10) || '```' || chr(10) || chr(10) || '## Files' || chr(10)
        UNION ALL SELECT 3, f.relpath, chr(10) || '### ' || f.relpath || chr(10) || '```' || {fence} || chr(10)
        || {body("CAST(line_no AS VARCHAR) || ' | ' || line")} || '```' || chr(10) {chosen_joined}""", *parts)
    q["bundle_html"] = sql(
        f"""SELECT 0 AS section, '' AS relpath, '<div class="tree">' AS block
        UNION ALL SELECT 1, relpath, {escaped('line')} || '<br>' FROM tree
        UNION ALL SELECT 2, '', '</div>' || chr(10)
        UNION ALL SELECT 3, f.relpath, '        <div class="file">' || chr(10) || '            <div class="file-header">' || {escaped('f.relpath')}
        || '</div>' || chr(10) || '            <div class="file-content">' || chr(10) || {body(span)}
        || '            </div>' || chr(10) || '        </div>' || chr(10) {chosen_joined}""", *parts)
    counted = """CAST(length(text) - length(replace(text, chr(10), ''))
          + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"""
    q["bundle_json"] = sql(
        f"""SELECT 0 AS section, '' AS relpath, CAST(to_json({{'target_directory': '', 'scan_time': '', 'total_files': count(*),
          'total_directories': (SELECT count(*) + 1 FROM dirs), 'total_size_bytes': CAST(sum(size_bytes) AS BIGINT),
          'estimated_tokens': CAST(sum(size_bytes // 4) AS BIGINT), 'text_files': count(*) FILTER (is_text),
          'binary_files': count(*) FILTER (NOT is_text), 'options': {{'include_line_numbers': true,
          'extensions_filter': CAST([] AS VARCHAR[]), 'exclude_patterns': ['doc_1*', 'src3/*/*', '*.html'], 'format': 'json',
          'max_file_size': '', 'character_limit': 0, 'include_dotfiles': false}}, 'truncated': false}}) AS VARCHAR) AS block FROM chosen
        UNION ALL SELECT 1, relpath, CAST(to_json({{'relpath': relpath, 'is_dir': is_dir, 'line': line}}) AS VARCHAR) FROM tree
        UNION ALL SELECT 3, relpath, CAST(to_json({{'path': relpath, 'relative_path': relpath, 'type': 'text', 'size_bytes': size_bytes,
          'line_count': {counted}, 'extension': substr(ext, 2), 'content': text, 'skipped': false, 'skip_reason': '',
          'truncated': false}}) AS VARCHAR) FROM chosen""", *parts)
    q["corpus_growth"] = sql(
        """SELECT date_trunc('day', mtime)::TIMESTAMP AS window_start, date_trunc('day', mtime)::TIMESTAMP + INTERVAL 1 DAY AS window_end,
        count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM f JOIN tokens USING (relpath) GROUP BY 1""", *FILES, LINES, TOKENS)
    arrived = """arrived AS (SELECT doc_id % 3 AS batch, relpath, size_bytes, mtime, tokens FROM f JOIN tokens USING (relpath)
        UNION ALL SELECT 1, 'end', 0, TIMESTAMP '2099-01-01', 0),
      marks AS (SELECT b.batch, max(a.mtime) AS latest FROM (SELECT unnest([0, 1, 2, 3]) AS batch) b LEFT JOIN arrived a ON a.batch < b.batch GROUP BY 1),
      dayed AS (SELECT a.*, date_trunc('day', mtime)::TIMESTAMP AS day,
        coalesce(date_trunc('day', mtime)::TIMESTAMP + INTERVAL 2 DAY <= m.latest, false) AS is_late FROM arrived a JOIN marks m USING (batch))"""
    taken = (*FILES, LINES, TOKENS, arrived)
    q["growth_closed"] = sql(
        """SELECT day AS window_start, day + INTERVAL 1 DAY AS window_end, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
        CAST(sum(tokens) AS BIGINT) AS tokens, day + INTERVAL 2 DAY <= (SELECT latest FROM marks WHERE batch = 3) AS is_closed
        FROM dayed WHERE NOT is_late GROUP BY day""", *taken)
    q["growth_late"] = sql("SELECT relpath, CAST(size_bytes AS BIGINT) AS size_bytes, mtime FROM dayed WHERE is_late", *taken)
    q["corpus_stats_stream"] = sql(
        """SELECT ext AS extension, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
        count(*) FILTER (is_text) AS text_files, CAST(sum(CASE WHEN is_text THEN tokens ELSE 0 END) AS BIGINT) AS tokens
        FROM sniff JOIN tokens USING (relpath) GROUP BY ext""", *FILES, SNIFF, LINES, TOKENS)
    return q
