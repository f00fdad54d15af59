"""The same queries in DuckDB SQL, written on their own: list functions and RE2 where the Spark side has higher-order functions and Java patterns."""

from __future__ import annotations

from codequarry.operators.rule_table import all_rules
from codequarry.sources.corpus import TEMPLATES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FILES = f"""
files as (
  select case when l_orderkey % 11 = 0 then 'tests/' else 'src/' end || 'f' || l_orderkey || '.rs' as path,
         string_agg(text, chr(10) order by l_linenumber, l_partkey, l_suppkey, text) || case when l_orderkey % 3 = 0 then chr(10) else '' end as content
  from (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
               replace([{", ".join(_quoted(t) for t in TEMPLATES)}][((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(TEMPLATES)})::int + 1], '{{k}}', l_partkey::varchar) as text
        from lineitem)
  group by l_orderkey)"""

LINES = """
cut as (select path, string_split(content, chr(10)) as parts, content like '%' || chr(10) as ended from files),
lines as (
  select path, line::int as line, case when ended and line = len(parts) - 1 then parts[line] || chr(10) else parts[line] end as text
  from (select path, parts, ended, unnest(range(1, len(parts) + case when ended then 0 else 1 end)) as line from cut))"""

RULES = "rules(rule_id, rule_name, category, severity) as (values " + ", ".join(f"({_quoted(r.rule_id)}, {_quoted(r.rule_name)}, {_quoted(r.category)}, {_quoted(r.severity)})" for r in all_rules()) + ")"

SUPPRESSED = r"""
comments as (
  select path, line, text, case when text like '%//%' then regexp_extract(text, '(?s)^.*?//(.*)$', 1) else regexp_extract(text, '(?s)/\*(.*?)(\*/|$)', 1) end as comment
  from lines where text like '%//%' or text like '%/*%'),
named as (
  select path, line, text, 'file' as form, substr(comment, strpos(comment, 'scan-ignore-file') + 16) as rest from comments where contains(comment, 'scan-ignore-file')
  union all
  select path, line, text, 'line', substr(comment, strpos(comment, 'scan-ignore') + 11) from comments
  where contains(comment, 'scan-ignore') and not starts_with(substr(comment, strpos(comment, 'scan-ignore') + 11), '-file')),
directives as (select * from (select path, line, form, text, unnest(regexp_split_to_array(rest, '[,\s]+')) as token from named) where token <> ''),
suppressed as (
  select distinct path, line, form, rule_id from directives, rules
  where lower(token) in ('all', lower(rule_id), lower(rule_name), lower(category)))"""

#: a comment whose text has no other stars and slashes, with comments in it
_COMMENT = r"/\*[^*/]*\*/"
for _ in range(40):
    _COMMENT = rf"/\*(?:[^*/]|{_COMMENT})*\*/"

TOKENS = r"""
split as materialized (
  select path, regexp_extract_all(content, '//[^\n]*|COMMENT|/\*(?s:.*?)(?:\*/|\z)|r"(?s:[^"]*)(?:"|\z)|r#"(?s:.*?)(?:"#|\z)|r##"(?s:.*?)(?:"##|\z)|"[^"\\]*(?:\\(?s:.)[^"\\]*)*(?:"|\\?\z)|''[^''\\]*(?:\\(?s:.)[^''\\]*)*(?:''|\\?\z)|[A-Za-z_][A-Za-z0-9_]*|[ \t\r\n\f]+|::|(?s:.)') as list
  from files),
every as (select path, list[i] as text, (i - 1)::int as idx from (select path, list, unnest(range(1, len(list) + 1)) as i from split)),
placed as (
  select path, idx, text,
         case when text like '//%' or text like '/*%' then 'comment' when regexp_matches(text, '^(r#*"|"|'')') then 'literal' when regexp_matches(text, '^[A-Za-z_]') then 'ident' when regexp_matches(text, '^\s') then 'space' else 'mark' end as kind,
         coalesce(sum(strlen(text)) over w, 0)::bigint as start, (1 + coalesce(sum(len(text) - len(replace(text, chr(10), ''))) over w, 0))::int as line,
         coalesce(sum(case text when '(' then 1 when ')' then -1 else 0 end) over w, 0)::int as parens, coalesce(sum(case text when '[' then 1 when ']' then -1 else 0 end) over w, 0)::int as brackets,
         coalesce(sum(case text when '{' then 1 when '}' then -1 else 0 end) over w, 0)::int as braces, lag(text) over (partition by path order by idx) as before
  from every window w as (partition by path order by idx rows between unbounded preceding and 1 preceding)),
ended as (select *, case when contains(text, chr(10)) then start + strlen(text) - strlen(regexp_extract(text, '[^\n]*\z')) end as line_start from placed),
tokens as materialized (
  select path, idx, text, kind, start, line, (start - coalesce(max(line_start) over (partition by path order by idx rows between unbounded preceding and 1 preceding), 0) + 1)::int as col,
         parens, brackets, braces, case when regexp_matches(before, '^[ \t\r\n\f]') then before else '' end as gap
  from ended qualify kind <> 'space')""".replace("COMMENT", _COMMENT)

PAIRS = """
levels as (select path, idx, text, start, line, parens - (text = ')')::int as level from tokens where text in ('(', ')')),
pairs as (select path, idx as open_idx, next_idx as close_idx from (select *, lead(idx) over w as next_idx, lead(text) over w as next from levels window w as (partition by path, level order by idx)) where text = '(' and next = ')')"""

CALLS = """
near as (select *, lag(text) over w as p1, lag(kind, 2) over w as k2, lead(text) over w as n1, lead(idx) over w as n1_idx, lead(text, 2) over w as n2, lead(idx, 2) over w as n2_idx from tokens window w as (partition by path order by idx)),
idents as (select *, coalesce(p1 in ('.', '::') and k2 = 'ident', false) as linked from near where kind = 'ident'),
islands as (select *, sum((not linked)::int) over (partition by path order by idx) as path_no from idents),
paths as (
  select *, string_agg(case when linked then p1 else '' end || text, '') over w as name, first(idx) over w as first_idx, first(line) over w as first_line, first(col) over w as first_col
  from islands window w as (partition by path, path_no order by idx)),
calls as (
  select path, first_idx as idx, first_line as line, first_col as col, name, case when linked and p1 = '.' then gap else '' end || string_split(name, '.')[-1] as method,
         case n1 when '(' then 'call' else 'macro' end as kind, case when n1 = '(' then n1_idx when n2 = '(' and n2_idx = n1_idx + 1 then n2_idx end as open_idx
  from paths where n1 in ('(', '!'))"""

TESTS = """
square as (select path, idx, text, brackets - (text = ']')::int as level from tokens where text in ('[', ']')),
square_pairs as (select path, idx, close_idx from (select *, lead(idx) over w as close_idx, lead(text) over w as next from square window w as (partition by path, level order by idx)) where text = '[' and next = ']'),
hashes as (select *, lag(text) over w as p1, lag(idx) over w as p1_idx, lead(text) over w as n1, lead(text, 2) over w as n2, lead(text, 3) over w as n3, lead(text, 4) over w as n4, lead(idx, 2) over w as i2, lead(idx, 4) over w as i4
           from tokens window w as (partition by path order by idx)),
attributes as (
  select h.path, h.idx - 1 as begin, coalesce(s.close_idx, 2147483647) as finish, h.line,
         (n1 || n2 = 'test]' and i2 = h.idx + 2) or (n1 || n2 || n3 || n4 in ('tokio::test]', 'actix_rt::test]', 'actix_web::test]', 'async_std::test]') and i4 = h.idx + 4) as is_test
  from hashes h left join square_pairs s on s.path = h.path and s.idx = h.idx where h.text = '[' and h.p1 = '#' and h.p1_idx = h.idx - 1),
core as (
  select t.path, t.idx, t.text, t.gap, coalesce(lag(t.idx) over w, -1) as before_idx, lead(t.text) over w as follows, lead(t.gap) over w as follow_gap
  from tokens t left join attributes a on a.path = t.path and t.idx between a.begin and a.finish
  where a.path is null and t.kind not in ('comment', 'literal') window w as (partition by t.path order by t.idx)),
curly as (select path, idx, text, line, braces - (text = '}')::int as level from tokens where text in ('{', '}')),
blocks as (select path, idx as open_idx, close_idx, end_line from (select *, lead(idx) over w as close_idx, lead(text) over w as next, lead(line) over w as end_line from curly window w as (partition by path, level order by idx)) where text = '{' and next = '}'),
marked as (
  select f.path, f.idx as fn_idx, max_by(a.line, a.begin) as line from core f join attributes a on a.path = f.path and a.is_test and a.begin < f.idx and a.begin > f.before_idx
  where f.text = 'fn' and (f.follow_gap <> '' or f.follows = '(') group by all),
opened as (select m.path, m.fn_idx, m.line, min(c.idx) as open_idx from marked m join core c on c.path = m.path and c.text = '{' and c.idx > m.fn_idx group by all),
tests as (
  select path, line, end_line, open_idx, close_idx from (
    select o.*, b.close_idx, b.end_line, max(b.close_idx) over (partition by o.path order by fn_idx rows between unbounded preceding and 1 preceding) as reach
    from opened o join blocks b on b.path = o.path and b.open_idx = o.open_idx)
  where reach is null or fn_idx > reach)"""

DECLARED = r"""
aside as (select *, lag(text) over w as p1, lead(text) over w as n1, lead(gap) over w as g1 from tokens window w as (partition by path order by idx)),
flagged as materialized (select *, (contains(gap, chr(10)) or p1 is null) and coalesce(starts_with(g1, ' '), false) and coalesce(text in ('let', 'const') or text = 'pub' and n1 = 'const', false) as begins from aside),
ends as (select path, idx, min(case when text = ';' then idx end) over (partition by path, parens, brackets, braces order by idx rows between 1 following and unbounded following) as after from flagged where begins or text = ';'),
scopes as (select path, idx, min(case when text = '}' then idx end) over (partition by path, braces order by idx rows between 1 following and unbounded following) as scope_end from flagged where begins or text = '}'),
spans as (
  select f.path, f.idx as begin, f.text as word, coalesce(e.after, 2147483647) as after, coalesce(s.scope_end, 2147483647) as scope_end
  from flagged f join ends e on e.path = f.path and e.idx = f.idx join scopes s on s.path = f.path and s.idx = f.idx where f.begins),
owned as (select *, max(case when begins then idx end) over (partition by path order by idx) as begin from flagged),
inner_tokens as materialized (select a.*, s.word, s.after, s.scope_end, row_number() over (partition by a.path, a.begin order by a.idx) as n,
                 max(case when contains(a.text, '=') and a.kind <> 'comment' then 1 else 0 end) over (partition by a.path, a.begin order by a.idx) as passed
          from owned a join spans s on s.path = a.path and s.begin = a.begin where a.idx > a.begin and a.idx < s.after),
pattern as (select *, max(n = 1 and text = 'mut' and starts_with(g1, ' ')) over (partition by path, begin) as mut_first, max(regexp_matches(text, '[(\[{,]')) over (partition by path, begin) as several
            from inner_tokens where word = 'let' and passed = 0),
bound as (
  select *, case when n = 1 or mut_first and n = 2 then null else p1 end as previous from pattern where not (n = 1 and mut_first)),
lets as (
  select path, text as name, idx, line, col, after, scope_end from bound
  where kind = 'ident' and not starts_with(text, '_') and (
    not several and n = case when mut_first then 2 else 1 end
    or several and text not in ('mut', 'ref', 'pub') and not coalesce(n1 in ('(', '{', '[') and regexp_matches(text, '^[A-Z]'), false) and not coalesce(starts_with(n1, ':'), false) and not coalesce(regexp_matches(previous, '[A-Za-z0-9_]$'), false))
  qualify row_number() over (partition by path, begin, text order by idx) = 1),
consts as (select path, text as name, idx, line, col, after, scope_end from inner_tokens
           where word <> 'let' and n = case word when 'pub' then 2 else 1 end and kind = 'ident' and regexp_matches(n1, '^[:=]') and not starts_with(text, '_'))"""


def _unused(declared: str) -> str:
    return f"""
uses as (select t.path, t.text as name, t.idx as use from tokens t where t.kind = 'ident' and exists (select 1 from {declared} d where d.path = t.path and d.name = t.text) and not exists (select 1 from {declared} d where d.path = t.path and d.idx = t.idx)),
used as (select distinct d.path, d.idx from {declared} d join uses u on u.path = d.path and u.name = d.name and u.use > d.idx and u.use < d.scope_end
         where not exists (select 1 from {declared} o where o.path = d.path and o.name = d.name and o.idx > d.idx and u.use >= o.after and u.use < o.scope_end)),
left_over as (select * from {declared} d where not exists (select 1 from used u where u.path = d.path and u.idx = d.idx))"""


#: relations over method chains: each level of parentheses as a stream of its own
CHAINS = r"""
stream as (select t.*, p.close_idx from tokens t left join pairs p on p.path = t.path and p.open_idx = t.idx where t.kind <> 'comment'),
segments as (select *, coalesce(kind = 'ident' and lag(text) over w = '::' and lag(kind, 2) over w = 'ident' and lag(idx, 2) over w = idx - 2, false) as inside from stream window w as (partition by path order by idx)),
headed as (select *, max(case when kind = 'ident' and not inside then idx end) over (partition by path order by idx) as head from segments),
rooted as (select *, string_agg(case when inside then '::' || text when kind = 'ident' then text else '' end, '') over (partition by path, head order by idx) as root from headed),
levelled as (
  select path, idx, text as mark, kind, head, root, line, col, close_idx, parens - (text = ')')::int as level from rooted
  union all select path, idx, 'cut', 'cut', null, null, line, col, null, parens + 1 from rooted where text = '('),
around as (select *, lag(mark) over w as p1, lag(mark, 2) over w as p2, lag(mark, 3) over w as p3, lag(kind, 2) over w as k2, lag(kind, 4) over w as k4, lead(mark) over w as n1, lead(idx) over w as n1_idx, lead(close_idx) over w as n1_close
           from levelled window w as (partition by path, level order by idx)),
judged as (select *, coalesce(kind = 'ident' and p1 = '.' and n1 = '(' and n1_close is not null and (k2 = 'ident' or p2 = ')' and p3 = '(' and k4 = 'ident'), false) as is_call from around where kind <> 'cut'),
owned as (select *, max_by(head, idx) filter (where kind = 'ident' and not is_call) over (partition by path, level order by idx) as owner from judged),
all_calls as (select path, owner as root_idx, idx, mark as name, line, col, n1_idx as open_idx, n1_close as close_idx from owned where is_call),
ends as (select path, head as root_idx, root, idx as root_end, case when n1 = '(' and n1_close is not null then n1_idx end as args_open, case when n1 = '(' and n1_close is not null then n1_close end as args_close
         from owned where kind = 'ident' and not is_call qualify row_number() over (partition by path, head order by idx desc) = 1),
whole as (
  select e.*, t.line, t.col, coalesce(c.n, 0) as n_calls, greatest(root_end, coalesce(args_close, root_end), coalesce(last_close, root_end)) as end_idx
  from ends e join tokens t on t.path = e.path and t.idx = e.root_idx
  left join (select path, root_idx, count(*) as n, max(close_idx) as last_close from all_calls group by all) c on c.path = e.path and c.root_idx = e.root_idx
  where coalesce(c.n, 0) > 0 or args_close is not null),
chains as (select * from (select *, max(case when n_calls > 0 then end_idx end) over (partition by path order by root_idx rows between unbounded preceding and 1 preceding) as reach from whole) where reach is null or root_idx > reach),
chain_calls as (select c.*, array_to_string(s.list[c.open_idx + 2 : c.close_idx], '') as args from all_calls c join chains h on h.path = c.path and h.root_idx = c.root_idx join split s on s.path = c.path)"""

_BALANCED = r"[^()]*"
for _ in range(10):
    _BALANCED = rf"[^()]*(?:\({_BALANCED}\)[^()]*)*"
_LITERAL = r'"[^"\\]*(?:\\(?s:.)[^"\\]*)*"|r"[^"]*"|r#"(?s:.*?)"#|r##"(?s:.*?)"##'
_ARGUMENT = _PLAIN = rf"(?:{_LITERAL}|[^()])*"
for _ in range(8):
    _ARGUMENT = rf"{_PLAIN}(?:\({_ARGUMENT}\){_PLAIN})*"


def _value(text: str) -> str:
    return f"""case when regexp_full_match({text}, {_quoted(_LITERAL)}) then case when starts_with({text}, 'r') then regexp_extract({text}, '(?s)^r#*"(.*)"#*$', 1) else regexp_replace({text}[2:-2], '(?s)\\\\(.)', '\\1', 'g') end end"""


SITES = rf"""
marked_lines as (select *, lead(text, 1) over w as t1, lead(text, 2) over w as t2, lead(text, 3) over w as t3, lead(text, 4) over w as t4, lead(text, 5) over w as t5 from lines window w as (partition by path order by line)),
statements_from as (
  select path, line, text, case when contains(text, ';') then '' else coalesce(chr(10) || t1 || case when contains(t1, ';') then '' else coalesce(chr(10) || t2 || case when contains(t2, ';') then '' else coalesce(chr(10) || t3 ||
         case when contains(t3, ';') then '' else coalesce(chr(10) || t4 || case when contains(t4, ';') then '' else coalesce(chr(10) || t5, '') end, '') end, '') end, '') end, '') end as later
  from marked_lines where regexp_matches(text, 'Regex(Builder)?::new\(')),
markers as (select path, line, text, later, unnest(list_filter(range(1, len(text) + 1), lambda i: starts_with(substr(text, i), 'Regex::new(') or starts_with(substr(text, i), 'RegexBuilder::new('))) as i from statements_from),
site_rests as (select path, line, substr(text, 1, i - 1) || regexp_extract(substr(text, i), '^Regex(?:Builder)?::new\(') as head, regexp_replace(substr(text, i), '^Regex(Builder)?::new\(', '') || later as rest from markers),
sites as (
  select distinct path, line, column_, arg, {_value('arg')} as pattern
  from (select path, line, strlen(head) + 1 as column_, regexp_replace(regexp_replace(regexp_extract(rest, {_quoted('^(' + _ARGUMENT + r')\)')}, 1), '^\s+', ''), '\s+$', '') as arg from site_rests where regexp_matches(rest, {_quoted('^(' + _ARGUMENT + r')\)')})))"""


def _word_hits(word: str, then: str) -> str:
    k = len(word)
    return (
        f"select path, line, text, strlen(substr(text, 1, i - 1)) + 1 as col from (select path, line, text, unnest(list_filter(range(1, len(text) - {k} + 2), lambda i: substr(text, i, {k}) = '{word}' "
        f"and (i = 1 or not regexp_matches(substr(text, i - 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]')) and not regexp_matches(substr(text, i + {k}, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]') and {then})) as i from lines where contains(text, '{word}'))"
    )


_CODE = r"not regexp_matches(text, '^\s*(//|\*|/\*)')"


def _line_rule(hits: str, message: str, code_only: bool) -> str:
    return f"cand as (select path, line, col::int as col, {_quoted(message)} as message, line as anchor, null::varchar as snippet from ({hits}){' where ' + _CODE if code_only else ''})"


def _pattern_hits(pattern: str, where: str = "true") -> str:
    """Starts of a pattern that cannot follow itself within a word."""
    return (
        f"select path, line, text, strlen(substr(text, 1, i - 1)) + 1 as col from (select path, line, text, unnest(list_filter(range(1, len(text) + 1), lambda i: regexp_matches(substr(text, i), {_quoted('^(?:' + pattern + ')')}) "
        f"and (i = 1 or not regexp_matches(substr(text, i - 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]')))) as i from lines where {where})"
    )


_AFTER = r"regexp_matches(substr(text, i + {k}), '^\s*{what}')"


def _macro(word: str) -> tuple[str, str]:
    return LINES, _line_rule(_word_hits(word, _AFTER.format(k=len(word), what="!")), f"`{word}!` macro found", True)


def _named_secret(word: str) -> str:
    return rf'(?i:[A-Za-z0-9_]*(?:{word})[A-Za-z0-9_]*)\s*(?::[^="]*)?=\s*&?r?#*"[^"]+"'


_TOKEN = _named_secret("token")
_KNOWN_TOKEN = r'"(?:gh[pousr]_[A-Za-z0-9]{10,}|xox[abp]-[A-Za-z0-9-]{10,})"'
_FN = r"fn(?:\z|[ (])"
_NESTED_ITEM = r"(?:\\.|\[[^\]]*\]|[^()\\\[])"


def _nested() -> str:
    inside, holds = f"{_NESTED_ITEM}*", rf"{_NESTED_ITEM}*[*+{{]{_NESTED_ITEM}*"
    for _ in range(2):
        inside, holds = rf"(?:{_NESTED_ITEM}|\({inside}\))*", rf"(?:{_NESTED_ITEM}|\({inside}\))*(?:[*+{{]|\({holds}\))(?:{_NESTED_ITEM}|\({inside}\))*"
    return rf"\({holds}\)[*+{{]"


_PRODUCT = "regexp_matches({}, '^(crate|super|self|product)::')"
_FACTS = f"""
bodies as (
  select t.path, t.line, t.open_idx, bool_or({_PRODUCT.format('c.name')}) as referenced, bool_or({_PRODUCT.format('c.name')} and c.kind = 'call') as called,
         bool_or(c.kind = 'macro' and c.name in ('assert', 'assert_eq', 'assert_ne', 'debug_assert', 'debug_assert_eq', 'debug_assert_ne')) as asserts,
         bool_and(c.kind = 'macro' and c.name in ('assert', 'assert_eq', 'assert_ne', 'debug_assert', 'debug_assert_eq', 'debug_assert_ne')) as only_asserts
  from tests t left join calls c on c.path = t.path and c.idx > t.open_idx and c.idx < t.close_idx group by all)"""


def _tests_cand(where: str, message: str) -> str:
    return f"cand as (select path, line, 1 as col, {_quoted(message)} as message, line as anchor, null::varchar as snippet from bodies where {where})"


_OUTSIDE = "from calls c join lines l on l.path = c.path and l.line = c.line where c.kind = 'call' and not regexp_matches(c.path, '(^|/)tests/') and not exists (select 1 from tests t where t.path = c.path and c.line between t.line and t.end_line) and " + _CODE.replace("(text", "(l.text")
_CONTEXT = "lower(concat_ws(' ', {}))"


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, {_quoted(w)})" for w in words) + ")"


_VALIDATION = _any("context", ("valid", "check", "allowed", "email", "username", "slug", "password", "token", "field", "match_ok"))
_SEARCH = _any("context", ("search", "find", "lookup", "grep", "scan for", "contains"))
_ARCHIVE = _any("context", ("archive", "extract", "unpack", "zip", "tar"))

#: rule number -> (further relations, relation cand(path, line, col, message, anchor, snippet))
RULE_SQL: dict[int, tuple[str, str]] = {
    1: _macro("todo"), 2: _macro("unimplemented"), 3: _macro("dbg"), 4: _macro("panic"),
    20: (LINES, _line_rule(_word_hits("unsafe", "not " + _AFTER.format(k=6, what=_FN)), "`unsafe` usage found", True)),
    21: (LINES, _line_rule(_word_hits("unsafe", _AFTER.format(k=6, what=_FN)), "`unsafe fn` declaration found", True)),
    40: (LINES, _line_rule(_pattern_hits(_named_secret("password|passwd|pwd")), "hardcoded password found", True)),
    41: (LINES, _line_rule(_pattern_hits(_named_secret("api_?key")), "hardcoded API key found", True)),
    42: (LINES, _line_rule(_pattern_hits(_named_secret("secret")), "hardcoded secret found", True)),
    43: (LINES, _line_rule(_pattern_hits(_TOKEN) + " union all " + _pattern_hits(_KNOWN_TOKEN, f"not regexp_matches(text, {_quoted('(?:^|[^A-Za-z0-9_])' + _TOKEN)})"), "hardcoded token found", True)),
    44: (LINES, _line_rule(_pattern_hits(r'"[a-z][a-z0-9+.-]*://[^\s:/@"]+:[^\s/@"]+@'), "URL with credentials found", True)),
    60: (LINES, """
found_at as (select path, content, i, substr(content, i, 5) as what, strlen(substr(content, 1, i - 1)) as start from (select path, content, unnest(list_filter(range(1, len(content) - 3), lambda i: substr(content, i, 5) in ('.max(', '.min('))) as i from files where contains(content, '.max(') and contains(content, '.min('))),
matched as (select a.path, a.content, a.i, min(b.i) as j from found_at a join found_at b on b.path = a.path and b.i > a.i and b.what <> a.what group by all),
cand as (select path, (1 + len(substr(content, 1, i - 1)) - len(replace(substr(content, 1, i - 1), chr(10), '')))::int as line, (len(regexp_extract(substr(content, 1, i - 1), '[^\\n]*\\z')) + 1)::int as col, 'manual clamp-like min/max chain found' as message,
         (1 + len(substr(content, 1, i - 1)) - len(replace(substr(content, 1, i - 1), chr(10), '')))::int as anchor,
         replace(regexp_replace(regexp_replace(substr(content, greatest(i - 20, 1), j + 24 - greatest(i - 20, 1) + 1), '^\\s+', ''), '\\s+$', ''), chr(10), ' ') as snippet
  from matched where strlen(substr(content, 1, j - 1)) - strlen(substr(content, 1, i - 1)) <= 235)"""),
    61: (LINES + r""",
beside as (select path, line, text, regexp_replace(text, '^\s+', '') as trimmed, coalesce(regexp_replace(lag(text) over w, '^\s+', ''), '') as above, coalesce(regexp_replace(lead(text) over w, '^\s+', ''), '') as below from lines window w as (partition by path order by line))""",
        "cand as (select path, line, (strlen(text) - strlen(trimmed) + 1)::int as col, 'empty doc comment found' as message, line as anchor, null::varchar as snippet from beside where trimmed in ('///', '//!') and not starts_with(above, trimmed) and not starts_with(below, trimmed))"),
    62: (LINES, r"cand as (select path, line, (strlen(text) - strlen(regexp_replace(text, '^\s+', '')) + 1)::int as col, 'empty comment found' as message, line as anchor, null::varchar as snippet from lines where regexp_replace(text, '^\s+', '') = '//' or regexp_replace(text, '\s+', '', 'g') = '/**/')"),
    63: (",".join((LINES, TOKENS, DECLARED, _unused("lets"))), "cand as (select path, line, col, 'unused variable `' || name || '`' as message, line as anchor, null::varchar as snippet from left_over)"),
    64: (",".join((LINES, TOKENS, DECLARED, _unused("consts"))), "cand as (select path, line, col, 'unused constant `' || name || '`' as message, line as anchor, null::varchar as snippet from left_over)"),
    65: (",".join((LINES, TOKENS, PAIRS, CALLS, TESTS, _FACTS)), "cand as (select path, min(line) as line, 1 as col, 'test code found without any product-code reference' as message, min(line) as anchor, null::varchar as snippet from bodies group by path having not bool_or(coalesce(referenced, false)))"),
    75: (",".join((LINES, TOKENS, PAIRS, CALLS, TESTS, _FACTS)), _tests_cand("not coalesce(referenced, false) and asserts and only_asserts", "test function uses assertions but does not call product code")),
    78: (",".join((LINES, TOKENS, PAIRS, CALLS, TESTS, _FACTS)), _tests_cand("called and not asserts", "test function calls product code without any assertion")),
    76: (",".join((LINES, TOKENS, PAIRS, CALLS, TESTS)), f"cand as (select c.path, c.line, c.col, 'non-test code uses `' || method || '`' as message, c.line as anchor, null::varchar as snippet {_OUTSIDE} and method in ('unwrap', 'expect', 'unwrap_err', 'expect_err'))"),
    77: (",".join((LINES, TOKENS, PAIRS, CALLS, TESTS)), f"cand as (select c.path, c.line, c.col, 'error mapping erases the original error value' as message, c.line as anchor, null::varchar as snippet {_OUTSIDE} and method in ('map_err', 'or_else') and exists (select 1 from pairs p join split s on s.path = p.path where p.path = c.path and p.open_idx = c.open_idx and regexp_matches(array_to_string(s.list[p.open_idx + 2 : p.close_idx], ''), '^\\s*\\|_\\|')))"),
    79: (",".join((LINES, TOKENS, PAIRS, CHAINS)) + ", neighbours as (select path, idx, lag(text) over w as previous, lead(text) over w as next from tokens window w as (partition by path order by idx))",
        f"cand as (select h.path, h.line, h.col, 'result of product call `' || root || '` is silently dropped' as message, h.line as anchor, null::varchar as snippet from chains h join neighbours a on a.path = h.path and a.idx = h.root_idx join neighbours b on b.path = h.path and b.idx = h.end_idx where {_PRODUCT.format('root')} and (a.previous is null or regexp_matches(a.previous, '[{{}};]$')) and b.next = ';')"),
    80: (",".join((LINES, SITES)), f"cand as (select path, line, column_::int as col, 'suspicious nested regex quantifier in pattern `' || pattern || '`' as message, line as anchor, null::varchar as snippet from sites where regexp_matches(pattern, {_quoted(_nested())}))"),
    81: (",".join((LINES, SITES)), "cand as (select path, line, column_::int as col, 'suspicious regex pattern `' || pattern || '`' as message, line as anchor, null::varchar as snippet from sites where contains(pattern, '.*.*') or contains(pattern, '.+.+') or (starts_with(pattern, '.*') and ends_with(pattern, '.*') and len(pattern) >= 4) or starts_with(pattern, '|') or ends_with(pattern, '|') or contains(pattern, '||') or contains(pattern, '(|') or contains(pattern, '|)'))"),
    82: (",".join((LINES, SITES)), f"cand as (select path, line, column_::int as col, 'dynamic regex pattern construction found' as message, line as anchor, null::varchar as snippet from sites where arg <> '' and pattern is null and not regexp_full_match(arg, {_quoted(r'concat!\(\s*(?:(?:' + _LITERAL + r')\s*(?:,\s*(?:' + _LITERAL + r')\s*)*,?\s*)?\)')}))"),
    83: (",".join((LINES, SITES)) + rf""",
match_lines as (select path, line, text, {_CONTEXT.format('lag(text, 2) over w, lag(text) over w, text, lead(text) over w, lead(text, 2) over w')} as context from lines window w as (partition by path order by line)),
checked as (select path, line as spot, text from match_lines where regexp_matches(text, 'is_match\(|captures\(') and ({_VALIDATION} or not {_SEARCH})),
tiles as (select path, spot, regexp_extract_all(text, {_quoted(_LITERAL + '|[^"r]+|(?s:.)')}) as tile from checked),
literals as (select path, spot, tile[i] as literal, strlen(array_to_string(tile[1 : i - 1], '')) + 1 as column_ from (select *, unnest(range(1, len(tile) + 1)) as i from tiles)),
own as (select path, spot, spot as line, column_, value from (select *, {_value('literal')} as value from literals) where regexp_matches(value, '[\[\]()+*?^$|{{}}.\\]') and not (starts_with(value, '^') and ends_with(value, '$'))),
close_by as (select c.path, c.spot, s.line, s.column_, s.pattern as value from checked c join sites s on s.path = c.path and s.line between c.spot - 2 and c.spot + 1
             where s.pattern is not null and not (starts_with(s.pattern, '^') and ends_with(s.pattern, '$')) and not exists (select 1 from own o where o.path = c.path and o.spot = c.spot) qualify row_number() over (partition by c.path, c.spot order by s.line, s.column_, s.pattern) = 1)""",
        "cand as (select path, line, column_::int as col, 'unanchored validation regex `' || value || '`' as message, spot as anchor, null::varchar as snippet from (select * from own union all select * from close_by))"),
    100: (LINES, _line_rule(_word_hits("Command", _AFTER.format(k=7, what=r"::new\(")), "`Command::new` usage found", False)),
    101: (",".join((LINES, TOKENS, PAIRS, CHAINS)) + r""",
env as (select path, list(name) as names from (select path, regexp_extract(text, '^\s*let \s*(?:mut \s*)?([\p{L}\p{M}\p{N}_]+)', 1) as name from lines where contains(text, 'env::var(') or contains(text, 'env::args(')) where name <> '' group by path),
shells as (select h.path, h.root_idx, h.line as chain_line from chains h join split s on s.path = h.path where ends_with(root, 'Command::new') and args_close is not null and trim(array_to_string(s.list[args_open + 2 : args_close], '')) in ('"sh"', '"bash"', '"cmd"', '"cmd.exe"', '"powershell"', '"pwsh"')),
arguments as (select c.*, s.chain_line, trim(c.args) in ('"-c"', '"/c"', '"/C"', '"-Command"') as flag, e.names from chain_calls c join shells s on s.path = c.path and s.root_idx = c.root_idx left join env e on e.path = c.path where c.name in ('arg', 'args')),
armed as (select *, coalesce(max(flag::int) over (partition by path, root_idx order by idx rows between unbounded preceding and 1 preceding), 0) = 1 as armed from arguments),
risky as (select * from armed where armed and not flag and (contains(args, 'format!(') or contains(args, 'concat!(') or contains(args, '.to_string()') or contains(args, 'push_str(') or contains(args, ' + ') or contains(args, 'env::var(') or contains(args, 'env::args(') or list_has_any(regexp_extract_all(args, '[\p{L}\p{M}\p{N}_]+'), coalesce(names, [])))
          qualify row_number() over (partition by path, root_idx order by idx) = 1)""",
        "cand as (select path, line, col, 'shell command built from dynamic input found' as message, chain_line as anchor, null::varchar as snippet from risky)"),
    120: (LINES + rf""",
joined_at as (select path, line, text, c, regexp_extract_all(text, c || {_quoted(chr(92) + '(' + _BALANCED + chr(92) + ')' + '|[^.]+|(?s:.)')}) as tile from lines, (values ('\.join'), ('\.push')) as v(c) where contains(text, '..')),
join_hits as (select path, line, c, tile[i] as call, strlen(array_to_string(tile[1 : i - 1], '')) + 1 as col from (select *, unnest(range(1, len(tile) + 1)) as i from joined_at))""",
        "cand as (select path, line, col::int as col, 'literal `..` path segment passed to `' || c[2:] || '`' as message, line as anchor, null::varchar as snippet from join_hits where regexp_matches(call, '^' || c || '\\(') and contains(substr(call, 7), '..') and regexp_matches(call, '[\"'']') "
        "union all select path, line, (strlen(string_split(text, 'PathBuf::from(')[1]) + 1)::int, 'literal `..` path segment passed to `PathBuf::from`', line, null from lines where contains(regexp_extract(text, 'PathBuf::from\\(([^)]*)\\)', 1), '..') and contains(regexp_extract(text, 'PathBuf::from\\(([^)]*)\\)', 1), '\"'))"),
    121: (",".join((LINES, TOKENS, PAIRS, CHAINS)), "cand as (select path, line, col, '`.' || name || '` call joins a path with untrusted-looking input `' || trim(args) || '`' as message, line as anchor, null::varchar as snippet from chain_calls where name in ('join', 'push') and trim(args) <> '' and not starts_with(trim(args), '\"') and " + _any("lower(args)", ("user", "input", "param", "arg", "req", "untrusted", "external", "query")) + ")"),
    122: (",".join((LINES, TOKENS, PAIRS, CHAINS)) + f""",
nearby as (select path, line, text, {_CONTEXT.format('lag(text, 2) over w, lag(text) over w, text, lead(text) over w')} as context, list(text) over (partition by path order by line rows between 4 preceding and 1 preceding) as before, list(text) over (partition by path order by line rows between 1 following and 4 following) as after from lines window w as (partition by path order by line)),
entry_joins as (select c.path, c.line, c.col, trim(c.args) as arg, n.text, n.before, n.after from chain_calls c join nearby n on n.path = c.path and n.line = c.line
  where c.name in ('join', 'push') and not starts_with(trim(c.args), '"') and {_ARCHIVE} and {_any('lower(c.args)', ('entry', 'file_name', 'header'))} and not {_any('lower(c.args)', ('enclosed_name(', 'mangled_name('))}),
assigned as (select *, nullif(regexp_extract(text, '^\\s*(?:let )?\\s*(?:mut )?\\s*([A-Za-z0-9_]+)\\s*(?::[^=]*)?=', 1), '') as target from entry_joins),
resolved as (select *, list_filter(after, lambda x: contains(x, target || '.canonicalize('))[-1] as made_at from assigned),
guards as (select *, nullif(regexp_extract(made_at, '^\\s*(?:let )?\\s*(?:mut )?\\s*([A-Za-z0-9_]+)\\s*(?::[^=]*)?=', 1), '') as real from resolved)""",
        "cand as (select path, line, col, 'archive extraction joins destination path with entry-derived input `' || arg || '`' as message, line as anchor, null::varchar as snippet from guards where not (regexp_full_match(arg, '[A-Za-z0-9_]+') and len(list_filter(coalesce(before, []), lambda x: contains(x, arg) and (contains(lower(x), 'enclosed_name(') or contains(lower(x), 'mangled_name(')))) > 0) and not coalesce(len(list_filter(after, lambda x: contains(x, real || '.starts_with('))) > 0, false))"),
}


def _prefilter(signatures: tuple[str, ...]) -> str:
    words = [s.lower() for s in signatures if s.replace("_", "a").isalnum()]
    parts = [f"list_has_any(list_transform(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)), [{', '.join(map(_quoted, words))}])"] if words else []
    return " or ".join(parts + [f"contains(content, {_quoted(s)})" for s in signatures if not s.replace("_", "a").isalnum()])


#: relations that several rules read: a query of many rules has them once
COMMON = (LINES, TOKENS, PAIRS, CALLS, TESTS, SITES)


def rule_sql(number: int, prefilter: bool = True, suppressions: bool = True, inside: bool = False) -> str:
    """Findings of one rule over the synthetic corpus, with or without prefilter and suppressions; inside: of a query that has files, COMMON and SUPPRESSED."""
    rule = next(r for r in all_rules() if r.rule_id == f"FE{number:03d}")
    relations, cand = RULE_SQL[number]
    head = f"{RULES}, {FILES}, {relations}, {SUPPRESSED}, "
    if inside:
        for shared in COMMON:
            relations = relations.replace(shared + ",", "").replace(shared, "")
        head = relations + ", " if relations.strip() else ""
    return f"""
with {head}{cand},
passed as (select path from files where {_prefilter(rule.signatures) if prefilter else "true"})
select '{rule.rule_id}' as rule_id, c.path as file, c.line as line, c.col as "column", c.message as message, coalesce(c.snippet, regexp_replace(regexp_replace(l.text, '^\\s+', ''), '\\s+$', '')) as snippet, '{rule.severity}' as severity
from cand c join lines l on l.path = c.path and l.line = c.anchor
where c.path in (select path from passed){f" and not exists (select 1 from suppressed s where s.path = c.path and s.rule_id = '{rule.rule_id}' and (s.form = 'file' or c.anchor in (s.line, s.line + 1)))" if suppressions else ""}
"""


def _many(numbers, prefilter: bool = True, suppressions: bool = True) -> str:
    """Findings of several rules, with the relations that they share evaluated once."""
    each = " union all ".join(f"({rule_sql(n, prefilter, suppressions, inside=True)})" for n in numbers)
    return f"with {', '.join([RULES, FILES, *COMMON, SUPPRESSED])} select * from ({each})"


def _with(*relations: str) -> str:
    return "with " + ", ".join([RULES, FILES, *relations])


def _findings() -> str:
    """The rows of all rules, dead suppressions included."""
    each = " union all ".join(f"({rule_sql(n, inside=True)})" for n in RULE_SQL)
    relations, select = _stale_parts("select file, rule_id from found")
    return f"with {', '.join([RULES, FILES, *COMMON, SUPPRESSED])}, found as materialized ({each}), {relations} select * from found union all ({select})"


def _counts(where: str, prefilter: bool = True) -> str:
    """Findings by rule of the rules of a condition, dead directives aside."""
    each = _many(RULE_SQL, prefilter)
    return f"with {RULES} select rule_id, count(*) as n, count(distinct file) as n_files from ({each}) where rule_id in (select rule_id from rules where {where}) group by 1"


def _text(value: str | None) -> str:
    return "null::varchar" if value is None else _quoted(value)


def scan_sql() -> str:
    """Findings of every rule with all their columns."""
    values = ", ".join(f"({_quoted(r.rule_id)}, {_quoted(r.rule_name)}, {_quoted(r.category)}, {_text(r.suggestion)}, {_text(r.suggestion_example)})" for r in all_rules())
    return f"""
select f.rule_id, t.rule_name, t.category, f.severity, f.file, f.line, f."column", f.message, f.snippet, t.suggestion, t.suggestion_example
from ({_findings()}) f join (values {values}) t(rule_id, rule_name, category, suggestion, suggestion_example) on t.rule_id = f.rule_id"""


def plain_sql() -> dict[str, str]:
    """The twins of the queries that are not about one rule."""
    found, hidden, loose = _many(RULE_SQL), _many(RULE_SQL, suppressions=False), _many(RULE_SQL, prefilter=False)
    each = " union all ".join(f"select '{r.rule_id}' as rule_id, count(*) as n_files from files where {_prefilter(r.signatures)} having count(*) > 0" for r in all_rules())
    chosen = _many([int(r.rule_id[2:]) for r in all_rules() if r.category in ("debug", "path")])
    syntax = (LINES, TOKENS, PAIRS)
    return {
        "q_lines": _with(LINES) + " select path, line, text from lines",
        "q_token_index": _with() + " select distinct path, lower(unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) as token from files",
        **dict.fromkeys(("q_tokens", "q_split_tokens"), _with(TOKENS) + " select path, idx, text, kind, line, col, parens::bigint as parens, brackets::bigint as brackets, braces::bigint as braces from tokens"),
        "q_invocations": _with(*syntax, CALLS) + " select path, idx, line, col, name, method, kind from calls",
        "q_method_chains": _with(*syntax, CHAINS) + " select path, root_idx, root, line, col, n_calls, end_idx from chains",
        "q_chain_calls": _with(*syntax, CHAINS) + " select path, root_idx, idx, name, line, col, args from chain_calls",
        "q_test_functions": _with(*syntax, CALLS, TESTS) + " select path, line, end_line, open_idx, close_idx from tests",
        "q_declarations": _with(TOKENS, DECLARED) + " select 'let' as binding, path, name, idx, line, col, after, scope_end from lets union all select 'const', path, name, idx, line, col, after, scope_end from consts",
        "q_regex_sites": _with(LINES, SITES) + " select path, line, column_::int as col, arg, pattern from sites",
        "q_env_bound_vars": _with(LINES) + r" select distinct path, name from (select path, regexp_extract(text, '^\s*let \s*(?:mut \s*)?([\p{L}\p{M}\p{N}_]+)', 1) as name from lines where contains(text, 'env::var(') or contains(text, 'env::args(')) where name <> ''",
        "q_directives": _with(LINES, SUPPRESSED) + " select path, line, form, token from directives",
        "q_suppressed_rules": _with(LINES, SUPPRESSED) + " select path, line, form, rule_id from suppressed",
        "q_prefilter_files": _with() + " " + each,
        "q_scan": scan_sql(),
        "q_severity_override": f"select rule_id, case rule_id when 'FE001' then 'critical' when 'FE063' then 'info' else severity end as severity, count(*) as n from ({_findings()}) group by 1, 2",
        "q_baseline_signatures": f"select concat_ws('|', rule_id, file, line, \"column\", replace(message, chr(10), '\\n')) as signature from ({_findings()})",
        "q_baseline_apply": f'select rule_id, file, line, "column" from ({_findings()}) where line % 2 = 1',
        "q_json_rows": f"""select rule_id, file, line, "column", message, to_json({{'rule_id': rule_id, 'rule_name': rule_name, 'category': category, 'severity': severity, 'file': file, 'line': line, 'column': "column", 'message': message, 'snippet': snippet,
            'suggestion': suggestion, 'suggestion_example': suggestion_example}})::varchar as json from ({scan_sql()})""",
        "q_dead_suppressions": _stale_sql(),
        "q_suppressed_findings": f'select rule_id, file, line, "column" from ({hidden}) except all select rule_id, file, line, "column" from ({found})',
        "q_prefilter_losses": f'select rule_id, file, line, "column" from ({loose}) except all select rule_id, file, line, "column" from ({found})',
        "q_rules_enabled": _counts("rule_id = 'FE003' or category not in ('debug', 'shell') and rule_id not in ('FE063', 'FE066')"),
        "q_rules_chosen": _counts("rule_id in ('FE001', 'FE063', 'FE120') and category in ('debug', 'path')"),
        "q_rules_maximum": _counts("rule_id <> 'FE066'", prefilter=False),
        "q_sarif_levels": f"select rule_id, severity, case when severity in ('critical', 'high') then 'error' when severity = 'warning' then 'warning' else 'note' end as level, count(*) as n from ({_findings()}) group by all",
        "q_chunk_order": _with() + f""", places as (select path, (row_number() over (order by string_split(path, '/')) - 1) // 256 as chunk from files)
            select chunk, rule_id, f.file, f.line, f."column" from ({chosen}) f join places on places.path = f.file""",
        "q_row_rule": f"""with {RULES.replace("(values ", "(values ('FE950', 'long-line', 'lint', 'info'), ")}, {FILES}, {LINES}, {SUPPRESSED}
            select 'FE950' as rule_id, path as file, line, 61 as "column", 'line of ' || len(rtrim(text, chr(10))) || ' characters' as message from lines l where len(rtrim(text, chr(10))) > 60
            and path in (select path from files where {_prefilter(("let",))}) and not exists (select 1 from suppressed s where s.path = l.path and s.rule_id = 'FE950' and (s.form = 'file' or l.line in (s.line, s.line + 1)))""",
        "q_path_globs": _with() + r" select path from files where starts_with(path, 'tests/') or regexp_full_match(path, '.*/[^/]*1[^/]\.rs') or regexp_full_match(path, 'src/(?:[^/]+/)*f2[^/]*\.rs')",
        "q_scan_summary": f"select rule_id, severity, count(*) as n from ({_findings()}) group by 1, 2",
        "q_rule_fe066": _stale_sql(only=True),
        "q_bench_stats": "select event_type, min(value) as min_value, max(value) as max_value, avg(value) as mean_value, list_sort(list(value))[len(list(value)) // 2 + 1] as median_value, count(*) as n from events group by event_type",
        "q_cache_misses": _with() + r" select path from files where regexp_extract(path, '(\d+)\.rs$', 1)::bigint % 2 = 1",
    }


def _stale_parts(active: str) -> tuple[str, str]:
    """(relations, select) of FE066, where files, lines and suppressions are there; active: file and rule_id of what was found."""
    return f"""active as ({active}),
form_lines as (select distinct path, line from directives where form = 'file'),
ids as (select d.path, d.line, d.text, upper(d.token) as rule_id from directives d where regexp_matches(upper(d.token), '^FE[0-9]{{3}}$')
        and (d.form = 'file' or not exists (select 1 from form_lines f where f.path = d.path and f.line = d.line)))""", """
select 'FE066' as rule_id, i.path as file, i.line as line, 1 as "column", 'suppression for `' || i.rule_id || '` does not match any finding in this file' as message, regexp_replace(regexp_replace(i.text, '^\\s+', ''), '\\s+$', '') as snippet, 'info' as severity
from ids i where not exists (select 1 from active a where a.file = i.path and a.rule_id = i.rule_id)
  and not exists (select 1 from suppressed s where s.path = i.path and s.rule_id = 'FE066' and (s.form = 'file' or i.line in (s.line, s.line + 1)))
"""


def _stale_sql(only: bool = False) -> str:
    """FE066; only: with no other rule on, so that no directive has a finding."""
    if not only:
        return f"select * from ({_findings()}) where rule_id = 'FE066'"
    relations, select = _stale_parts("select null::varchar as file, null::varchar as rule_id where false")
    rules = "rules(rule_id, rule_name, category, severity) as (values ('FE066', 'dead-suppression-comment', 'lint', 'info'))"
    return f"with {rules}, {FILES}, {LINES}, {SUPPRESSED}, {relations} {select}"
