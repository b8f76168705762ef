"""DuckDB SQL of name cleaning: the rules as folds over lists of words."""

from __future__ import annotations

from kinforge.functions.cleaning import CLOSERS
from kinforge.functions.lexicon import BAD_NAMES, FIRST_PREFIXES, PREFIXES, SAINTS, SUFFIXES, TITLES


def _list(words) -> str:
    quoted = (w.replace("'", "''") for w in words)
    return "[" + ", ".join(f"'{w}'" for w in quoted) + "]"


_ENDINGS, _MEANINGS = _list(SUFFIXES), _list(SUFFIXES.values())
_BAD = _list(sorted(BAD_NAMES))
_EDGES = _list([CLOSERS])[1:-1]


def _upper(c: str) -> str:
    return f"regexp_replace(upper(regexp_replace(strip_accents(coalesce({c}, '')), '[^\\x00-\\x7F]', '', 'g')), '^\\s+|\\s+$', '', 'g')"


def _void(w: str) -> str:
    return f"(list_contains({_BAD}, {w}) or regexp_full_match({w}, '[0-9]+'))"


def _proper(words: str, more: str = "") -> str:
    return f"list_filter({words}, lambda w: not list_contains({_ENDINGS}, w) and not {_void('w')}{more})"


def _suffixes(words: str) -> str:
    """What the suffixes among some words stand for."""
    return f"list_transform(list_filter({words}, lambda w: list_contains({_ENDINGS}, w)), lambda w: {_MEANINGS}[list_position({_ENDINGS}, w)])"


def _joined(words: str, particles, letters: bool = False, saints: bool = False) -> str:
    """The fold behind functions.cleaning.joined: u units, h what is held, b the word before."""
    of = _list(particles)
    held = f"(case when list_contains({of}, x.b) then x.b else a.h || x.b end)"
    word = f"(case when list_contains({_list(SAINTS)}, a.b) then 'ST' || {held} else {held} end)" if saints else held
    rest = f"(case when list_contains({of}, x.b) then a.h else '' end)"
    glue = f"(list_contains({of}, {word})" + (f" or length({word}) = 1)" if letters else ")")
    step = f"case when {glue} then {{'u': a.u, 'h': {rest} || {word}, 'b': {word}}} else {{'u': a.u || [{word}], 'h': {rest}, 'b': {word}}} end"
    rows = f"list_transform({words}, lambda w: {{'u': cast([] as varchar[]), 'h': '', 'b': w}})"
    return f"list_reduce(list_prepend({{'u': cast([] as varchar[]), 'h': '', 'b': ''}}, {rows}), lambda a, x: {step})"


def _units(fold: str) -> str:
    return f"{fold}.u || case when {fold}.h <> '' then [{fold}.h] else [] end"


def _cut(c: str) -> str:
    """(t, p): a name without the suffixes it ends in, and their places."""
    ends = ", ".join(f"{{'t': {_list([e])[1:-1]}, 'p': [{k}]}}" for k, e in enumerate(SUFFIXES, 1))
    return f"list_reduce([{{'t': {c}, 'p': cast([] as int[])}}, {ends}], lambda a, x: case when ends_with(a.t, x.t) then {{'t': regexp_replace(left(a.t, length(a.t) - length(x.t)), '^\\s+|\\s+$', '', 'g'), 'p': a.p || x.p}} else a end)"


def _first_of(said: str) -> str:
    return f"list_filter({said}, lambda s: s <> '')[1]"


FIRST = f"""with a as (select idx, fname raw, regexp_replace(translate({_upper('fname')}, '10', 'IO'), '[''^]', '', 'g') g, regexp_replace(translate({_upper('mname')}, '10', 'IO'), '[''^]', '', 'g') m from preprocess_file_template),
 b as (select idx, raw, m plain, {_cut(f"(case when list_contains({_BAD}, g) then '' else g end)")} g, {_cut('m')} m from a),
 c as (select idx, raw, plain, list_transform(regexp_split_to_array(g.t, '[/\\[&\\\\(]'), lambda p: trim(p, {_EDGES})) parts, regexp_extract_all(m.t, '\\w+') mwords, list_min(g.p || m.p) place from b),
 d as (select *, {_proper('parts', f" and not list_contains({_list(sorted(TITLES))}, w)")} kept, array_to_string({_proper('mwords')}, ' ') middle from c),
 e as (select *, regexp_extract_all(coalesce(kept[1], ''), '\\w+') fwords from d),
 f as (select *, {_joined(_proper('fwords'), sorted(FIRST_PREFIXES), letters=True)} fold from e),
 g as (select *, {_units('fold')} units from f),
 h as (select *, regexp_replace(coalesce(units[1], ''), '[0-9]', '', 'g') first, units[2:] rest, trim(array_to_string(kept[2:], ''), {_EDGES}) other,
  {_first_of(f"[case when place is null then '' else {_MEANINGS}[place] end] || {_suffixes('parts')} || {_suffixes('mwords')} || {_suffixes('fwords')}")} suffix from g),
 i as (select * exclude (middle), case when len(rest) = 0 then middle else trim(regexp_replace(array_to_string(case when middle in (rest[-1], left(rest[-1], 1)) then rest else rest || [middle] end, ' '), '[0-9]', '', 'g')) end middle from h)
 select idx, case when coalesce(raw, '') = '' or first = 'JR' then null else nullif(first, '') end fname,
  case when coalesce(raw, '') = '' then nullif(plain, '') else nullif(case when middle = first then '' else middle end, '') end mname,
  case when coalesce(raw, '') = '' or other in (middle, first) then null else nullif(other, '') end altfname,
  case when coalesce(raw, '') = '' then null when first = 'JR' then 'JR' else suffix end suffix from i"""

_CARRIED = f"""list_reduce(list_prepend({{'r': cast([] as struct(c varchar, s varchar)[]), 's': '', 't': ''}}, list_transform(list_filter(parts, lambda p: not {_void('p')}), lambda p: {{'r': cast([] as struct(c varchar, s varchar)[]), 's': '', 't': trim(p, {_EDGES})}})),
  lambda a, x: case when {_first_of(f"list_filter({_ENDINGS}, lambda e: ends_with(x.t, e))")} is null then {{'r': a.r || [{{'c': x.t, 's': a.s}}], 's': a.s, 't': ''}}
   else {{'r': a.r || [{{'c': regexp_replace(left(x.t, length(x.t) - length(list_filter({_ENDINGS}, lambda e: ends_with(x.t, e))[1])), '^\\s+|\\s+$', '', 'g'), 's': {_MEANINGS}[list_position({_ENDINGS}, list_filter({_ENDINGS}, lambda e: ends_with(x.t, e))[1])]}}],
    's': {_MEANINGS}[list_position({_ENDINGS}, list_filter({_ENDINGS}, lambda e: ends_with(x.t, e))[1])], 't': ''}} end)"""
_WIDE = _list([CLOSERS + " "])[1:-1]

LAST = f"""with a as (select idx, {_upper('lname')} typed, {_upper('altlname')} given from preprocess_file_template),
 b as (select *, list_transform(regexp_split_to_array(typed, '[(\\[/\\\\]'), lambda p: translate(p, '10', 'IO')) parts from a),
 c as (select *, list_filter({_CARRIED}.r, lambda q: not list_contains({_BAD}, q.c)) got from b),
 d as (select *, typed <> '' and ({_void('parts[1]')} or len(got) = 0) nothing, case when typed = '' then '' else coalesce(got[1].c, '') end main,
  list_filter(list_transform(got[2:], lambda q: {{'c': trim(q.c, {_WIDE}), 's': q.s}}), lambda q: not list_contains({_BAD}, q.c)) others from c),
 e as (select *, contains(trim(main, '-'), '-') dashed, list_filter(string_split(main, '-'), lambda w: w <> '') dashes,
  trim(replace(trim(array_to_string(list_transform(others, lambda q: q.c), ' ')), '-', ''), {_WIDE}) more from d),
 f as (select *, {_joined(_proper('dashes'), sorted(PREFIXES))} fold1 from e),
 g as (select *, regexp_extract_all(case when dashed then array_to_string({_units('fold1')}, ' ') else main end, '\\w+') words from f),
 h as (select *, {_joined(_proper('words'), sorted(PREFIXES), saints=True)} fold2 from g),
 i as (select *, {_units('fold2')} units, {_first_of(f"[coalesce(got[1].s, '')] || list_transform(others, lambda q: q.s) || (case when dashed then {_suffixes('dashes')} else [] end) || {_suffixes('words')}")} suffix from h),
 j as (select *, regexp_replace(coalesce(units[1], ''), '[0-9]', '', 'g') last, case when more <> '' then more else array_to_string(units[2:], '') end rest from i),
 k as (select *, regexp_replace(case when given <> '' and given <> last then given else rest end, '[0-9 ]', '', 'g') other from j),
 l as (select * exclude (last, other), case when length(last) < length(other) and contains(other, last) then other else last end last, case when length(last) < length(other) and contains(other, last) then '' else other end other from k)
 select idx, case when nothing then null else nullif(last, '') end lname, case when nothing or typed = '' then null else suffix end suffix, case when nothing or contains(last, other) then null else nullif(other, '') end altlname from l"""
