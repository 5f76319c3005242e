"""The engine's rules on texts and layout items as DuckDB SQL, put together for the
oracles: expressions of one text, and the unit table of the documents' items."""

from __future__ import annotations

from ..functions import text as T

# Unicode's white space, and letters, for RE2
B = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
GREEK = "[Α-Ωα-ω]"
SPAN = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"
_NAMES = "MAP {" + ", ".join(f"'{letter}': '\\{name}'" for letter, name in T.GREEK.items()) + "}"
_ABBR = "|".join(a.replace(".", "[.]") for a in T.ABBREVIATIONS)


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{B}]+|[{B}]+$', '', 'g')"


def _parts(t: str, pattern: str, each: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{pattern}'), lambda s: {each}), '')"


def outside(t: str, change) -> str:
    return _parts(t, r"\$[^$]*\$|[^$]+|\$", f"case when s[1] = '$' then s else {change('s')} end")


def letters(t: str) -> str:
    # twice, as a match takes the characters around it; $ before one says it is done
    found = rf"'(^|[^$\p{{L}}\p{{M}}\p{{N}}_])([a-zA-Z][{B}]*=[{B}]*[a-zA-Z0-9]+)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1$\2$\3', 'g'"
    return outside(t, lambda s: f"regexp_replace(regexp_replace({s}, {found}), {found})")


def greek(t: str) -> str:
    tex = f"'$' || array_to_string(list_transform(string_split(g, ''), lambda c: coalesce(({_NAMES})[c], c)), '') || '$'"
    runs = lambda s: f"array_to_string(list_transform(regexp_extract_all({s}, '{GREEK}+|[^{GREEK[1:]}+'), lambda g: case when regexp_matches(g, '^{GREEK}') then {tex} else g end), '')"
    return outside(t, runs)


def normal(t: str) -> str:
    return greek(letters(t))


def sentences(t: str) -> str:
    marked = rf"""regexp_replace({t}, '([.!?]+["''”)\]]*)([{B}]+)([A-Z0-9"“(])', '\1' || chr(1) || '\2\3', 'g')"""
    kept = rf"regexp_replace({marked}, '((?:^|[{B}\x01])[^{B}A-Za-z0-9\x01]*(?:(?i:{_ABBR})|[A-Z][.]))\x01', '\1', 'g')"
    return f"list_filter(list_transform(string_split({kept}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


_SEGMENTS = SPAN + r"|[^$]+|\$"
_IS_SPAN = f"regexp_full_match({{}}, '{SPAN}')"
_COMPARED = r"replace(replace({}, '\textless', '<'), '\textgreater', '>')"


def escapes(t: str) -> str:
    return _parts(t, _SEGMENTS, f"case when {_IS_SPAN.format('s')} then {_COMPARED.format('s')} else s end")


def spans(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '{SPAN}'), lambda s: {_COMPARED.format('s')})"


def protected(t: str) -> str:
    segs = f"regexp_extract_all({t}, '{_SEGMENTS}')"
    nth = f"len(list_filter(list_slice({segs}, 1, i), lambda x: {_IS_SPAN.format('x')})) - 1"
    return f"array_to_string(list_transform({segs}, lambda s, i: case when {_IS_SPAN.format('s')} then '__MATH' || ({nth}) || '__' else s end), '')"


def leaks(t: str) -> str:
    runs = f"regexp_extract_all(regexp_replace({t}, '{SPAN}', '', 'g'), '[ -~Α-Ωα-ω]+')"
    return rf"list_filter(list_transform({runs}, lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-zΑ-Ωα-ω]') and (length(x) <= 4 or regexp_matches(x, '[()=_^{{}}]')))"


_MERGED = "'$' || replace({0}, '$', '') || '$'"


def call(t: str) -> str:
    """With its first call that has maths in it (texts hold one at most) drawn in."""
    found = rf"regexp_extract({t}, '(?:^|[^0-9A-Za-z_])([A-Za-z]{{1,4}}\((?:\$[^$\n]+\$|[{B}0-9A-Za-z,.’''_|+-])*\$(?:[^$\n]+\$|[{B}0-9A-Za-z,.’''_|+-])*\))', 1)"
    return f"case when {found} <> '' then replace({t}, {found}, {_MERGED.format(found)}) else {t} end"


def comparison(t: str) -> str:
    found = rf"regexp_extract({t}, '\$[^$\n]+\$[{B}]*(?:[<>=!]=|[<>≤≥≠])[{B}]*(?:-?[0-9]+(?:[.][0-9]+)?|\$[^$\n]+\$)')"
    return f"case when {found} <> '' then replace({t}, {found}, {_MERGED.format(found)}) else {t} end"


def escaped(t: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


def slug(tag: str) -> str:
    return rf"case when regexp_matches({tag}, '^P\d+-HEADING-') then regexp_extract({tag}, '^P\d+-HEADING-(.*)$', 1) else regexp_extract({tag}, '^P\d+-S\d+-(.*)-S\d+$', 1) end"


def level(name: str) -> str:
    return rf"least(4, 2 + greatest(len(regexp_extract_all(regexp_extract({name}, '^(?:\d+[.])*'), '\d+')) - 1, 0))"


NBSP, IDEO = chr(0xA0), chr(0x3000)
#: Layout items out of the documents' lines, five a page; both engines read these.
M, LEVEL, V, H = "(ord * 5 + doc_id) % 23", "case (ord * 3 + doc_id) % 13 when 4 then 1 when 9 then 2 end", "(ord + doc_id) % 4", "(ord + doc_id) % 3"
TYPE = "case m when 0 then 'header' when 1 then 'page_footnote' when 2 then 'image' when 3 then 'image' when 4 then 'equation' when 5 then 'equation' when 6 then 'list' when 7 then 'code' else 'text' end"
TEXT = (
    "case when m = 7 then concat('x = ', ord) when m = 4 then concat('$$x_', ord, ' ', chr(92), 'tag{', ord, '}$$') when m = 5 then '$$y$$' "
    f"when lvl = 1 and h = 0 then concat(ord, '. References') when lvl = 1 and h = 1 then concat(ord, '.1.{NBSP}', line) when v = 1 then concat('With t = ', ord, ' and γβ or ', line) "
    f"when v = 2 then concat(line, ' See $a${IDEO}> 1, f($x$, y) and $p ', chr(92), 'textless q$.') else line end"
)
CAPTION = f"concat('Fig.{NBSP}', ord, ': ', line)"
ENTRY = "concat('Item ', ord, '. Next.')"

ITEMS = f"""
src as (select doc_id, ls[i] as line, (i - 1)::int as ord from (select doc_id, string_split(text, chr(10)) as ls from documents), unnest(range(1, len(ls) + 1)) as r(i)),
k as (select *, {M} as m, {LEVEL} as lvl, {V} as v, {H} as h from src),
it as (select doc_id, ord, ord // 5 + 1 as page, m, lvl, line, {TYPE} as type, {TEXT} as text from k)"""

_NUMBERED = rf"^([A-Z0-9]+(?:[.][0-9]+)*)[.][{B}]+[^{B}][^\n]*$"
_RUN = "rows between unbounded preceding and current row"
LABELLED = f"""{ITEMS},
nt as (select * exclude (text), text, case when type in ('text', 'page_footnote') then {normal(strip('text'))} else text end as txt from it where type <> 'header'),
tx as (select *, type in ('text', 'page_footnote') and {strip('txt')} <> '' as tx from nt),
fr as (select *, tx and page = 1 and lvl is distinct from 2 and sum((tx and page = 1 and lvl is not distinct from 2 and upper(txt) <> 'ABSTRACT')::int) over (partition by doc_id order by page, ord {_RUN}) = 0 as free from tx),
rk as (select *, sum(free::int) over (partition by doc_id order by page, ord {_RUN}) as rk from fr),
lb as (select *, case when free and rk <= 3 then ['TITLE', 'AUTHORS', 'AFFIL'][rk::int] end as label from rk),
hd as (select *, coalesce(tx and label is null and lvl in (1, 2) and upper(txt) <> 'ABSTRACT', false) as is_heading from lb),
nm as (select *, case when is_heading then nullif(regexp_extract(txt, '{_NUMBERED}', 1), '') end as num from hd),
ow as (select *, sum((is_heading and num is null)::int) over (partition by doc_id order by ord {_RUN}) as own from nm),
hi as (select *, case when is_heading then coalesce(num, 'u' || own::int) || '.' || coalesce(nullif(lower(regexp_extract(case when num is null then txt else regexp_replace(txt, '^[A-Z0-9]+(?:[.][0-9]+)*[.][{B}]+', '') end, '^[A-Za-z]+')), ''), 'section') end as heading_id from ow),
se as (select *, coalesce(last_value(heading_id ignore nulls) over (partition by doc_id order by page, ord {_RUN}), 'abstract') as section from hi)"""

_OWN = "'P' || page || '-' || case when m in (2, 3) then 'FIG' else 'EQ' end || case when m in (2, 4) then ord::varchar else '-UNLABELED' || cnt::int end"
_FILE = "'images/' || case when m in (2, 3) then 'fig_p' else 'eq_p' end || page || case when m in (2, 4) then '_' || ord else '_unlabeled' || cnt::int end || '.png'"
UNITS = f"""{LABELLED},
el as (select *, sum((m in (3, 5))::int) over (partition by doc_id, page order by ord {_RUN}) as cnt, row_number() over (partition by doc_id, page, type order by ord) as un from se where type not in ('text', 'page_footnote') or tx),
un as (
  select doc_id, page, ord, section, 0 as pos, is_heading, lower(coalesce(label, 'heading')) as kind, 'P' || page || '-' || coalesce(label, 'HEADING-' || heading_id) as tag0, txt as en_text, null as image_path from el where label is not null or is_heading
  union all select doc_id, page, ord, section, i - 1, false, 'body_sentence', null, ps[i], null from (select *, {sentences('txt')} as ps from el where tx and label is null and not is_heading), unnest(range(1, len(ps) + 1)) as r(i)
  union all select doc_id, page, ord, section, i - 1, false, 'body_sentence', null, ps[i], null from (select *, list_filter([{normal(strip('line'))}, {normal(ENTRY)}], lambda x: x <> '') as ps from el where m = 6), unnest(range(1, len(ps) + 1)) as r(i)
  union all select doc_id, page, ord, section, 0, false, case when m in (2, 3) then 'figure_image' else 'equation_image' end, {_OWN}, '', {_FILE} from el where m in (2, 3, 4)
  union all select doc_id, page, ord, section, (m = 4)::int, false, 'equation_latex', {_OWN} || '-LATEX', text, null from el where m in (4, 5)
  union all select doc_id, page, ord, section, i, false, 'caption_sentence', {_OWN} || '-CAPTION-S' || i, ps[i], null from (select *, {sentences(normal(strip(CAPTION)) + " || ' note'")} as ps from el where m = 2), unnest(range(1, len(ps) + 1)) as r(i)
  union all select doc_id, page, ord, section, 0, false, 'unknown', 'P' || page || '-UNKNOWN-code-' || un, text, null from el where m = 7),
al as (select *, page::bigint * 4294967296 + ord as place, (kind = 'body_sentence')::int as body from un),
nu as (select *, sum(body) over (partition by doc_id order by place, pos {_RUN}) as every, sum(body) over (partition by doc_id, page order by place, pos {_RUN}) as on_page from al),
ns as (select *, every - coalesce(max(case when is_heading then every end) over (partition by doc_id order by place, pos {_RUN}), 0) as in_section from nu),
units as (select doc_id, place as ord, pos::int as pos, page::int as page, coalesce(tag0, 'P' || page || '-S' || on_page::int || '-' || section || '-S' || in_section::int) as tag, kind, en_text, image_path from ns)"""

_KINDS = "('title', 'heading', 'body_sentence', 'caption_sentence')"
_PREPARED = f"""{UNITS},
es as (select * replace (case when kind in {_KINDS} then {escapes('en_text')} else en_text end as en_text) from units),
tr as (select *, kind in {_KINDS} and not (kind in ('heading', 'body_sentence') and regexp_matches({slug('tag')}, '(?i)(^|[.])references$')) as translatable from es),
pt as (select *, case when translatable then {protected('en_text')} end as protected from tr),
dc as (select doc_id, concat_ws(chr(10), nullif(first(en_text order by ord, pos) filter (kind = 'title'), ''), nullif(string_agg(en_text, ' ' order by ord, pos) filter (kind = 'body_sentence' and tag like '%-abstract-%'), '')) as doc from es group by doc_id)"""
PREPARED = f"""{_PREPARED},
cx as (select pt.*, array_to_string(list(protected) over (partition by doc_id, translatable order by ord, pos rows between 3 preceding and 1 preceding), chr(10)) as near, doc from pt join dc using (doc_id)),
prepared as (select * exclude (near, doc), nullif(concat_ws(chr(10) || chr(10), nullif(doc, ''), nullif(near, '')), '') as context from cx)"""
CONTEXTS = _PREPARED
#: All units with ja_text, translated into themselves, maths repaired.
REPAIRED = f"""{_PREPARED},
repaired as (select * exclude (protected) replace (case when translatable then {comparison(call('en_text'))} else en_text end as en_text) from pt)"""

_PARA = "case when kind in ('body_sentence', 'caption_sentence') then case when kind = 'caption_sentence' then regexp_replace(tag, '-S\\d+$', '') else regexp_extract(tag, '^(P\\d+)-', 1) || '-' || " + slug("tag") + " end else tag || '#' || ord || '#' || pos end"


def blocks(of: str) -> str:
    return f"""
kb as (select *, {_PARA} as para from {of} where kind <> 'equation_image'),
lg as (select *, (para is distinct from lag(para) over (partition by doc_id order by ord, pos))::int as new from kb),
block as (select *, sum(new) over (partition by doc_id order by ord, pos {_RUN})::bigint as block_id,
  case when kind in ('title', 'heading') then kind when kind in ('authors', 'affil') then 'meta' when kind = 'figure_image' then 'figure' when kind = 'equation_latex' then 'equation' else 'paragraph' end as block_kind from lg)"""


LINE = "case when kind like '%_image' then '![' || tag || '](' || image_path || ') [' || tag || ']' || chr(10) else '[' || tag || '] ' || en_text || case when kind = 'equation_latex' then chr(10) else '' end end"
