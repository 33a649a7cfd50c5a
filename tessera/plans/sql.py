"""Fragments of DuckDB SQL that the oracles share."""

from __future__ import annotations

from tessera.functions.text import STOP_WORDS

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def norm(c: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


def toks(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda t: length(t) >= 2 and not list_contains({STOPS}, t))"


def bare(c: str) -> str:
    return f"list_filter(list_distinct(string_split({norm(c)}, ' ')), lambda t: t <> '')"


def words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\s\\p{{Z}}]+'), lambda t: t <> ''))"


def cut(c: str, n: int) -> str:
    h = f"left(coalesce({c}, ''), {n})"
    blank = f"(length({h}) - instr(reverse({h}), ' '))"
    return f"case when length(coalesce({c}, '')) <= {n} then coalesce({c}, '') when instr({h}, ' ') > 0 and {blank} > {n // 2} then left({h}, {blank}) else {h} end"


def covered(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::double / nullif(len(list_distinct({a})), 0)"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"""case when {lat1} is not null and {lon1} is not null and {lat2} is not null and {lon2} is not null then 2 * 6371.0::double * asin(sqrt(least(1.0::double, greatest(0.0::double, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
        + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))) end"""


def real(c: str) -> str:
    return f"(case when not (({c})::varchar = 'nan') then {c} end)"


def bin_of(v: str, edges) -> str:
    return f"case when {v} is not null then " + " + ".join(f"(case when {v} >= {float(e)!r}::double then 1 else 0 end)" for e in edges[1:-1]) + " end"


KEY = " || chr(31) || ".join(f"coalesce({c}::varchar, '')" for c in ("search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"))
CORPUS = "items as (select distinct * from benchmark_items where item_id is not null)"
QRELS = "rel as (select distinct query_id, item_id from qrels where query_id is not null and item_id is not null)"


def shuffled(c: str, seed: int) -> str:
    return f"md5('{seed}:' || ({c})::varchar)"


def uniform(c: str, seed: int) -> str:
    return f"((('0x' || substr({shuffled(c, seed)}, 1, 12))::bigint)::double + 0.5) / {float(1 << 48)!r}::double"


_LETTER = r"[\p{L}\p{N}_]"
_GAP = r"[\s\p{Z}]"
#: Quoted parts, words (with an apostrophe behind), blanks but for tabs and line ends, and any other character.
_LEXEME = r""""(?:[^"]|"")*"|«[^«»]*»|''[^'']*''|[\p{L}\p{N}_]+''?|[ \p{Z}\x0b\x0c\x1c-\x1f]+|(?s:.)"""


def packed(rel: str) -> str:
    """CTEs up to ``vals`` (id, pos, param_key, val) of the packed texts of a relation (id, t); angle quotes don't nest here."""
    opened = f"case when opened then regexp_replace(c, '^{_GAP}*[:=]', '') else c end"
    quoted = """case when length(x) > 1 and x[1] = '"' then replace(x[2:-2], '""', '"') when length(x) > 1 and x[1] in ('«', '''') then x[2:-2] else x end"""
    return f"""pk as (select distinct trim(regexp_replace(param_key, '{_GAP}+', ' ', 'g')) k from param_keys where param_key is not null),
lexed as (select id, t, regexp_extract_all(t, '{_LEXEME}') l from ({rel}) where t is not null and t <> ''),
parts as (select id, t, l, unnest(range(1, len(l) + 1)) i from lexed),
lexemes as (select id, i, t, l[i] x, case when i > 1 then l[i - 1] else '' end p, coalesce(l[i + 1], '') n, coalesce(l[i + 2], '') m,
  (1 + coalesce(sum(length(l[i])) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0))::bigint off from parts),
begun as (select id, i, off, t, k, length(regexp_extract(substr(t, off, 400), '^' || array_to_string(list_transform(string_split(k, ' '), lambda y: regexp_escape(y)), '{_GAP}+'))) size from lexemes join pk
  on starts_with(regexp_replace(substr(t, off, 200), '{_GAP}+', ' ', 'g'), k) where regexp_matches(x, '^{_LETTER}') and not regexp_matches(p, '{_LETTER}$')),
longest as (select id, i, arg_max(k, length(k)) k, arg_max(off + size, length(k)) past, any_value(off) off from begun where not regexp_matches(substr(t, off + size, 1), '^{_LETTER}') group by id, i),
firm as (select * from longest a where not exists (select 1 from longest b where b.id = a.id and b.off < a.off and a.off < b.past)),
marked as (select x.id, x.i, x.x, x.off, k.k, last_value(k.past ignore nulls) over w inside,
  x.x in (';', '|', ',', '/', '•', chr(9), chr(10), chr(13)) and not (regexp_matches(x.p, '[0-9]$') and regexp_matches(x.n, '^[0-9]'))
  and not (x.x = ',' and regexp_matches(case when trim(replace(x.n, chr(160), ' ')) = '' and x.n <> '' then x.m else x.n end, '^[a-zß-öø-ÿа-џ]')) cut
  from lexemes x left join firm k on k.id = x.id and k.i = x.i window w as (partition by x.id order by x.i)),
live as (select id, i, x, k, coalesce(off < inside, false) held, cut and not coalesce(off < inside, false) cut from marked),
grouped as (select *, sum((cut or k is not null)::int) over (partition by id order by i) g, count(k) over (partition by id order by i) kn, last_value(k ignore nulls) over (partition by id order by i) key from live),
pieces as (select id, g, kn, key, bool_or(k is not null) opened, coalesce(string_agg({quoted}, '' order by i) filter (where not held and not cut), '') c from grouped group by id, g, kn, key),
trimmed as (select id, g, kn, key, opened, trim(regexp_replace({opened}, '{_GAP}+', ' ', 'g')) val from pieces),
kept as (select id, g, key, val from trimmed t where val <> '' or (opened and not exists (select 1 from trimmed u where u.id = t.id and u.kn = t.kn and u.val <> ''))),
vals as (select id, row_number() over (partition by id order by g) pos, key param_key, val from kept)"""


def params(rel: str) -> str:
    """CTEs up to ``par`` (id, pos, key, value), ``words_of`` (id, w) and ``first_key`` (id, i) of the params of a relation (id, t)."""
    return f"""pk as (select distinct string_split(trim(regexp_replace(param_key, '{_GAP}+', ' ', 'g')), ' ') kw from param_keys where trim(param_key) <> ''),
words_of as (select id, list_filter(regexp_split_to_array(coalesce(t, ''), '{_GAP}+'), lambda x: x <> '') w from ({rel})),
spots as (select id, w, unnest(range(1, len(w) + 1)) i from words_of),
hits as (select id, i, max(len(kw)) n from spots join pk on kw[1] = w[i] and w[i:i + len(kw) - 1] = kw group by id, i),
firm as (select * from hits a where not exists (select 1 from hits b where b.id = a.id and b.i < a.i and a.i < b.i + b.n)),
ends as (select id, i, n, lead(i) over (partition by id order by i) upto, row_number() over (partition by id order by i) - 1 pos from firm),
par as (select id, pos, array_to_string(w[i:i + n - 1], ' ') key, array_to_string(w[i + n:coalesce(upto - 1, len(w))], ' ') value from ends join words_of using (id)),
first_key as (select id, min(i) i from firm group by id)"""


def is_number(v: str) -> str:
    return rf"(regexp_full_match({v}, '\d{{1,2}}[:.]\d{{2}}') or (regexp_full_match({v}, '[0-9.,]*[0-9][0-9.,]*') and length({v}) - length(replace({v}, '.', '')) <= 1 and length({v}) - length(replace({v}, ',', '')) <= 1))"


_GRAM = f"list_filter(string_split({norm('{t}')}, ' '), lambda t: t <> '')"


def gram_counts(rel: str, key: str, text: str) -> str:
    """A body giving (key, gram, tf) of the normalised text's character n-grams."""
    return f"""select k, gram, count(*) tf from (select k, substr(p, i::bigint, n) gram from (select k, p, n, unnest(range(1, greatest(length(p) - n + 2, 2))) i from
(select {key} k, ' ' || unnest({_GRAM.format(t=text)}) || ' ' p from {rel}) cross join (select unnest([3, 4, 5]) n) where n = 3 or length(p) >= n)) group by all"""


def bayes(fit: str, key: str, text: str, of: str, ask: str, ask_key: str, ask_text: str) -> str:
    """CTEs up to ``j`` (k, c, j) and ``lp`` (k, c, lp): complement naive Bayes learnt from one relation, asked about another."""
    return f"""nb_t as ({gram_counts(fit, key, text)}), nb_n as (select count(*)::double n from {fit} where {of} is not null),
nb_idf as (select gram, ln((1 + n) / (1 + count(*))) + 1 idf from nb_t join {fit} on {key} = k cross join nb_n where {of} is not null group by gram, n having count(*) >= 3),
nb_w as (select k, gram, (1 + ln(tf)) * idf w from nb_t join nb_idf using (gram)), nb_u as (select k, gram, w / sqrt(sum(w * w) over (partition by k)) w from nb_w),
nb_own as (select {of} c, gram, sum(w) own from nb_u join {fit} on {key} = k where {of} is not null group by all), nb_all as (select gram, sum(own) a from nb_own group by 1),
nb_class as (select c, coalesce(s, 0) s from (select distinct {of} c from {fit} where {of} is not null) left join (select c, sum(own) s from nb_own group by 1) using (c)), nb_sum as (select sum(s) t from nb_class), nb_size as (select count(*) v from nb_all),
nb_q as ({gram_counts(ask, ask_key, ask_text)}), nb_qw as (select k, gram, (1 + ln(tf)) * idf w from nb_q join nb_idf using (gram)), nb_qu as (select k, gram, w / sqrt(sum(w * w) over (partition by k)) w from nb_qw),
j as (select k, c, sum(w * -ln((a - coalesce(own, 0) + 0.2::double) / (t - s + 0.2::double * v))) j from nb_qu join nb_all using (gram) cross join nb_class cross join nb_sum cross join nb_size left join nb_own using (c, gram) group by all),
nb_m as (select k, c, j, max(j) over (partition by k) m from j), lp as (select k, c, j - m - ln(sum(exp(j - m)) over (partition by k)) lp from nb_m)"""
