"""DuckDB SQL of the queries that SQL can express."""

from tessera.plans import sql

_SEARCHES = f"""
with {sql.packed("select distinct search_infm_params_text id, search_infm_params_text t from train")},
sets as (select id, list_sort(list(distinct coalesce(param_key, '') || chr(31) || val)) s from vals group by id),
keyed as (select pair_id, item_category_id, trim(regexp_replace(translate(lower(coalesce(search_query, '')), 'ёaeopcx', 'еаеорсх'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) q, search_location_id l, coalesce(s, []) s
  from train left join sets on id = search_infm_params_text where pair_id is not null)
"""

_TERMS = """
with items as (select item_id, min(struct_pack(a := item_title_raw, b := item_description_raw, c := item_infm_params_text)) s
               from benchmark_items where item_id is not null group by item_id),
words as (select item_id, unnest(regexp_extract_all(replace(lower(concat_ws(chr(10), s.a, s.b, s.c)), 'ё', 'е'), '[a-zа-я]{4,}')) term from items),
tf as (select item_id, term, count(*) tf from words group by all),
df as (select term, count(*) df, sum(tf) cf from tf group by term),
len as (select item_id, sum(tf) len from tf group by item_id),
total as (select sum(tf)::double n from tf),
p as (select item_id, term, tf, df, (tf + 1000.0::double * (cf / n)) / (len + 1000.0::double) own, cf / n background
      from tf join df using (term) join len using (item_id) cross join total)
"""

_PLACES = (
    """
with once as (select query_id, item_id, """
    + ", ".join(f"max(case when not (({s})::varchar = 'nan') then {s} end) s{k}" for k, s in enumerate(("lexical", "geo", "facet", "microcat", "dense")))
    + """ from candidates where query_id is not null and item_id is not null group by all),
ranked as (select query_id, item_id, count(*) over (partition by query_id) n, """
    + ", ".join(f"case when s{k} is not null then rank() over (partition by query_id order by s{k} desc nulls last) end p{k}, count(s{k}) over (partition by query_id) n{k}" for k in range(5))
    + """ from once),
placed as (select query_id, item_id, n, ["""
    + ", ".join(f"p{k}" for k in range(5))
    + "] places, ["
    + ", ".join(f"coalesce(round(1 - (p{k} - 1) / n{k}, 9), 0)" for k in range(5))
    + "] pct from ranked)\n"
)

_WORDS = """regexp_extract_all(replace(lower(regexp_replace(replace(replace({t}, chr(173), ''), chr(8203), ''), '<[^<>]{{0,20}}>', ' ', 'g')), 'ё', 'е'), '[0-9a-zа-я]+')"""

SQL = {
    "p2_found": _SEARCHES + """, sized as (select pair_id, min(pair_id) over w group_id, count(*) over w n from keyed where q <> '' window w as (partition by q, l, s))
select pair_id, group_id from sized where n > 1""",
    "p8_found": f"""
with e as (select eval_id, {_WORDS.format(t="passage")} w from eval_passages),
d as (select doc_id, {_WORDS.format(t="text")} w from documents),
eg as (select distinct eval_id, array_to_string(w[i:i + 11], ' ') g from (select eval_id, w, unnest(range(1, len(w) - 10)) i from e)),
dg as (select doc_id, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from d))
select distinct doc_id, eval_id from dg join eg using (g)""",
    # Characters stand for tokens here: no source is near the limit in any measure.
    "p9_found": """
with t as (select lower(trim(source)) source, max(target_share) share, max(max_repeats) repeats from mix_targets where source is not null group by 1),
own as (select regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g') source, sum(length(text))::double n from documents where source is not null group by 1),
total as (select sum(n) n from own where source in (select source from t))
select t.source from t left join own using (source) cross join total where share * total.n > repeats * coalesce(own.n, 0)""",
    "p4_found": _TERMS + "select item_id, term from p where tf >= 3 and df <= 4",
    "p4_top_terms": _TERMS
    + """, s as (select item_id, term, round(own * ln(own / background), 9) score from p where df >= 2)
select item_id, row_number() over (partition by item_id order by score desc, term) rnk, term, score from s
qualify rnk <= 5""",
    "p5_found": """
with once as (select query_id, item_id, max(total) total from candidates
              where total is not null and not ((total)::varchar = 'nan') and query_id is not null and item_id is not null group by all)
select query_id, row_number() over (partition by query_id order by total desc, item_id) rnk, item_id from once qualify rnk <= 10""",
    "p6_found": _PLACES + "select query_id, item_id from placed where n >= 10 and len(list_filter(places, lambda x: x <= 3)) >= 4",
    "p6_ranking": _PLACES
    + """, vec as (select query_id, item_id, list_sort(pct) v from placed)
select query_id, row_number() over (partition by query_id order by v desc, item_id) rnk, item_id, v[1] weakest from vec qualify rnk <= 10""",
    "p7_found": """
with fine as (select item_id i, item_vector v, coalesce(len(item_vector) = 64 and len(list_filter(item_vector, lambda x: x is null or ((x)::varchar = 'nan'))) = 0
    and len(list_filter(item_vector, lambda x: x <> 0)) > 0, false) ok, 'item' side from item_vectors
  union all select query_id, query_vector, coalesce(len(query_vector) = 64 and len(list_filter(query_vector, lambda x: x is null or ((x)::varchar = 'nan'))) = 0
    and len(list_filter(query_vector, lambda x: x <> 0)) > 0, false), 'query' from query_vectors),
ok_items as (select i item_id, any_value(case when ok then v::double[] end) v from fine where ok and side = 'item' and i is not null group by 1),
ok_queries as (select i query_id, any_value(case when ok then v::double[] end) v from fine where ok and side = 'query' and i is not null group by 1),
scored as (select query_id, item_id, round(list_cosine_similarity(q.v, i.v), 12) c from ok_queries q cross join ok_items i)
select query_id, item_id from scored qualify row_number() over (partition by query_id order by c desc, item_id) <= 5""",
}
