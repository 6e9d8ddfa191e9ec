"""The queries in plain SQL, for the comparison on the same tables."""

from __future__ import annotations

from ..functions.text import ISSUER, NUMBER_WORDS, QUESTION_WORDS

_CUR = "cur as (select * exclude rn from (select *, row_number() over (partition by chunk_id order by loaded_at desc) as rn from chunks) where rn = 1)"
_GOLD = """gold as (select * exclude rn, case when lower(trim(my_verdict)) in ('correct', 'partial', 'incorrect') then lower(trim(my_verdict)) end as verdict,
 case when lower(trim(step5b_judge_verdict)) in ('correct', 'partial', 'incorrect') then lower(trim(step5b_judge_verdict)) end as judged
 from (select *, row_number() over (partition by id, source_run order by run_at desc) as rn from gold_verdicts) where rn = 1)"""
_CHUNK_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')"
_QWORDS = ",".join(f"'{w}'" for w in QUESTION_WORDS)
#: Postings of the current chunks: lexeme, its weight (0.1 a position, more with a letter).
_POSTS = r"""entries as (select chunk_id, unnest(regexp_extract_all(tsv, '''(?:[^'']|'''')*''(?::[0-9A-D,]+)?')) as entry from cur where tsv is not null),
parsed as (select chunk_id, replace(regexp_extract(entry, '^''((?:[^'']|'''')*)''', 1), '''''', '''') as lexeme, regexp_extract(entry, ''':([0-9A-D,]+)$', 1) as p from entries),
posts as (select chunk_id, lexeme, case when p = '' then 0 else round(0.1 * len(string_split(p, ',')) + 0.9 * (len(p) - len(replace(p, 'A', ''))) + 0.3 * (len(p) - len(replace(p, 'B', ''))) + 0.1 * (len(p) - len(replace(p, 'C', ''))), 6) end as w from parsed),
dfs as (select lexeme, count(distinct chunk_id) as df from posts group by 1)"""
_KEYWORD = rf"""{_CUR},
{_POSTS},
qw as (select distinct id as qid, w as lexeme from (select id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_-]+')) as w from questions)
       where w not in ({_QWORDS}) and (length(w) > 1 or regexp_matches(w, '^[0-9]$'))),
ranked as (select qid, lexeme, coalesce(df, 0) as df, coalesce(df, 0) <= 0.15 * (select count(*) from cur) as keep,
           row_number() over (partition by qid order by coalesce(df, 0), lexeme) as r from qw left join dfs using (lexeme)),
kept as (select *, sum(keep::int) over (partition by qid) as k from ranked),
terms as (select qid, lexeme, df from kept where (keep and k >= 3) or (k < 3 and r <= 3)),
scores as (select qid, chunk_id, round(sum(w)::double, 6) as score from posts join terms using (lexeme) group by 1, 2)"""
_ACTIVE = "(select chunk_id from cur where status = 'active' and not coalesce(boilerplate, false))"
_ALLOWED = "s join cur c using (chunk_id) join questions q on q.id = s.qid where not coalesce(c.boilerplate, false) and (q.type not in ('simple', 'multi_part') or coalesce(c.status = 'active', false))"


def _hits(where: str, k: int, name: str = "hits") -> str:
    return f"{name} as (select * from (select qid, chunk_id, score, row_number() over (partition by qid order by score desc, chunk_id) as rank from scores {where}) where rank <= {k})"


#: Vector search of the questions over the chunks, each with the vector of the first chunk of its first document.
_QVEC = f"""vecs as (select q.id as qid, min_by(c.embedding, c.chunk_id) as vec from questions q join cur c on c.doc = trim(string_split(q.source_doc, '|')[1]) where c.embedding is not null group by 1),
vscores as (select qid, chunk_id, round(list_cosine_similarity(vec::double[], embedding::double[]), 6) as score from vecs, cur where embedding is not null),
vranked as (select qid, chunk_id, score, row_number() over (partition by qid order by score desc, chunk_id) as rank from vscores {_ALLOWED} and not isnan(score))"""
_FUSED = f"""{_hits(_ALLOWED, 30, 'khits')}, {_QVEC}, vhits as (select * from vranked where rank <= 30),
fused as (select coalesce(v.qid, k.qid) as qid, coalesce(v.chunk_id, k.chunk_id) as chunk_id, v.rank as vr, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + k.rank), 0), 6) as score
  from (select * from vhits where rank <= 20) v full join (select * from khits where rank <= 20) k on v.qid = k.qid and v.chunk_id = k.chunk_id),
hhits as (select * from (select qid, chunk_id, score, row_number() over (partition by qid order by score desc, coalesce(vr, 1000000), chunk_id) as rank from fused) where rank <= 30),
every_hits as (select 'keyword' as method, * from khits union all select 'vector', * from vhits union all select 'hybrid', * from hhits)"""
_FITS = "(t.paras is null or list_contains(t.paras, coalesce(c.para, ''))) and (t.section_contains is null or contains(coalesce(c.section, ''), t.section_contains))"
_SIDE = f"""t as (select * from targets where parsed and type <> 'unanswerable'),
        r as (select t.id, h.method, min(h.rank) as rank from t join (every_hits h join cur c using (chunk_id)) on h.qid = t.id and c.doc = t.doc and c.region = t.region where {_FITS} group by 1, 2),
        w as (select i.id, v.rank::int as vector, k.rank::int as keyword, h.rank::int as hybrid from (select distinct id from t) i left join r v on v.id = i.id and v.method = 'vector' left join r k on k.id = i.id and k.method = 'keyword' left join r h on h.id = i.id and h.method = 'hybrid')"""
_SQUASH = "lower(regexp_replace(translate({0}, '‘’`“”–—‐‑' || chr(173), '''''''\"\"-----'), '[\\s\\-\\x0b\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}\\x1c-\\x1f]+', '', 'g'))"
#: Where the quotes of the questions stand: pages of chunks, and one page for each quote, counted from 5000.
_PAGES = f"""split_q as (select id, string_split(coalesce(source_doc, ''), ' | ') as d, string_split(coalesce(page, ''), ' | ') as p, string_split(coalesce(evidence_quote, ''), ' | ') as q from questions),
trip as (select id, i as n, coalesce(d[i], '') as doc, coalesce(p[i], '') as p, coalesce(q[i], '') as q from (select *, unnest(range(1, greatest(len(d), len(p), len(q)) + 1)) as i from split_q)),
pages0 as (select doc, page_start as page, string_agg(coalesce(text, ''), chr(10) order by chunk_id) as text from cur where page_start is not null group by 1, 2
  union all select doc, coalesce(try_cast(p as int), 1) + case when coalesce(try_cast(right(id, 1) as int), 0) % 3 = 0 then 1 else 0 end + 5000, string_agg('Page. ' || replace(q, ' ', ' ' || chr(10)), chr(10) order by 'Page. ' || replace(q, ' ', ' ' || chr(10))) from trip where doc <> '' and q <> '' group by 1, 2),
bodies as (select *, lead(body) over (partition by doc order by page) as next from (select doc, page, {_SQUASH.format('text')} as body from pages0)),
asked as (select id, i as n, coalesce(d[i], '') as doc, {_SQUASH.format("coalesce(q[i], '')")} as quote from (select *, unnest(range(1, greatest(len(d), len(q)) + 1)) as i from split_q)),
places as (select a.id, a.n, a.doc, list(b.page order by b.page) filter (contains(b.body, a.quote)) as one, list(b.page order by b.page) filter (coalesce(contains(b.body || b.next, a.quote) and not contains(b.next, a.quote), false)) as two
  from asked a join bodies b on b.doc = a.doc where a.quote <> '' group by 1, 2, 3),
stand as (select id, n, doc, coalesce(case when len(one) > 0 then one else two end, []) as pages from places)"""

_COS = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)"
_VECTOR = f"""vec as (select * from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from
 (select a.vec_id as qid, b.vec_id, {_COS} as score from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)) where rank <= 20)"""
_TARGETS = r"""split as (select id, type, string_split(coalesce(source_doc, ''), '|') as d, string_split(coalesce(source_section, ''), '|') as s from questions),
pairs as (select id, type, unnest(range(1, greatest(len(d), len(s)) + 1)) as n, d, s from split),
places as (select id, type, n, trim(coalesce(d[n], '')) as doc, trim(coalesce(case when len(s) = 1 and len(d) > 1 then s[1] else s[n] end, '')) as section from pairs),
parts as (select *, nullif(regexp_extract(section, '\b(?:Annex(?:ure)?|Appendix)\s*[-–]?\s*([IVX]+|\d+)\b', 1), '') as annex,
  try_cast(nullif(regexp_extract(section, '\bparas?\s*(\d+)\s*[-–]\s*(\d+)\b', 1), '') as int) as low, try_cast(nullif(regexp_extract(section, '\bparas?\s*(\d+)\s*[-–]\s*(\d+)\b', 2), '') as int) as high,
  nullif(regexp_extract(section, '\bpara\s*(\d+[A-Z]?)\b', 1), '') as single, nullif(regexp_extract(section, '\b(Part\s+\w+)', 1), '') as part from places),
targets as (select id, type, n, doc, case when annex is not null then 'annex_' || annex else 'main' end as region,
  case when low is not null then list_transform(range(low, high + 1), lambda x: x::varchar) when single is not null then [single] end as paras,
  case when annex is not null then part end as section_contains,
  regexp_matches(doc, '\.(?:pdf|html)$') and section <> '' and lower(section) <> 'none' and (low is not null or single is not null or annex is not null) as parsed from parts)"""
_MATCHED = """per_target as (select t.id, t.type, t.n, min(case when (t.paras is null or list_contains(t.paras, coalesce(c.para, ''))) and (t.section_contains is null or contains(coalesce(c.section, ''), t.section_contains)) then h.rank end) as rank
  from targets t left join (hits h join cur c using (chunk_id)) on h.qid = t.id and c.doc = t.doc and c.region = t.region where t.parsed and t.type <> 'unanswerable' group by all),
results as (select id, type, min(rank) as rank, """ + ", ".join(f"cast(coalesce(min(rank) <= {k}, false) as int) as hit_{k}" for k in (1, 3, 5, 10, 20, 30)) + """, min(cast(coalesce(rank <= 30, false) as int)) as all_found from per_target group by id, type)"""
_DELTA = """rows_ as (select chunk_id, doc, text, tsv, loaded_at from chunks),
old as (select * exclude rn from (select *, row_number() over (partition by chunk_id order by loaded_at desc) as rn from rows_ where loaded_at <= timestamp '2018-01-01') where rn = 1),
new as (select * exclude rn from (select *, row_number() over (partition by chunk_id order by loaded_at desc) as rn from rows_ where loaded_at > timestamp '2018-01-01') where rn = 1)"""
_REGION = "case when region <> 'main' then replace(region, 'annex_', 'Annex ') end"
_PART = "case when parts > 1 then coalesce(' (part ' || part || '/' || parts || ')', ' (part null/' || parts || ')') else '' end"
_STATS_ROWS = r"""s as (select type, source_run, verdict, regexp_matches(system_answer, '\[S[0-9]')::int as citation_match, contains(lower(coalesce(system_answer, '')), 'not covered')::int as refused,
 (coalesce(system_answer, '') = 'Not covered by the rulebook.')::int as exact_refusal, 0.001 as cost, length(question)::double as seconds from gold)"""
_STATS = _STATS_ROWS + """, st as (select source_run, count(*) as n,
 round(count(*) filter (verdict = 'correct') / count(*), 6) as correct, round(count(*) filter (verdict = 'partial') / count(*), 6) as partial, round(count(*) filter (verdict = 'incorrect') / count(*), 6) as incorrect,
 round(count(*) filter (verdict = 'correct' and type <> 'unanswerable') / nullif(count(*) filter (type <> 'unanswerable'), 0), 6) as correct_answerable,
 round(count(*) filter (citation_match = 1 and type <> 'unanswerable') / nullif(count(*) filter (citation_match is not null and type <> 'unanswerable'), 0), 6) as citation,
 round(count(*) filter (refused = 1 and type = 'unanswerable') / nullif(count(*) filter (type = 'unanswerable'), 0), 6) as refusal,
 round(count(*) filter (exact_refusal = 1 and type = 'unanswerable') / nullif(count(*) filter (type = 'unanswerable'), 0), 6) as exact_refusal,
 round(count(*) filter (refused = 1 and type <> 'unanswerable') / nullif(count(*) filter (type <> 'unanswerable'), 0), 6) as false_refusal,
 round(sum(cost)::double, 6) as cost, round(avg(seconds), 6) as seconds from s group by 1)"""
_MAP = "map {" + ", ".join(f"'{k}': {v}.0::double" for k, v in NUMBER_WORDS.items()) + "}"
#: Numbers of a text: (id, x) of a table named v<name>.
_NUMBERS = (
    r"t{0} as (select id, regexp_extract_all(lower({1}), '\d[\d,]*(?:\.\d+)?|[a-z]+') as w from questions), v{0} as (select id, list_transform(range(1, len(w) + 1), lambda i: (case when regexp_matches(w[i], '^\d') then try_cast(replace(w[i], ',', '') as double) else "
    + _MAP.replace("{", "{{").replace("}", "}}") + "[w[i]] end) * (case w[i + 1] when 'thousand' then 1000.0 when 'lakh' then 100000.0 when 'lakhs' then 100000.0 when 'crore' then 10000000.0 else 1.0 end)) as x from t{0})"
)
_CLOSING = r"requested to (?:ensure|note)\b|ensure strict compliance|strict compliance of this|acknowledge (?:the )?receipt|yours faithfully|for (?:your )?information and (?:necessary|appropriate) action"
_DELETED = r"^(?:\d{1,3}[A-Z]?\.\s*)?(?:\d{1,3}\s*)?\[?\s*(?:Deleted|\*+)\s*\]?\.?\s*(?:\d{1,3})?$"
_CIRCULAR = rf"\d{{2}}\.\d{{2}}\.\d{{2,3}}/\d{{4}}-\d{{2}}|{ISSUER}/\d{{4}}-\d{{2}}/\d+"
_CIRCULAR_ROW = r"^\s*\d{1,3}\.\s*\|.*\|\s*(?:[A-Z][a-z]+\s+\d{1,2}\s*,\s*\d{4}|\d{2}\.\d{2}\.\d{4})\b"

ORACLES = {
    "chunk_versions": f"with {_CUR} select chunk_id, doc, status, part, parts, loaded_at from cur",
    "register_rows": "select " + ", ".join(f"nullif(trim({c}), '') as {c}" if c not in ("issue_date", "updated_as_on") else f"cast({c} as varchar) as {c}" for c in "file_name title doc_type topic entity issue_date updated_as_on status replaced_by amends in_scope notes".split()) + " from doc_register",
    "in_scope_documents": "select file_name, in_scope from doc_register where lower(trim(coalesce(in_scope, ''))) in ('yes', 'partial')",
    "load_report": f"""with {_CUR}, r as (select c.doc, d.status, count(*) as rows, count(embedding) as embedded, cast(sum(coalesce(boilerplate, false)::int) as bigint) as boilerplate
        from cur c join doc_register d on d.file_name = c.doc group by 1, 2)
        select * from r union all select null, null, cast(sum(rows) as bigint), cast(sum(embedded) as bigint), cast(sum(boilerplate) as bigint) from r""",
    "lexeme_df": f"with {_CUR}, {_POSTS} select lexeme, df from dfs",
    "index_update": f"with {_CUR}, {_POSTS} select lexeme, df from dfs",
    "keyword_terms": f"with {_KEYWORD} select qid, lexeme, df from terms",
    "keyword_topk": f"with {_KEYWORD}, {_hits('where chunk_id in ' + _ACTIVE, 5)} select qid, chunk_id, score, cast(rank as int) as rank from hits",
    "vector_topk": f"with {_VECTOR} select qid, vec_id, score, cast(rank as int) as rank from vec",
    "vector_topk_filtered": f"""with e as (select d.doc_id, e.embedding, d.doc_type, d.n_chars from documents d join embeddings e on e.vec_id = d.doc_id),
        p as (select a.doc_id as qid, b.doc_id, {_COS} as score from e a, e b where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id and b.doc_type in ('circular', 'guide') and not b.n_chars < 300)
        select qid, doc_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from p) where rank <= 5""",
    "hybrid_rrf": rf"""with e as (select d.doc_id, d.text, e.embedding from documents d join embeddings e on e.vec_id = d.doc_id),
        v as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as vector_rank from (select a.doc_id as qid, b.doc_id, {_COS} as score from e a, e b where a.doc_id % 100 = 0)) where vector_rank <= 20),
        posts as (select doc_id, lexeme, count(*) as tf from (select doc_id, unnest({_CHUNK_WORDS}) as lexeme from e) group by all),
        dfs as (select lexeme, count(*) as df from posts group by 1),
        qw as (select distinct doc_id as qid, w as lexeme from (select doc_id, unnest({_CHUNK_WORDS}) as w from e where doc_id % 100 = 0) where w not in ({_QWORDS}) and (length(w) > 1 or regexp_matches(w, '^[0-9]$'))),
        ranked as (select qid, lexeme, coalesce(df, 0) as df, coalesce(df, 0) <= 0.15 * (select count(*) from e) as keep, row_number() over (partition by qid order by coalesce(df, 0), lexeme) as r from qw left join dfs using (lexeme)),
        kept as (select *, sum(keep::int) over (partition by qid) as k from ranked),
        terms as (select qid, lexeme from kept where (keep and k >= 3) or (k < 3 and r <= 3)),
        w as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as keyword_rank from (select qid, doc_id, round(sum(tf) * 0.1, 6) as score from posts join terms using (lexeme) group by 1, 2)) where keyword_rank <= 20),
        f as (select coalesce(v.qid, w.qid) as qid, coalesce(v.doc_id, w.doc_id) as doc_id, vector_rank, keyword_rank, round(coalesce(1 / (60 + vector_rank), 0) + coalesce(1 / (60 + keyword_rank), 0), 6) as score from v full join w on v.qid = w.qid and v.doc_id = w.doc_id)
        select qid, doc_id, cast(vector_rank as int) as vector_rank, cast(keyword_rank as int) as keyword_rank, score, cast(rank as int) as rank from
        (select *, row_number() over (partition by qid order by score desc, coalesce(vector_rank, 1000000), doc_id) as rank from f) where rank <= 40""",
    "recall_by_label": f"""with {_VECTOR}, h as (select qid, q.label as type, min(case when e.label = q.label then rank end) as rank from vec join embeddings e using (vec_id) join embeddings q on q.vec_id = vec.qid group by 1, 2)
        select type, count(*) as n, """ + ", ".join(f"round(avg(coalesce(rank <= {k}, false)::int), 6) as recall_{k}" for k in (1, 3, 5, 10)) + " from h group by grouping sets ((), (type))",
    "delta_detect": f"with {_DELTA} select n.chunk_id, case when o.chunk_id is null then 'new' when o.tsv is not null and o.text is not distinct from n.text then 'reuse' else 'changed' end as change from new n left join old o using (chunk_id)",
    "upsert_chunks": f"""with {_DELTA} select chunk_id, doc, length(text) as chars, length(tsv) as tsv_chars from old where chunk_id not in (select chunk_id from new)
        union all select n.chunk_id, n.doc, length(n.text), length(o.tsv) from new n left join old o using (chunk_id)""",
    "stale_chunks": f"with {_DELTA} select chunk_id, doc from old where doc in (select doc from new) and chunk_id not in (select chunk_id from new)",
    "squash_texts": f"""with {_CUR} select chunk_id, lower(regexp_replace(translate(text, '‘’`“”–—‐‑' || chr(173), '''''''""-----'), '[\\s\\-\\x0b\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}\\x1c-\\x1f]+', '', 'g')) as text from cur""",
    "numbers_in_answers": rf"""with t as (select id, regexp_extract_all(lower(expected_answer), '\d[\d,]*(?:\.\d+)?|[a-z]+') as w from questions),
        v as (select id, list_transform(range(1, len(w) + 1), lambda i: (case when regexp_matches(w[i], '^\d') then try_cast(replace(w[i], ',', '') as double) else {_MAP}[w[i]] end)
          * (case w[i + 1] when 'thousand' then 1000.0 when 'lakh' then 100000.0 when 'lakhs' then 100000.0 when 'crore' then 10000000.0 else 1.0 end)) as x from t)
        select id, array_to_string(list_transform(list_sort(list_distinct(list_filter(x, lambda y: y is not null))), lambda y: case when y = floor(y) then y::bigint::varchar else y::varchar end), ',') as numbers from v""",
    "chunk_labels": rf"""with {_CUR}, b as (select *, list_filter([{_REGION}, nullif(chapter, ''), nullif(section, '')], lambda x: x is not null) as path, {_PART} as pt,
          case when page_start is null then '' when page_end is not null and page_end <> 0 and page_end <> page_start then page_start || '-' || page_end else page_start::varchar end as pages,
          nullif(trim(para_title), '') as ttl, coalesce(nullif(trim(chapter), ''), {_REGION}) as place0 from cur)
        select chunk_id, trim(coalesce({_REGION}, '') || ' ' || case when nullif(trim(para), '') is not null then 'para ' || para else coalesce(ttl, 'preamble') end || pt) as place, pages,
          array_to_string(case when coalesce(para <> '', false) then list_append(path, 'para ' || para || pt || case when coalesce(para_title <> '', false) then ': ' || para_title else '' end)
            when coalesce(para_title <> '', false) and not list_contains(path, para_title) then list_append(path, para_title || pt)
            when len(path) > 0 then list_append(path[1:len(path) - 1], path[len(path)] || pt) else path end, ' › ')
          || case when pages = '' then '' when contains(pages, '-') then ', pp. ' || pages else ', p. ' || pages end as path,
          concat_ws(chr(10), array_to_string(list_filter([nullif(trim(title), ''), place0, nullif(trim(section), ''), case when nullif(trim(para), '') is not null then 'para ' || para || coalesce(': ' || ttl, '')
            when not coalesce(ttl is not distinct from section or ttl is not distinct from place0, false) then ttl end], lambda x: x is not null), ' › '), text) as embed_text from b""",
    "boilerplate_flags": rf"""with {_CUR}, l as (select *, list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '' and not starts_with(x, '[')) as ls from cur)
        select chunk_id, coalesce(coalesce(parts, 1) = 1 and length(text) <= 300 and (regexp_matches(text, '{_CLOSING}', 'i') or regexp_matches(text, '{_DELETED}', 'i')), false)
          or coalesce(len(ls) >= 3 and 2 * len(list_filter(ls, lambda x: regexp_matches(x, '{_CIRCULAR}') or regexp_matches(x, '{_CIRCULAR_ROW}'))) >= len(ls), false) as boilerplate from l""",
    "status_labels": r"""with j as (select d.*, r.title as rt, r.issue_date as ri, r.entity as re, r.file_name as rf, a.title as at_, a.status as ast, nullif(regexp_extract(coalesce(d.notes, ''), '\b(?:repealed|withdrawn)\s+on\s+(\d{4}-\d{2}-\d{2})', 1, 'i'), '') as sd
          from doc_register d left join doc_register r on r.file_name = d.replaced_by left join doc_register a on a.file_name = d.amends)
        select file_name, sd as status_date, rt as replaced_by_title, at_ as amends_title, case when status = 'active' then 'CURRENT' when status = 'incorporated' then 'INCORPORATED: its changes are already part of ' || coalesce(at_, 'the current direction')
          when status in ('repealed', 'withdrawn') then upper(status) || coalesce(' on ' || sd, '') || case when rt is not null then ', replaced' || case when rf is not null and re = 'nbfc' and entity is distinct from 'nbfc' then ' for NBFCs' else '' end || ' by ' || rt || ' (issued ' || coalesce(strftime(ri, '%Y-%m-%d'), 'None') || ')'
            when at_ is not null and ast is not distinct from status then ' (amendment to ' || at_ || ', which is also ' || status || ')' else '' end || ' - NOT in force'
          when status = 'reference' then 'REFERENCE: FAQ page, not a direction; check against current rules' else upper(status) end as label from j""",
    "cited_sources": rf"""with {_GOLD}, n as (select id, source_run, unnest(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(system_answer, '\[(S\d+(?:\s*[,;]\s*S?\d+)*)\]', 1), ' '), '\d+'), lambda x: try_cast(x as int))) as x,
          generate_subscripts(regexp_extract_all(array_to_string(regexp_extract_all(system_answer, '\[(S\d+(?:\s*[,;]\s*S?\d+)*)\]', 1), ' '), '\d+'), 1) as i from gold),
        f as (select id, source_run, x, min(i) as i from n where x between 1 and 5 group by 1, 2, 3), c as (select id, source_run, string_agg(x::varchar, ',' order by i) as cited from f group by 1, 2)
        select g.id, g.source_run, case when g.system_answer is null then null else coalesce(c.cited, '') end as cited from gold g left join c using (id, source_run)""",
    "cost_estimate": f"""with {_GOLD} select source_run, round(sum((length(coalesce(question, '')) * case when length(id) % 2 = 0 then 2.5::double else 0.75::double end + length(coalesce(system_answer, '')) * case when length(id) % 2 = 0 then 15.0::double else 4.5::double end) / 1000000), 8) as cost, count(*) as n from gold group by 1""",
    "eval_targets": f"""with {_TARGETS} select id, cast(n as int) as n, doc, region, array_to_string(paras, ',') as paras, section_contains, parsed,
        case when parsed then doc || ' ' || case when region = 'main' then '' else replace(region, 'annex_', 'Annex ') || ' ' end || case when paras is null then coalesce(section_contains, 'any') when len(paras) = 1 then 'para ' || paras[1]
          else 'paras ' || coalesce(paras[1], '') || '-' || coalesce(paras[len(paras)], '') end end as target from targets""",
    "retrieval_results": f"with {_KEYWORD}, {_hits(_ALLOWED, 30)}, {_TARGETS}, {_MATCHED} select * replace (cast(rank as int) as rank) from results",
    "recall_at_k": f"""with {_KEYWORD}, {_TARGETS}, {_FUSED}, t as (select * from targets where parsed and type <> 'unanswerable'),
        best as (select t.id, h.method, min(h.rank) as rank from t join (every_hits h join cur c using (chunk_id)) on h.qid = t.id and c.doc = t.doc and c.region = t.region where {_FITS} group by 1, 2),
        r as (select i.id, i.type, m.method, best.rank from (select distinct id, type from t) i cross join (values ('keyword'), ('vector'), ('hybrid')) m(method) left join best on best.id = i.id and best.method = m.method)
        select method, type, count(*) as n, """ + ", ".join(f"round(avg(coalesce(rank <= {k}, false)::int), 6) as recall_{k}" for k in (1, 3, 5, 10, 20, 30)) + " from r group by grouping sets ((method), (method, type))",
    "method_ranks": f"with {_KEYWORD}, {_TARGETS}, {_FUSED}, {_SIDE} select * from w",
    "differing_ranks": f"with {_KEYWORD}, {_TARGETS}, {_FUSED}, {_SIDE} select * from w where vector is distinct from keyword or vector is distinct from hybrid or id = 'q001'",
    "vector_hits": f"with {_KEYWORD}, {_FUSED} select qid as id, chunk_id, score, rank::int as rank from vhits",
    "hybrid_hits": f"with {_KEYWORD}, {_FUSED} select qid as id, chunk_id, score, rank::int as rank from hhits",
    "unparseable": f"""with {_TARGETS}, g as (select t.id, t.type, bool_or(parsed) as any_, string_agg(trim(t.doc || ' ' || p.section), '; ' order by t.n) as unparsed from targets t join places p on p.id = t.id and p.n = t.n group by 1, 2)
        select id, type, unparsed from g where not any_ and type <> 'unanswerable'""",
    "policy_hits": f"with {_KEYWORD}, {_hits(_ALLOWED, 30)} select qid as id, chunk_id, score, cast(rank as int) as rank from hits",
    "half_found": f"with {_KEYWORD}, {_TARGETS}, {_FUSED}, hits as (select * from vhits), {_MATCHED} select id from results where all_found = 0 and id in (select id from targets where parsed and type <> 'unanswerable' group by 1 having count(*) > 1)",
    "quote_pages": f"with {_CUR}, {_PAGES} select id, cast(n as int) as n, doc, array_to_string(pages, ',') as pages from stand",
    "question_checks": rf"""with {_CUR}, {_PAGES},
        two as (select t.id, t.n, q.type, t.doc, case when try_cast(t.p as int) is not null then (try_cast(t.p as int) + 5000)::varchar else t.p end as p, r.status, r.file_name is not null as known, coalesce(s.pages, []) as pages
          from trip t join questions q using (id) join split_q z using (id) left join doc_register r on r.file_name = t.doc left join stand s on s.id = t.id and s.n = t.n where t.n <= greatest(len(z.d), len(z.p))),
        said as (select id, string_agg(case when not known then doc || ' not among the documents' when len(pages) = 0 then 'quote not found in ' || doc
            when not list_contains(list_transform(pages, lambda x: x::varchar), p) then 'quote on p' || array_to_string(pages, ',') || ' of ' || doc || ', not p' || p end, '; ' order by n) as places,
          string_agg(case when type in ('simple', 'multi_part') and not known then doc || ' not in register' when type in ('simple', 'multi_part') and status in ('repealed', 'withdrawn') then type || ' question sourced from ' || status || ' doc ' || doc end, '; ' order by n) as sources from two group by 1),
        {_NUMBERS.format('a', "coalesce(expected_answer, '')")}, {_NUMBERS.format('b', "coalesce(evidence_quote, '')")},
        gap as (select va.id, list_sort(list_distinct(list_filter(va.x, lambda y: y is not null and not list_contains(vb.x, y)))) as g from va join vb using (id)),
        f as (select q.id, q.type, q.type = 'unanswerable' as skip, case when q.type = 'unanswerable' then '' when len(z.d) = len(z.p) and len(z.p) = len(z.q)
            then concat_ws('; ', nullif(places, ''), case when len(g) > 0 then 'answer numbers not in quote: ' || array_to_string(list_transform(g, lambda y: case when y = floor(y) then y::bigint::varchar else y::varchar end), ', ') end, nullif(sources, ''))
            else 'parts ' || len(z.d) || '/' || len(z.p) || '/' || len(z.q) end as problems from questions q join split_q z using (id) join said using (id) join gap using (id))
        select id, type, case when skip then 'skipped' when problems <> '' then 'fail' else 'pass' end as outcome, problems from f""",
    "resolved_documents": r"""with n as (select id, unnest(string_split(source_doc, ' | ')) as name from questions), k as (select regexp_replace(file_name, '\.[^.]*$', '') as stem, min(file_name) as f from doc_register group by 1)
        select id, name, coalesce(k.f, regexp_replace(name, '\.[^.]*$', '') || '.pdf') as doc from n left join k on k.stem = regexp_replace(name, '\.[^.]*$', '')""",
    "majority_votes": f"""with {_GOLD}, c as (select id, verdict, count(*) as n from gold where verdict is not null group by 1, 2), t as (select *, max(n) over (partition by id) as top, sum(n) over (partition by id) as total from c),
        g as (select id, count(*) filter (n = top) as firsts, max(verdict) filter (n = top) as v, max(top) as top, coalesce(max(n) filter (verdict = 'partial'), 0) as tie, max(total) as total from t group by 1)
        select id, case when firsts > 1 then 'partial' else v end as winner, round(case when firsts > 1 then tie else top end / total, 6) as agreement from g""",
    "fact_verdicts": rf"""with {_GOLD}, f as (select id, source_run, list_filter(list_transform(string_split(coalesce(key_facts, ''), '|'), lambda x: trim(x)), lambda x: x <> '') as facts, lower(coalesce(system_answer, '')) as a from gold),
        p as (select *, len(list_filter(facts, lambda x: contains(a, lower(x)))) as present from f)
        select id, source_run, cast(len(facts) as int) as facts, case when present = 0 then 'incorrect' when present = len(facts) then 'correct' else 'partial' end as verdict from p""",
    "confusion_matrix": f"with {_GOLD}, v(x) as (values ('correct'), ('partial'), ('incorrect')) select a.x as truth, b.x as said, (select count(*) from gold where verdict = a.x and judged = b.x) as n from v a, v b",
    "agreement_rate": f"with {_GOLD} select count(*) as n, count(*) filter (verdict = judged) as equal, round(count(*) filter (verdict = judged) / nullif(count(*), 0), 6) as rate from gold where verdict is not null and judged is not null",
    "verdict_counts": f"with {_GOLD} select type, count(*) filter (verdict = 'correct') as correct, count(*) filter (verdict = 'partial') as partial, count(*) filter (verdict = 'incorrect') as incorrect from gold where verdict is not null group by 1",
    "answer_stats": f"with {_GOLD}, {_STATS} select * from st",
    "run_spread": f"with {_GOLD}, {_STATS}, v as (select 'correct' as metric, correct as value from st union all select 'citation', citation from st) select metric, round(avg(value), 6) as mean, min(value) as min, max(value) as max from v group by 1 having count(value) = (select count(*) from st)",
    "unstable_questions": f"with {_GOLD} select id, string_agg(verdict, ' / ' order by source_run) as verdicts from gold where verdict is not null group by 1 having count(distinct verdict) > 1",
    "changed_questions": f"with {_GOLD}, e as (select id, arg_min(verdict, source_run) as before, arg_max(verdict, source_run) as after from gold where verdict is not null group by 1) select * from e where before is distinct from after",
    "cited_records": rf"""with {_GOLD}, x as (select id, source_run, unnest(regexp_split_to_array(cited_chunk_ids, '\s*\|\|\s*')) as x from gold), r as (select *, regexp_extract(x, '^\s*[^=]*=\s*(.*?)\s*$', 1) as ref from x where trim(x) <> '')
        select id, source_run, regexp_extract(x, '^\s*([^=]*?)\s*=', 1) as source, regexp_replace(ref, '^status:', '') as ref, case when starts_with(ref, 'status:') then 'status' else 'chunk' end as kind from r""",
    "chunk_summary": rf"""with {_CUR}, b as (select *, case when region = 'main' then try_cast(nullif(regexp_extract(para, '^(\d{{1,9}})', 1), '') as int) end as num from cur),
        g as (select doc, count(*) as chunks, count(distinct nullif(chapter, '')) as chapters, list_sort(list_distinct(list(num) filter (num is not null))) as seen, count(*) filter (coalesce(para, '') = '') as preamble,
          count(distinct region || '|' || coalesce(para, '')) filter (parts > 1) as split_paras, count(*) filter (coalesce(boilerplate, false)) as boilerplate, count(distinct region || '|' || coalesce(para, '')) filter (coalesce(amendment_note, '') <> '') as amended,
          min(length(coalesce(text, ''))) as len_min, median(length(coalesce(text, ''))) as len_median, max(length(coalesce(text, ''))) as len_max, count(*) filter (length(coalesce(text, '')) > 1800) as over_limit from b group by 1)
        select doc, chunks, chapters, coalesce(len(seen), 0)::int as main_paras, list_max(seen) as last_para, coalesce(array_to_string(list_filter(range(1, list_max(seen) + 1), lambda x: not list_contains(seen, x::int)), ','), '') as gaps,
          preamble, split_paras, boilerplate, amended, len_min::int as len_min, len_median::double as len_median, len_max::int as len_max, over_limit from g""",
    "sections_in_order": f"with {_CUR} select doc, region, chapter, count(*) as chunks, min(page_start) as first from cur group by 1, 2, 3",
    "numbers_rise": rf"""with {_CUR}, f as (select doc, region, try_cast(nullif(regexp_extract(para, '^(\d{{1,9}})', 1), '') as int) as n, min(page_start) as at_ from cur group by 1, 2, 3),
        l as (select *, lag(n) over (partition by doc, region order by at_ nulls first, n) as before from f where n is not null) select doc, region, bool_and(coalesce(n >= before, true)) as in_order from l group by 1, 2""",
    "status_records": r"""with j as (select d.*, r.title as rt, r.issue_date as ri, r.entity as re, r.file_name as rf, a.title as at_, a.status as ast, nullif(regexp_extract(coalesce(d.notes, ''), '\b(?:repealed|withdrawn)\s+on\s+(\d{4}-\d{2}-\d{2})', 1, 'i'), '') as sd
          from doc_register d left join doc_register r on r.file_name = d.replaced_by left join doc_register a on a.file_name = d.amends),
        l as (select *, case when status = 'active' then 'CURRENT' when status = 'incorporated' then 'INCORPORATED: its changes are already part of ' || coalesce(at_, 'the current direction')
          when status in ('repealed', 'withdrawn') then upper(status) || coalesce(' on ' || sd, '') || case when rt is not null then ', replaced' || case when rf is not null and re = 'nbfc' and entity is distinct from 'nbfc' then ' for NBFCs' else '' end || ' by ' || rt || ' (issued ' || coalesce(strftime(ri, '%Y-%m-%d'), 'None') || ')'
            when at_ is not null and ast is not distinct from status then ' (amendment to ' || at_ || ', which is also ' || status || ')' else '' end || ' - NOT in force'
          when status = 'reference' then 'REFERENCE: FAQ page, not a direction; check against current rules' else upper(status) end as label from j)
        select file_name, concat_ws(chr(10), 'Document: ' || coalesce(title, '') || ' (' || file_name || ')', 'Status: ' || status, 'Status label: ' || label, 'Status date: ' || sd, 'Issue date: ' || coalesce(strftime(issue_date, '%Y-%m-%d'), 'not recorded'),
          'Updated as on: ' || strftime(updated_as_on, '%Y-%m-%d'), case when replaced_by <> '' then 'Replaced by: ' || coalesce(rt, 'None') || ' (' || replaced_by || '), issued ' || coalesce(strftime(ri, '%Y-%m-%d'), 'None') end,
          case when amends <> '' then 'Amends: ' || coalesce(at_, 'None') || ' (' || amends || ')' end, case when notes <> '' then 'Notes: ' || notes end) as record, coalesce(title, '') || ' [' || label || '] › status record' as header from l""",
    "routes": """select q.id, q.type, case when q.type = 'change' then 'compare' else 'current' end as mode, case when q.type = 'status' then r.file_name end as record,
        case when q.type = 'status' and r.file_name is not null then 'current+status(' || r.file_name || ')' when q.type = 'change' then 'compare' else 'current' end as routing
        from questions q left join doc_register r on r.file_name = trim(string_split(q.source_doc, '|')[1])""",
    "answer_rows": rf"""with {_GOLD}, {_KEYWORD}, {_TARGETS}, {_FUSED}, s5 as (select qid as id, rank as n, h.chunk_id, c.doc, c.region, c.para, c.section from vhits h join cur c using (chunk_id) where rank <= 5),
        ans as (select id, type, system_answer as answer from gold g where source_run = (select max(source_run) from gold h where h.id = g.id)),
        nums as (select id, list_filter(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(coalesce(answer, ''), '\[(S\d+(?:\s*[,;]\s*S?\d+)*)\]', 1), ' '), '\d+'), lambda x: try_cast(x as int)), lambda x: x between 1 and coalesce(k, 0)) as xs from ans left join (select id, count(*) as k from s5 group by 1) using (id)),
        cites as (select id, list_filter(xs, lambda x, i: list_position(xs, x) = i) as cs from nums),
        t as (select * from targets where parsed),
        held as (select t.id, t.n as tn, list(s5.n) filter ({_FITS.replace('c.', 's5.')}) as ns from t left join s5 on s5.id = t.id and s5.doc = t.doc and s5.region = t.region group by 1, 2),
        flags as (select h.id, max((len(ns) > 0)::int) as some_, min((coalesce(len(ns), 0) > 0)::int) as every_, max(coalesce(len(list_intersect(ns, cs)) > 0, false)::int) as met from held h left join cites using (id) group by 1),
        refs as (select s5.id, string_agg('S' || n || '=' || chunk_id, ' || ' order by n) as retrieved, string_agg('S' || n || '=' || chunk_id, ' || ' order by n) filter (list_contains(cs, n)) as cited_ids from s5 join cites using (id) group by 1)
        select a.id, a.type, (coalesce(rtrim(answer), '') = 'The supplied documents do not cover this.')::int as exact_refusal, array_to_string(cs, ',') as cited, coalesce(cited_ids, '') as cited_chunk_ids, coalesce(retrieved, '') as retrieved,
          coalesce(some_, case when f.id is not null then 0 end) as expected_in_top5, every_ as all_expected_in_top5, case when a.type <> 'unanswerable' then met end as citation_match
        from ans a join cites using (id) left join flags f on f.id = a.id left join refs r on r.id = a.id""",
    "diagnoses": rf"""with {_GOLD}, q as (select id, list_filter(list_transform(string_split(coalesce(source_doc, ''), ' | '), lambda x: regexp_replace(x, '\.[^.]*$', '')), lambda x: x <> '') as docs from questions),
        s as (select g.*, len(docs) > 0 and len(list_filter(docs, lambda x: not contains(coalesce(cited_chunk_ids, ''), x))) = 0 as every_, trim(coalesce(system_answer, '')) = 'Not covered by the rulebook.' as exact from gold g join q using (id))
        select id, source_run, case when verdict = 'correct' then '' when type = 'unanswerable' or every_ then 'generation_error' else 'retrieval_miss' end as diagnosis, case when exact then case when type = 'unanswerable' then 'correct' else 'incorrect' end end as settled from s""",
    "reused_rows": f"""with {_GOLD}, r as (select q.id, case when q.type = 'status' and d.file_name is not null then 'status' when q.type = 'change' then 'compare' else 'current' end as routing from questions q left join doc_register d on d.file_name = trim(string_split(q.source_doc, '|')[1])),
        a as (select * from gold where source_run = (select min(source_run) from gold)), b as (select * from gold where source_run = (select max(source_run) from gold)), copied as (select id from r where routing = 'current' and id in (select id from a))
        select id, source_run, verdict from a where id in (select id from copied) union all select id, source_run, verdict from b where id in (select id from r) and id not in (select id from copied)""",
    "judge_replies": f"""with {_GOLD}, f as (select id, source_run, list_filter(list_transform(string_split(coalesce(key_facts, ''), '|'), lambda x: trim(x)), lambda x: x <> '') as facts from gold),
        s as (select id, source_run, list_transform(range(1, len(facts) + 1), lambda i: case when i < len(facts) and length(facts[i]) % 2 = 0 then 'present' else 'missing' end) as st from f),
        p as (select *, len(list_filter(st, lambda x: x = 'present')) as k from s)
        select id, source_run, array_to_string(st, ',') as statuses, case when k = 0 then 'incorrect' when k = len(st) then 'correct' else 'partial' end as verdict from p""",
    "judge_costs": f"with {_GOLD} select source_run, count(*) as calls, sum(coalesce(length(question), 0))::bigint as input_tokens, sum(coalesce(length(system_answer), 0))::bigint as output_tokens, round(sum(case when type <> 'simple' then length(question) / 1000.0::double else 0 end), 8) as cost from gold group by 1",
    "cache_counts": "select count(*) filter (question in (select question from questions where type = 'simple')) as hits, count(*) filter (question not in (select question from questions where type = 'simple')) as misses from questions",
    "graded": f"with {_GOLD} select id, source_run, verdict as my_verdict from gold where verdict is not null",
    "markdown_report": f"""with {_GOLD}, v as (select type, count(*) filter (verdict = 'correct') as c, count(*) filter (verdict = 'partial') as p, count(*) filter (verdict = 'incorrect') as i from gold where verdict is not null group by 1),
        l as (select -2 as o, '| type | correct | partial | incorrect |' as text union all select -1, '|---|---|---|---|' union all select row_number() over (order by type), '| ' || type || ' | ' || c || ' | ' || p || ' | ' || i || ' |' from v)
        select cast(row_number() over (order by o) - 1 as int) as line, text from l""",
    "chunk_findings": f"""with {_CUR} select chunk_id, 'continuation' as finding, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10))[2:3], lambda x: x[1:70]), ' / ') as detail from cur where part > 1
        union all select chunk_id, 'boilerplate', coalesce(text, '')[1:90] from cur where boilerplate union all select chunk_id, 'amended', amendment_note[1:120] from cur where amendment_note <> '' union all select chunk_id, 'over_limit', length(text)::varchar from cur where length(text) > 1800""",
    "searched": f"with {_KEYWORD}, {_hits('where chunk_id in ' + _ACTIVE, 5)} select qid, chunk_id, h.score, cast(h.rank as int) as rank, c.doc, c.para from hits h join cur c using (chunk_id)",
    "shortest_chunks": f"with {_CUR} select chunk_id, length(coalesce(text, ''))::int as chars from cur order by chars, chunk_id limit 3",
    "seeded_sample": "select id, type from questions order by md5(id || '-7'), id limit 10",
    "event_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_stream": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "chosen_questions": "select id, type from questions where id in ('q003', 'q005')",
}
