"""SQL for DuckDB with the results of the queries in catalog."""

from __future__ import annotations

from tessella.plans.catalog import NO_MATCH
from tessella.operators.answering import REFUSAL
from tessella.operators.judging import FABRICATED, JUDGED
from tessella.plans.retrieval import CANDIDATES, REWRITES, TOP_K

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NWS = _WS.replace("[", "[^", 1)


def _clean(col: str) -> str:
    return f"coalesce(trim(regexp_replace({col}, '{_WS}', ' ', 'g')), '')"


def _words(col: str) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), '{_NWS}'))"


def _tokens(col: str) -> str:
    return f"regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9]+')"


_PAIRS = "pairs as (select distinct pair_uid, doc_id, qid, focus, qtype, question, answer, source, url, semantic_group, lang from qa_pairs)"
_ANSWERS = f"answers as (select * from (select distinct pair_uid, {_clean('answer')} as answer from qa_pairs) where length(answer) > 0)"
_SENTENCES = r"""sentences as (
  select pair_uid, generate_subscripts(parts, 1) - 1 as n, unnest(parts) as s from (
    select pair_uid, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?]) +([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) as parts from answers))"""

_CORPUS = """corpus as (
  select distinct chunk_id, coalesce(focus, 'unknown') as focus, source, url, coalesce(question, '') as question, coalesce(chunk_text, '') as chunk_text
  from chunks where strategy = 'sentence'),
texts as (select *, question || ' ' || chunk_text as sparse_text, 'Question: ' || question || chr(10) || 'Focus: ' || focus || chr(10) || chr(10) || chunk_text as dense_text from corpus)"""


def _queries(question: str = "coalesce(question, '')") -> str:
    return f"queries as (select item_id::varchar as query_id, {question} as question, item_type, expects_refusal, gold_pair_uid from eval_items)"


_BM25 = f"""tok as (select chunk_id, unnest({_tokens('sparse_text')}) as term from texts),
dl as (select chunk_id, len({_tokens('sparse_text')}) as dl from texts),
totals as (select count(*) as n, avg(dl) as avgdl from dl),
postings as (select term, chunk_id, count(*) as tf from tok group by all),
raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw from postings, totals group by term),
terms as (select term, df, case when raw < 0 then 0.25::double * (select avg(raw) from raw) else raw end as idf from raw)"""

_BM25_SCORES = f"""qtok as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tokens('question')}) as term from queries) group by all),
hits as (
  select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
  from qtok join terms using (term) join postings using (term) join dl using (chunk_id), totals group by all),
bm25 as (
  select query_id, chunk_id, coalesce(score, 0.0::double) as bm25_score, row_number() over (partition by query_id order by coalesce(score, 0.0::double) desc, chunk_id) as rank
  from queries cross join corpus left join hits using (query_id, chunk_id))"""


def _vectors(name: str, key: str, source: str, text: str) -> str:
    return f"""{name}_counts as (select {key}, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as dim, count(*)::double as c from (select {key}, unnest({_tokens(text)}) as t from {source}) group by all),
{name} as (select {key}, dim, c / sqrt(sum(c * c) over (partition by {key})) as v from {name}_counts)"""


_DENSE = f"""{_vectors('cv', 'chunk_id', 'texts', 'dense_text')},
{_vectors('qv', 'query_id', 'queries', 'question')},
near as (select query_id, chunk_id, round(sum(qv.v * cv.v), 6) as score from qv join cv using (dim) group by all),
dense as (
  select query_id, chunk_id, coalesce(score, 0.0::double) as cosine, row_number() over (partition by query_id order by coalesce(score, 0.0::double) desc, chunk_id) as rank
  from queries cross join corpus left join near using (query_id, chunk_id))"""

_FUSED = f"""listed as (
  select query_id, chunk_id, rank, 0 as list_no from dense where rank <= {CANDIDATES}
  union all select query_id, chunk_id, rank, 1 from bm25 where rank <= {CANDIDATES}),
summed as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as rrf_score, min(list_no * 1000 + rank) as seen from listed group by all),
fused as (select query_id, chunk_id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, seen) as rank from summed)"""

_RERANKED = f"""rows as (select f.query_id, f.chunk_id, f.rank, f.rrf_score, c.focus, c.source, c.url, c.question, c.chunk_text, c.dense_text from fused f join texts c using (chunk_id)),
once as (select * from (select *, row_number() over (partition by query_id, chunk_text order by rank) as nth from rows) where nth = 1),
scored as (
  select o.*, round(case when len(list_distinct({_tokens('q.question')})) > 0
    then 8.0::double * len(list_intersect(list_distinct({_tokens('q.question')}), list_distinct({_tokens('o.dense_text')}))) / len(list_distinct({_tokens('q.question')})) else 0.0::double end - 4.0::double, 6) as rerank_score
  from once o join queries q using (query_id)),
best as (select * exclude (rank), row_number() over (partition by query_id order by rerank_score desc, rank) as rank from scored qualify row_number() over (partition by query_id order by rerank_score desc, rank) <= {TOP_K})"""


def _gate(source: str, score: str) -> str:
    return f"""gate as (
  select query_id, coalesce(c, 0.0::double) as confidence, coalesce(c, 0.0::double) < 0.5 as refused
  from queries left join (select query_id, round(1.0::double / (1.0::double + exp(-{score})), 6) as c from {source} where rank = 1) using (query_id))"""


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


_TO_FUSED = (_CORPUS, _queries(), _BM25, _BM25_SCORES, _DENSE, _FUSED)
_TO_BEST = (*_TO_FUSED, _RERANKED)
_CONTEXT = """context as (select query_id, string_agg('[' || rank || '] (Topic: ' || coalesce(focus, 'unknown') || ') ' || chunk_text, chr(10) || chr(10) order by rank) as context from best group by query_id)"""


def _rank_of(name: str, source: str, limit: str = "true") -> str:
    return f"{name} as (select q.query_id, min(r.rank) as {name} from queries q join {source} r using (query_id) where {limit} and string_split(r.chunk_id, '::')[1] = q.gold_pair_uid group by q.query_id)"


_JUDGED = f"""{_rank_of('dense_rank', 'dense', f'r.rank <= {TOP_K}')},
{_rank_of('fused_rank', 'fused')},
{_rank_of('hybrid_rank', 'best')},
judged as (select * from queries left join dense_rank using (query_id) left join fused_rank using (query_id) left join hybrid_rank using (query_id) join gate using (query_id))"""
_TO_JUDGED = (*_TO_BEST, _gate("best", "rerank_score"), _JUDGED)

_PACK = """folded as (
  select pair_uid, 0::bigint as n, s, case when {long} then 0 else length(s) end as used, 0::bigint as grp, {long} as cut from sentences where n = 0
  union all
  select x.pair_uid, x.n::bigint, x.s,
    case when {xlong} then 0 when f.cut or f.used + length(x.s) > {budget} or ({brk}) then length(x.s) else f.used + length(x.s) end,
    case when {xlong} or f.cut or f.used + length(x.s) > {budget} or ({brk}) then f.grp + 1 else f.grp end,
    {xlong}
  from folded f join sentences x on x.pair_uid = f.pair_uid and x.n = f.n + 1 {more}),
packed as (select pair_uid, grp, bool_or(cut) as cut, string_agg(s, ' ' order by n) as body from folded group by pair_uid, grp)"""

_SEM = f"""svec_counts as (select pair_uid, n, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as dim, count(*)::double as c from (select pair_uid, n, unnest({_tokens('s')}) as t from sentences) group by all),
svec as (select pair_uid, n, dim, c / sqrt(sum(c * c) over (partition by pair_uid, n)) as v from svec_counts),
sims as (select b.pair_uid, b.n, sum(a.v * b.v) / (1.0::double + 1e-8::double) as sim from svec a join svec b on a.pair_uid = b.pair_uid and a.n + 1 = b.n and a.dim = b.dim group by all)"""


def _rewritten(col: str) -> str:
    out = col
    for phrase, plain in REWRITES.items():
        out = f"replace({out}, '{phrase}', '{plain}')"
    return f"coalesce(nullif(regexp_replace(regexp_replace({out}, '^{_WS}', ''), '{_WS}$', ''), ''), {col})"


#: Columns that are 32-bit integers in Spark.
_INTEGERS = {"sentence_split": "sentence_no", **dict.fromkeys(("fixed_size_chunks", "sentence_chunks", "semantic_chunks", "chunk_id_build"), "chunk_index"), **dict.fromkeys(("dense_topk", "dense_chunk_topk", "bm25_topk", "bm25_no_match", "rrf_fuse", "hybrid_topk", "rerank_dedup", "rerank_topk", "rewritten_topk"), "rank"), "sources_struct": '"index"'}


def _word_stats() -> str:
    return _with(_PAIRS) + f"""
select count(*) as n_pairs, count(distinct doc_id) as n_docs, count(distinct source) as n_sources, round(avg({_words(_clean('answer'))}), 6) as mean_words, median({_words(_clean('answer'))})::double as median_words, max({_words(_clean('answer'))}) as max_words,
  round(100.0::double * (select coalesce(sum(n), 0) from (select count(*) as n from pairs group by qid) where n > 1) / count(*), 6) as shared_qid_percent from pairs"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name, with Spark's types."""
    return {name: f"select * replace ({_INTEGERS[name]}::int as {_INTEGERS[name]}) from ({sql.strip()})" if name in _INTEGERS else sql for name, sql in _sql().items()}


def _sql() -> dict[str, str]:
    best = _with(*_TO_BEST)
    real = f"""{_PAIRS},
marked as (select source, pair_uid, question, {_words(_clean('answer'))} >= 40 as ok from pairs),
kept as (select * from (select *, bool_or(ok) over (partition by source) as any_ok from marked) where ok or not any_ok),
real as (select source, pair_uid, question from kept qualify row_number() over (partition by source order by md5('42:' || pair_uid), pair_uid) <= 4)"""
    judge = """judged as (select item_id, case item_id % 3 when 0 then (item_id % 5 + 1)::int end as groundedness, case item_id % 3 when 0 then 4 end as relevance from eval_items)"""
    graded = f"""first as (select query_id, question from (select *, row_number() over (order by query_id::bigint) as nth from queries where item_type = 'real') where nth <= {JUDGED}),
passed as (select f.query_id, f.question, c.context, g.confidence, substr(b.chunk_text, 1, 200) || ' [1]' as answer from first f join gate g using (query_id) join context c using (query_id) join best b on b.query_id = f.query_id and b.rank = 1 where not g.refused)"""

    def share(of: str, among: str) -> str:
        return f"1 + round(4.0::double * len(list_intersect(list_distinct({_tokens(of)}), list_distinct({_tokens(among)}))) / len(list_distinct({_tokens(of)})), 0)"

    to_graded = (*_TO_BEST, _CONTEXT, _gate("best", "rerank_score"), graded)
    sink = f"select pair_uid, qid, source, {_clean('question')} as question, nullif({_clean('answer')}, '') as answer from pairs"
    return {
        "judge_run": _with(*to_graded) + f"""
select query_id, answer, confidence, case when ok then {share('answer', 'context')} end as groundedness, case when ok then {share('question', "(answer || ' ' || context)")} end as relevance, case when not ok then 'nothing to grade' end as raw
from (select *, len({_tokens('answer')}) > 0 and len({_tokens('question')}) > 0 as ok from passed)""",
        "judge_calibration": _with(*to_graded) + f"""
select query_id, case when ok then g end as groundedness, coalesce(case when ok then g end <= 2, false) as calibrated
from (select query_id, {share(f"'{FABRICATED}'", 'context')} as g, len({_tokens('question')}) > 0 as ok from passed)""",
        "probe_status": _with(*_TO_BEST, _gate("best", "rerank_score")) + """
select g.query_id, q.item_type as category, case when g.refused then 'REFUSED' else 'ANSWERED' end as status, g.confidence, b.focus as top_focus, replace(substr(b.chunk_text, 1, 100), chr(10), ' ') as top_preview
from gate g join queries q using (query_id) left join best b on b.query_id = g.query_id and b.rank = 1""",
        "dense_single": """
select row_number() over (order by score desc, vec_id::varchar)::int as rank, vec_id, score from (
  select e.vec_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) + 1e-8::double), 6) as score
  from embeddings e, (select embedding from embeddings where vec_id = 0) q) qualify row_number() over (order by score desc, vec_id::varchar) <= 10""",
        "index_build": _with(_CORPUS, _vectors("cv", "chunk_id", "texts", "dense_text")) + """
select t.chunk_id, 64::bigint as n_dimensions, round(coalesce(s.l, 0.0::double), 6) as squared_length, t.focus, t.source, t.url, t.question
from texts t left join (select chunk_id, sum(v * v) as l from cv group by chunk_id) s using (chunk_id)""",
        "index_count": "select strategy, count(distinct chunk_id) as n_vectors from chunks group by strategy",
        "missing_steps": "select * from (values ('table', 'MissingInput: run chunking first'), ('vector index', 'RuntimeError: build it first'), ('sparse index', 'RuntimeError: build it first'), ('cell index', 'RuntimeError: build it first')) as t(step, error)",
        "xml_folder": _with(_PAIRS) + f"""
select doc_id, subset, coalesce(qid, doc_id || '-' || (row_number() over (partition by doc_id order by pair_uid) - 1)) as qid, coalesce(qtype, 'unknown') as qtype, question, answer, '' as url
from (select pair_uid, subset || '-' || substr(pair_uid, 1, 5) as doc_id, subset, qid, qtype, {_clean('question')} as question, {_clean('answer')} as answer
  from (select p.*, coalesce(s.subset_dir, '0_Other_QA') as subset, coalesce(s.excluded, false) as excluded from pairs p left join sources s on p.source = s.source)
  where not excluded and substr(pair_uid, 5, 1) <> '1')
where question <> '' and answer <> ''""",
        "jsonl_sink": _with(_PAIRS) + sink,
        "csv_sink": _with(_PAIRS) + sink,
        "report_sink": _word_stats(),
        "clean_text": f"select pair_uid, {_clean('question')} as question, {_clean('answer')} as answer from qa_pairs",
        "sentence_split": _with(_ANSWERS, _SENTENCES) + "select pair_uid, n as sentence_no, s as sentence from sentences",
        "fixed_size_chunks": _with(_ANSWERS) + """
select pair_uid, generate_subscripts(c, 1) - 1 as chunk_index, unnest(c) as chunk_text from (
  select pair_uid, case when length(answer) <= 800 then [answer] else list_filter(list_transform(range(0, length(answer), 700), lambda i: trim(substr(answer, i + 1, 800))), lambda x: length(x) > 0) end as c from answers)""",
        "sentence_chunks": _with(_ANSWERS, _SENTENCES, _PACK.format(long="length(s) > 800", xlong="length(x.s) > 800", budget=800, brk="false", more="")) + """
select pair_uid, row_number() over (partition by pair_uid order by grp, part) - 1 as chunk_index, chunk_text from (
  select pair_uid, grp, generate_subscripts(c, 1) as part, unnest(c) as chunk_text from (
    select pair_uid, grp, case when cut then list_filter(list_transform(range(0, length(body), 800), lambda i: trim(substr(body, i + 1, 800))), lambda x: length(x) > 0) else [body] end as c from packed))""",
        "semantic_chunks": _with(_ANSWERS, _SENTENCES, _SEM, _PACK.format(long="false", xlong="false", budget=1000, brk="round(coalesce(m.sim, 0), 9) < 0.15", more="left join sims m on m.pair_uid = x.pair_uid and m.n = x.n")) + """
select pair_uid, row_number() over (partition by pair_uid order by grp) - 1 as chunk_index, body as chunk_text from packed""",
        "chunk_stats": f"select strategy, count(*) as n_chunks, round(avg({_words('chunk_text')}), 6) as avg_words, max({_words('chunk_text')}) as max_words from chunks group by strategy",
        "tokenize": f"select doc_id, len({_tokens('text')}) as n_tokens, array_to_string({_tokens('text')}, ' ') as tokens from documents",
        "word_stats": _word_stats(),
        "qtype_top10": _with(_PAIRS) + "select qtype, count(*) as n from pairs group by qtype order by n desc, qtype limit 10",
        "duplicate_qids": _with(_PAIRS) + "select qid, count(*) as n from pairs group by qid having count(*) > 1",
        "source_set": _with(_PAIRS) + "select source, count(distinct doc_id) as n_docs from pairs where source is not null group by source",
        "pair_uid_assign": _with(_PAIRS) + f"select pair_uid as old_uid, printf('%07d', row_number() over (order by coalesce(source, 'unknown'), doc_id nulls first, qid nulls first, pair_uid) - 1) as pair_uid from pairs where {_clean('answer')} <> ''",
        "extract_pair_uid": "select chunk_id, string_split(chunk_id, '::')[1] as pair_uid, replace(substr(chunk_text, 1, 80), chr(10), ' ') as preview from chunks",
        "chunk_id_build": _with(_PAIRS) + f"""
select pair_uid || '::fixed_size::' || (generate_subscripts(c, 1) - 1) as chunk_id, pair_uid, generate_subscripts(c, 1) - 1 as chunk_index, qtype, 'fixed_size' as strategy, from (
  select pair_uid, qtype, case when length(a) <= 800 then [a] else list_filter(list_transform(range(0, length(a), 700), lambda i: trim(substr(a, i + 1, 800))), lambda x: length(x) > 0) end as c
  from (select pair_uid, qtype, {_clean('answer')} as a from pairs where answer is not null) where a <> '')""",
        "embed_text": _with(_CORPUS) + "select chunk_id, dense_text from texts",
        "hashed_embedding": _with(_CORPUS, _vectors("cv", "chunk_id", "texts", "dense_text")) + "select chunk_id, dim::int as dim, round(v, 6) as value from cv",
        "dense_topk": """
select q.vec_id as query_id, row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id::varchar) as rank, e.vec_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) as score
from embeddings q cross join embeddings e where q.vec_id % 20 = 0 qualify rank <= 10""",
        "label_recall": """
with best as (select q.vec_id as query_id, q.label as query_label, e.vec_id, e.label, row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id::varchar) as rank
  from embeddings q cross join embeddings e where q.vec_id % 20 = 0)
select query_label, count(*) as n, round(avg((label = query_label)::int::double), 6) as same_label_share from best where rank <= 10 and query_id <> vec_id group by query_label""",
        "dense_chunk_topk": _with(_CORPUS, _queries(), _DENSE) + f"select query_id, rank, chunk_id, cosine, round(2.0::double * cosine - 1.0::double, 6) as score_l2 from dense where rank <= {TOP_K}",
        "bm25_postings": _with(_CORPUS, _BM25) + "select term, chunk_id, tf, dl from postings join dl using (chunk_id)",
        "bm25_idf": _with(_CORPUS, _BM25) + "select term, df, round(idf, 6) as idf from terms",
        "bm25_topk": _with(_CORPUS, _queries(), _BM25, _BM25_SCORES) + f"select query_id, rank, chunk_id, bm25_score from bm25 where rank <= {TOP_K}",
        "bm25_no_match": _with(_CORPUS, _queries(f"'{NO_MATCH}'"), _BM25, _BM25_SCORES) + f"select query_id, rank, chunk_id, bm25_score from bm25 where rank <= {TOP_K}",
        "rrf_fuse": _with(*_TO_FUSED) + "select query_id, rank, chunk_id, rrf_score from fused",
        "hybrid_topk": _with(*_TO_FUSED) + f"select query_id, rank, chunk_id, rrf_score from fused where rank <= {TOP_K}",
        "rerank_dedup": best + "select query_id, rank, chunk_id from once",
        "rerank_topk": best + "select query_id, rank, chunk_id, rerank_score from best",
        "confidence_gate": _with(*_TO_BEST, _gate("best", "rerank_score")) + "select * from gate",
        "gate_without_reranker": _with(*_TO_FUSED, _gate("fused", "rrf_score")) + "select * from gate",
        "sources_struct": best + 'select query_id, rank as "index", focus, source, url, question, round(rerank_score, 4) as score from best',
        "sources_array": best + "select query_id, count(*) as n_sources, string_agg(rank || '. ' || coalesce(source, '') || ' ' || question, chr(10) order by rank) as listed from best group by query_id",
        "context_block": _with(*_TO_BEST, _CONTEXT) + "select query_id, context from context",
        "generate_answer": _with(*_TO_BEST, _CONTEXT, _gate("best", "rerank_score")) + f"""
select query_id, case when refused then '{REFUSAL.replace("'", "''")}' else substr(b.chunk_text, 1, 200) || ' [1]' end as answer, confidence, refused
from gate left join (select query_id, chunk_text from best where rank = 1) b using (query_id)""",
        "query_rewrite": f"select distinct query_id, {_rewritten('question')} as rewritten from query_log",
        "rewritten_topk": _with(_CORPUS, _queries(_rewritten("coalesce(question, '')")), *_TO_BEST[2:]) + "select query_id, rank, chunk_id, rerank_score from best",
        "request_validation": "select query_id, coalesce(top_k, 5) as top_k, case when question is null or length(question) < 3 then 'question_too_short' when not coalesce(top_k, 5) between 1 and 20 then 'top_k_out_of_range' end as reject_reason from (select distinct query_id, question, top_k from query_log)",
        "request_stats": """
select model, count(*) as n, round(avg(refused::int::double), 6) as refused_share, round(avg(confidence), 6) as mean_confidence, round(avg(round(retrieval_time_ms, 1)), 4) as mean_retrieval_ms
from (select distinct * exclude (logged_at) from query_log) group by model""",
        "jsonl_read": """
select line_id, json_extract_string(line, '$.question') as question, json_extract_string(line, '$.answer') as answer
from (select line_id, case when json_valid(line) then line end as line from qa_lines) where json_type(line) = 'OBJECT'""",
        "stratified_sample": _with(real) + "select * from real",
        "eval_set_union": _with(real) + """
select question, 'real' as item_type, false as expects_refusal, pair_uid as gold_pair_uid from real
union all select question, item_type, expects_refusal, null from eval_items where item_type <> 'real'""",
        "eval_type_counts": "select item_type, count(*) as n, sum(expects_refusal::bigint)::bigint as n_refusal from eval_items group by item_type",
        "recall_at_k": _with(_CORPUS, _queries(), _DENSE, _rank_of("dense_rank", "dense", f"r.rank <= {TOP_K}")) + "select query_id, dense_rank is not null as hit from queries left join dense_rank using (query_id) where gold_pair_uid is not null",
        "retrieval_report": _with(*_TO_JUDGED) + """
select count(*) filter (g and gold_pair_uid is not null) as n_gold_items,
  round(avg((dense_rank is not null)::int::double) filter (g and gold_pair_uid is not null), 3) as dense_recall_at_k,
  round(avg((hybrid_rank is not null)::int::double) filter (g and gold_pair_uid is not null), 3) as hybrid_recall_at_k,
  round(avg(refused::int::double) filter (g), 3) as false_refusal_rate_on_answerable,
  count(*) filter (t) as n_refusal_test_items,
  round(avg((refused = expects_refusal)::int::double) filter (t), 3) as refusal_gate_accuracy
from (select *, item_type in ('real', 'paraphrase') as g, item_type in ('out_of_domain', 'borderline') as t from judged)""",
        "find_rank": _with(*_TO_JUDGED) + "select query_id, dense_rank::double as dense_rank, fused_rank::double as fused_rank, hybrid_rank::double as hybrid_rank from judged where gold_pair_uid is not null",
        "diagnose": _with(*_TO_JUDGED) + f"""
select query_id, case when fused_rank is null then 'retrieval_miss' when fused_rank <= {CANDIDATES} and hybrid_rank is null then 'reranker_miss' when fused_rank > {CANDIDATES} then 'beyond_candidate_k' else 'success' end as diagnosis
from judged where gold_pair_uid is not null""",
        "probe_summary": _with(*_TO_JUDGED) + "select item_type, count(*) as n, sum(refused::bigint)::bigint as n_refused from judged group by item_type",
        "judge_parse": _with(judge) + "select item_id, groundedness::double as groundedness, relevance::double as relevance, groundedness is null or relevance is null as failed, coalesce(groundedness <= 2, false) as calibrated from judged",
        "judge_averages": _with(judge) + "select count(*) as n, round(avg(groundedness), 6) as groundedness, round(avg(relevance), 6) as relevance from judged where groundedness is not null",
        "xml_roundtrip": _with(_PAIRS) + f"select * from (select pair_uid, coalesce(doc_id, pair_uid) as doc_id, coalesce(qid, coalesce(doc_id, pair_uid) || '-0') as qid, coalesce(qtype, 'unknown') as qtype, {_clean('question')} as question, {_clean('answer')} as answer, coalesce(url, '') as url from pairs) where question <> '' and answer <> ''",
    }
