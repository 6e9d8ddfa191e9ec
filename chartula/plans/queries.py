"""The engine's queries over the driver's tables. Each runs over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering as A
from ..operators import chunking as C
from ..operators import evaluate as E
from ..operators import maintenance as M
from ..operators import providers as P
from ..operators import register as R
from ..operators import search as S
from ..sources import tables as K
from ..streaming import events as V
from .tables import current_chunks, kept, latest, read, small, spread, written

PRICES = [("large", 2.5, 15.0), ("small", 0.75, 4.5)]
CUT = "2018-01-01 00:00:00"


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return current_chunks(spark, d, ["chunk_id", *cols])


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "questions").select(F.col("id").alias("qid"), F.col("question").alias("text"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "source_run", "type", "question", "expected_answer", "key_facts", "system_answer", "cited_chunk_ids", "step5b_judge_verdict", "my_verdict"]
    g = latest(read(spark, d, "gold_verdicts"), ["id", "source_run"], "run_at", cols)
    return g.withColumns({"verdict": E.canonical_verdict(F.col("my_verdict")), "judged": E.canonical_verdict(F.col("step5b_judge_verdict"))})


def chunk_versions(spark, d):
    return _chunks(spark, d, "doc", "status", "part", "parts", "loaded_at")


def register_rows(spark, d):
    r = K.normalise_register(read(spark, d, "doc_register"))
    return r.withColumns({c: F.col(c).cast("string") for c in ("issue_date", "updated_as_on")})


def in_scope_documents(spark, d):
    return K.in_scope(read(spark, d, "doc_register")).select("file_name", "in_scope")


def load_report(spark, d):
    flagged = read(spark, d, "chunks").withColumn("embedding", F.when(F.col("embedding").isNotNull(), 1))  # the vectors themselves need not travel
    return M.load_report(latest(flagged, ["chunk_id"], "loaded_at", ["chunk_id", "doc", "boilerplate", "embedding"]), read(spark, d, "doc_register"))


def _keyword_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with status and boilerplate, document frequencies, number of chunks) of the current chunks; made once for each state of the table."""
    source = read(spark, d, "chunks")
    chunks = _chunks(spark, d, "tsv", "status", "boilerplate")
    posts = kept(f"{d}/postings", S.postings(chunks, keep=("status", "boilerplate")), source)
    dfs = kept(f"{d}/frequencies", S.lexeme_df(posts), source)
    return posts, dfs, kept(f"{d}/chunks", source.agg(F.count_distinct("chunk_id").alias("n")), source)


def lexeme_df(spark, d):
    return _keyword_index(spark, d)[1]


def index_update(spark, d):
    """Document frequencies of the table as it was at the cut, brought up to date by the chunks delivered after it."""
    old, new = delta_chunks(spark, d)
    posts = S.postings(old)
    return S.updated_index(posts, S.lexeme_df(posts), new)[1]


def _terms(spark, d, stem):
    _, dfs, total = _keyword_index(spark, d)
    return S.keyword_terms(_questions(spark, d), dfs, total, stem=stem)


def _active(posts: DataFrame) -> DataFrame:
    return S.status_filter(posts, ("active",))


def keyword_terms(spark, d):
    return _terms(spark, d, False)


def keyword_topk(spark, d):
    """The words of the questions as they stand, so that SQL can follow; ``keyword_topk_stemmed`` is the search itself."""
    return S.keyword_search(_active(_keyword_index(spark, d)[0]), _terms(spark, d, False), 5)


def keyword_terms_stemmed(spark, d):
    return _terms(spark, d, True)


def keyword_topk_stemmed(spark, d):
    return S.keyword_search(_active(_keyword_index(spark, d)[0]), _terms(spark, d, True), 5)


def _vectors(spark, d):
    return read(spark, d, "embeddings")


def vector_topk(spark, d):
    """The 20 nearest of every vector whose id is divisible by 100, among all others."""
    e = _vectors(spark, d)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("vec_id").alias("skip"))
    return S.vector_search(e, q, 20, "vec_id")


def _doc_vectors(spark, d):
    e = _vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("doc_type").alias("status"), (F.col("n_chars") < 300).alias("boilerplate"))
    return docs.join(e, "doc_id")


def vector_topk_filtered(spark, d):
    e = _doc_vectors(spark, d)
    q = e.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vec"), F.col("doc_id").alias("skip"))
    return S.vector_search(S.status_filter(e, ("circular", "guide")), q, 5, "doc_id")


def hybrid_rrf(spark, d):
    """Vector and keyword hits of every document whose id is divisible by 100, fused; the query text is the whole document."""
    e = written(_doc_vectors(spark, d))
    q = e.filter("doc_id % 100 = 0")
    vec = S.vector_search(e, q.select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vec")), S.POOL, "doc_id")
    posts = written(S.word_postings(e, "doc_id"))
    terms = S.keyword_terms(q.select(F.col("doc_id").alias("qid"), "text"), S.lexeme_df(posts), e.agg(F.count(F.lit(1)).alias("n")), stem=False)
    return S.hybrid_search(vec, S.keyword_search(posts, terms, S.POOL, "doc_id"), 40, "doc_id")


def recall_by_label(spark, d):
    """Recall at k of the vector search, a hit being a neighbour of the same label."""
    e = _vectors(spark, d).select("vec_id", "label")
    hits = vector_topk(spark, d).join(e.withColumnRenamed("label", "found"), "vec_id").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("type")), "qid")
    per = hits.groupBy("qid", "type").agg(F.min(F.when(F.col("found") == F.col("type"), F.col("rank"))).alias("rank"))
    return E.recall(per.select("type", *[F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in E.KS]))


def delta_chunks(spark, d):
    """Change of each chunk delivered after the cut against the table as it was before."""
    rows = read(spark, d, "chunks").select("chunk_id", "doc", "text", F.col("tsv"), "loaded_at")
    old = latest(rows.filter(F.col("loaded_at") <= F.lit(CUT).cast("timestamp_ntz")), ["chunk_id"], "loaded_at", ["chunk_id", "doc", "text", "tsv"])
    new = latest(rows.filter(F.col("loaded_at") > F.lit(CUT).cast("timestamp_ntz")), ["chunk_id"], "loaded_at", ["chunk_id", "doc", "text", "tsv"])
    return old, new


def delta_detect(spark, d):
    old, new = delta_chunks(spark, d)
    return M.delta(old, new, "chunk_id", "text", "tsv").select("chunk_id", "change")


def upsert_chunks(spark, d):
    old, new = delta_chunks(spark, d)
    return M.upsert_keeping(old, new, "chunk_id", "tsv").select("chunk_id", "doc", F.length("text").alias("chars"), F.length("tsv").alias("tsv_chars"))


def stale_chunks(spark, d):
    old, new = delta_chunks(spark, d)
    return M.stale(old, new, "chunk_id", "doc").select("chunk_id", "doc")


def clean_texts(spark, d):
    return _chunks(spark, d, "text").select("chunk_id", T.clean(T.unescape("text")).alias("text"))


def squash_texts(spark, d):
    return _chunks(spark, d, "text").select("chunk_id", T.squash(F.col("text")).alias("text"))


def numbers_in_answers(spark, d):
    return read(spark, d, "questions").select("id", F.array_join(F.transform(F.array_sort(T.numbers_in(F.col("expected_answer"))), T.number_text), ",").alias("numbers"))


def chunk_labels(spark, d):
    c = _chunks(spark, d, "title", "region", "chapter", "section", "para", "para_title", "part", "parts", "page_start", "page_end", "text")
    return c.select("chunk_id", T.where_label().alias("place"), T.page_label().alias("pages"), T.location().alias("path"), T.embed_text().alias("embed_text"))


def boilerplate_flags(spark, d):
    return _chunks(spark, d, "text", "parts").select("chunk_id", T.is_boilerplate(F.col("text"), F.coalesce("parts", F.lit(1))).alias("boilerplate"))


def status_labels(spark, d):
    return R.lineage(read(spark, d, "doc_register")).select("file_name", "status_date", "replaced_by_title", "amends_title", R.status_label().alias("label"))


def best_documents(spark, d):
    return R.best_documents(read(spark, d, "doc_register"), read(spark, d, "questions").select(F.col("id").alias("qid"), F.col("question").alias("text")))


def source_prompts(spark, d):
    """Prompts with current sources first and superseded ones after them, from the keyword search."""
    posts, _, _ = _keyword_index(spark, d)
    terms = written(_terms(spark, d, True))
    now = S.keyword_search(_active(posts), terms, 5)
    old = S.keyword_search(S.status_filter(posts, R.SUPERSEDED), terms, 5)
    both = written(A.compare_hits(now, old))
    wide = _chunks(spark, d, "doc", "title", "region", "chapter", "section", "para", "para_title", "part", "parts", "page_start", "page_end", "amendment_note", "text")
    wide = wide.join(small(written(both.select("chunk_id").distinct())), "chunk_id", "left_semi")
    return A.prompts(both.join(A.with_labels(wide, read(spark, d, "doc_register")), "chunk_id"), _questions(spark, d))


def generated_answers(spark, d):
    """Answers of the deterministic generator to the prompts, with their citations."""
    requests = written(source_prompts(spark, d))
    empty = spark.createDataFrame([], "key string, answer string")
    answers, _, _ = A.cached(requests, empty, A.extractive_generator(), ["prompt"])
    return answers.select("qid", "answer", A.not_covered(F.col("answer")).alias("not_covered"), A.cited_numbers(F.col("answer"), F.col("n_sources")).alias("cited"))


def cited_sources(spark, d):
    return _verdicts(spark, d).select("id", "source_run", F.array_join(A.cited_numbers(F.col("system_answer"), F.lit(5)).cast("array<string>"), ",").alias("cited"))


def cost_estimate(spark, d):
    v = _verdicts(spark, d).select("id", "source_run", F.when(F.length("id") % 2 == 0, "large-2024-01-01").otherwise("small").alias("model"), F.lit("hosted").alias("provider"),
                                   F.length(F.coalesce("question", F.lit(""))).alias("input_tokens"), F.length(F.coalesce("system_answer", F.lit(""))).alias("output_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, price_in double, price_out double")
    return A.estimate_cost(v, prices).groupBy("source_run").agg(F.round(F.sum("cost"), 8).alias("cost"), F.count(F.lit(1)).alias("n"))


def eval_targets(spark, d):
    t = E.parse_targets(read(spark, d, "questions"))
    return t.select("id", "n", "doc", "region", F.array_join("paras", ",").alias("paras"), "section_contains", "parsed", F.when(F.col("parsed"), E.describe_target()).alias("target"))


KS = (1, 3, 5, 10, 20, 30)


def _question_vectors(spark, d) -> DataFrame:
    """(qid, type, vec): a stand-in for embedded questions, as no embedding model is at hand: the vector of the first chunk of the first document a
    question names; questions that name none ask for nothing."""
    have = current_chunks(spark, d, ["chunk_id", "doc", "embedding"]).filter("embedding is not null")
    firsts = have.groupBy("doc").agg(F.min_by("embedding", "chunk_id").alias("vec"))
    q = read(spark, d, "questions").select(F.col("id").alias("qid"), "type", F.trim(F.split_part("source_doc", F.lit("|"), F.lit(1))).alias("doc"))
    return q.join(F.broadcast(q.select("doc").distinct()).join(firsts, "doc"), "doc").select("qid", "type", "vec")


def _keyword_hits(spark, d, k: int) -> DataFrame:
    types = read(spark, d, "questions").select(F.col("id").alias("qid"), "type")
    terms = _terms(spark, d, False).join(F.broadcast(types), "qid")
    return S.keyword_search(S.status_filter(_keyword_index(spark, d)[0], None), terms, k, allowed=E.allowed_by_type())


def _vector_hits(spark, d, k: int) -> DataFrame:
    vectors = spread(current_chunks(spark, d, ["chunk_id", "status", "boilerplate", "embedding"]), "chunk_id")
    corpus = kept(f"{d}/vectors", vectors, read(spark, d, "chunks"))
    q = written(_question_vectors(spark, d))
    plain = F.col("type").isin(*E.PLAIN_TYPES)
    return S.vector_search(S.status_filter(corpus, ("active",)), q.filter(plain), k).unionByName(S.vector_search(S.status_filter(corpus, None), q.filter(~plain), k))


def _method_hits(spark, d, method: str, k: int = 30) -> DataFrame:
    """(id, chunk_id, score, rank): hits of each question among the chunks its type may use, cut at ``k`` after that."""
    if method == "hybrid":
        hits = S.hybrid_search(_vector_hits(spark, d, S.POOL), _keyword_hits(spark, d, S.POOL), k)
    else:
        hits = (_keyword_hits if method == "keyword" else _vector_hits)(spark, d, k)
    return hits.select(F.col("qid").alias("id"), "chunk_id", "score", "rank")


def _found(spark, d, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, targets, hits with their places) of one method."""
    chunks = _chunks(spark, d, "doc", "region", "para", "section", "para_title", "part", "parts")
    hits = written(_method_hits(spark, d, method).join(chunks, "chunk_id"))
    targets = E.parse_targets(read(spark, d, "questions")).filter("type <> 'unanswerable'")
    return E.retrieval_results(hits, targets, KS), targets, hits


def _of_methods(spark, d) -> DataFrame:
    """(id, type, rank, hit_<k>.., all_found, method) of all methods; the fused list is made of the other two, whose first hits do not depend on the cut."""
    vector, keyword = written(_vector_hits(spark, d, max(KS))), written(_keyword_hits(spark, d, max(KS)))
    hits = {"vector": vector, "keyword": keyword, "hybrid": S.hybrid_search(vector, keyword, max(KS))}
    every = reduce(DataFrame.unionByName, [h.select(F.concat_ws("\t", F.lit(m), "qid").alias("id"), "chunk_id", "rank") for m, h in hits.items()])
    places = _chunks(spark, d, "doc", "region", "para", "section")
    targets = E.parse_targets(read(spark, d, "questions")).filter("type <> 'unanswerable'").withColumn("_m", F.explode(F.array(*[F.lit(m) for m in S.METHODS])))
    results = E.retrieval_results(every.join(places, "chunk_id"), targets.withColumn("id", F.concat_ws("\t", "_m", "id")), KS)
    return results.withColumns({"method": F.split_part("id", F.lit("\t"), F.lit(1)), "id": F.split_part("id", F.lit("\t"), F.lit(2))})


def policy_hits(spark, d):
    """Keyword hits among what each question's type may use."""
    return _method_hits(spark, d, "keyword")


def vector_hits(spark, d):
    return _method_hits(spark, d, "vector")


def hybrid_hits(spark, d):
    return _method_hits(spark, d, "hybrid")


def retrieval_results(spark, d):
    return _found(spark, d, "keyword")[0]


def recall_at_k(spark, d):
    """Recall of the three methods side by side, over all questions and by type."""
    return E.recall(_of_methods(spark, d), KS, ("method", "type"))


def method_ranks(spark, d):
    return E.ranks_by_method(_of_methods(spark, d).select("id", "method", "rank"), list(S.METHODS))


def differing_ranks(spark, d):
    return E.differing_ranks(_of_methods(spark, d).select("id", "method", "rank"), list(S.METHODS), ("q001",))


def retrieval_report(spark, d):
    """Questions missed in the first five hits of the keyword search, with what was expected and what was found."""
    results, targets, hits = _found(spark, d, "keyword")
    shown = hits.withColumn("place", T.where_label())
    out = E.described(results, targets, shown).filter("hit_5 = 0")
    return out.select("id", "type", "statuses", "rank", "expected", "unparsed_part", "top5")


def unparseable(spark, d):
    return E.unparseable(E.parse_targets(read(spark, d, "questions")).filter("type <> 'unanswerable'"))


def half_found(spark, d):
    results, targets, _ = _found(spark, d, "vector")
    return E.half_found(results, targets)


def resolved_documents(spark, d):
    names = read(spark, d, "questions").select("id", F.explode(F.split("source_doc", r" \| ")).alias("name"))
    return E.resolve_document(names, read(spark, d, "doc_register"))


def judged_answers(spark, d):
    """Verdicts of the rule judge: three votes per answer, a majority per fact, a verdict from the facts."""
    rows = _verdicts(spark, d).select("id", "source_run", F.col("system_answer").alias("answer"), E.split_facts(F.col("key_facts")).alias("facts"))
    return P.judge(P.rule_votes(rows), ["id", "source_run"])


def embedded_delta(spark, d):
    """Chunks delivered after the cut as they go to the embedder: unchanged ones are left as stored (here null), the others get a vector of the hashing embedder."""
    old, new = delta_chunks(spark, d)
    changes = M.delta(old, new, "chunk_id", "text", "tsv").withColumn("embedding", F.lit(None).cast("array<float>"))
    return P.embed_delta(changes, "text", "embedding").select("chunk_id", "change", F.size("embedding").alias("dim"))


def majority_votes(spark, d):
    return E.majority(_verdicts(spark, d), ["id"], "verdict", "partial")


def fact_verdicts(spark, d):
    """A fact counts as present if the answer holds its wording, else as missing."""
    facts = E.split_facts(F.col("key_facts"))
    states = F.transform(facts, lambda f: F.when(F.contains(F.lower(F.coalesce("system_answer", F.lit(""))), F.lower(f)), "present").otherwise("missing"))
    return _verdicts(spark, d).select("id", "source_run", F.size(facts).alias("facts"), E.verdict_from_facts(states).alias("verdict"))


def confusion_matrix(spark, d):
    return E.confusion(_verdicts(spark, d), "verdict", "judged")


def agreement_rate(spark, d):
    return E.agreement(_verdicts(spark, d), "verdict", "judged")


def verdict_counts(spark, d):
    return E.verdict_counts(_verdicts(spark, d).filter("verdict is not null"), ["type"])


def answer_stats(spark, d):
    v = _verdicts(spark, d)
    cited = F.col("system_answer").rlike(r"\[S\d").cast("int")
    refused = F.coalesce(F.lower("system_answer"), F.lit("")).contains("not covered").cast("int")
    own = v.select("type", "source_run", "verdict", cited.alias("citation_match"), refused.alias("refused"), (F.coalesce("system_answer", F.lit("")) == "Not covered by the rulebook.").cast("int").alias("exact_refusal"),
                   F.lit(0.001).alias("cost"), F.length("question").cast("double").alias("seconds"))
    return E.answer_stats(own, ["source_run"])


def run_spread(spark, d):
    """Mean, least and greatest share of correct answers over all runs."""
    runs = written(answer_stats(spark, d))
    values = runs.select(F.lit("correct").alias("metric"), F.col("source_run").alias("run"), F.col("correct").alias("value")).unionByName(runs.select(F.lit("citation").alias("metric"), F.col("source_run").alias("run"), F.col("citation").alias("value")))
    return E.across_runs(values, runs.count())


def unstable_questions(spark, d):
    return E.unstable(_verdicts(spark, d))


def changed_questions(spark, d):
    """Questions whose verdict differs between their first and their last run."""
    v = _verdicts(spark, d).filter("verdict is not null")
    ends = v.groupBy("id").agg(F.min_by("verdict", "source_run").alias("before"), F.max_by("verdict", "source_run").alias("after"))
    return E.changed(ends.select("id", F.col("before").alias("verdict")), ends.select("id", F.col("after").alias("verdict")))


def cited_records(spark, d):
    return E.cited_records(_verdicts(spark, d), ["id", "source_run"])


def _pages(spark, d) -> DataFrame:
    """(doc, page, text): the pages of the chunks, and for every quote a page on which its words stand on lines of their own, since the test documents' own pages
    hold none: page 5000 more than stated, or the one after it for ids whose last digit is divisible by 3."""
    c = _chunks(spark, d, "doc", "page_start", "text").filter("page_start is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r" \| ")
    q = read(spark, d, "questions").select("id", F.explode(F.arrays_zip(split("source_doc").alias("d"), split("page").alias("p"), split("evidence_quote").alias("q"))).alias("x"))
    moved = F.when(F.coalesce(F.right("id", F.lit(1)).try_cast("int"), F.lit(0)) % 3 == 0, 1).otherwise(0)
    own = q.filter("x.d <> '' and x.q <> ''").select(F.col("x.d").alias("doc"), (F.coalesce(F.col("x.p").try_cast("int"), F.lit(1)) + moved + 5000).alias("page"), F.concat(F.lit("Page. "), F.replace("x.q", F.lit(" "), F.lit(" \n"))).alias("text"))
    per = own.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return c.groupBy("doc", F.col("page_start").alias("page")).agg(body.alias("text")).unionByName(per)


def quote_pages(spark, d):
    found = E.quote_pages(read(spark, d, "questions"), _pages(spark, d))
    return found.select("id", "n", "doc", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def question_checks(spark, d):
    """Every question checked, with pages counted from 5000 as those of ``_pages`` are."""
    moved = F.array_join(F.transform(F.split("page", r" \| "), lambda p: F.coalesce((p.try_cast("int") + 5000).cast("string"), p)), " | ")
    q = read(spark, d, "questions").withColumn("page", moved)
    return E.check_questions(q, read(spark, d, "doc_register"), E.quote_pages(q, _pages(spark, d)))


def check_outcomes(spark, d):
    return question_checks(spark, d).groupBy("type", "outcome").agg(F.count(F.lit(1)).alias("n"))


def chunk_summary(spark, d):
    return C.chunk_summary(_chunks(spark, d, "doc", "region", "chapter", "para", "parts", "boilerplate", "amendment_note", "text"))


def sections_in_order(spark, d):
    return C.sections_in_order(_chunks(spark, d, "doc", "region", "chapter", "page_start"))


def numbers_rise(spark, d):
    return C.numbers_rise(_chunks(spark, d, "doc", "region", "para", "page_start"), "page_start")


def shortest_chunks(spark, d):
    return _chunks(spark, d, "text").select("chunk_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")).orderBy("chars", "chunk_id").limit(3)


def seeded_sample(spark, d):
    return read(spark, d, "questions").select("id", "type").orderBy(F.md5(F.concat("id", F.lit("-7"))), "id").limit(10)


def chunked_documents(spark, d):
    """The structural fold over the lines of every document."""
    return C.chunk_items(C.text_items(spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text"))


def repeated_stamps(spark, d):
    c = _chunks(spark, d, "doc", "page_start", "text")
    items = c.select("doc", F.col("page_start").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return C.repeated_stamps(items)


def status_records(spark, d):
    return R.lineage(read(spark, d, "doc_register")).withColumn("status_label", R.status_label()).select("file_name", R.status_text().alias("record"), R.as_source()["header"].alias("header"))


def routes(spark, d):
    """How each question is answered; questions of status get the record of the registered document they name first."""
    q = read(spark, d, "questions").select("id", "type", F.trim(F.split_part("source_doc", F.lit("|"), F.lit(1))).alias("doc"))
    known = q.join(read(spark, d, "doc_register").select(F.col("file_name").alias("doc")), "doc").select("id", F.col("doc").alias("file_name"))
    return A.routed(q.select("id", "type"), known)


def answer_rows(spark, d):
    """Answers of the latest run beside the five sources the vector search gives for their questions."""
    v = _verdicts(spark, d)
    last = v.groupBy("id").agg(F.max("source_run").alias("source_run"))
    answers = v.join(last, ["id", "source_run"]).select("id", "type", F.col("system_answer").alias("answer"))
    hits = _method_hits(spark, d, "vector", 5).join(_chunks(spark, d, "doc", "region", "para", "section"), "chunk_id").withColumnRenamed("rank", "n")
    return A.answer_rows(answers, hits, E.parse_targets(read(spark, d, "questions")))


def _scored(spark, d):
    """Verdicts with whether all expected documents are cited, by their names."""
    q = read(spark, d, "questions").select("id", F.filter(F.transform(F.split(F.coalesce("source_doc", F.lit("")), r" \| "), lambda x: F.regexp_replace(x, r"\.[^.]*$", "")), lambda x: x != "").alias("docs"))
    v = _verdicts(spark, d).join(q, "id")
    seen = F.forall("docs", lambda x: F.coalesce("cited_chunk_ids", F.lit("")).contains(x))
    exact = (F.trim(F.coalesce("system_answer", F.lit(""))) == "Not covered by the rulebook.").cast("int")
    return v.withColumns({"all_expected_found": F.when(F.size("docs") > 0, seen.cast("int")), "exact_refusal": exact})


def diagnoses(spark, d):
    return _scored(spark, d).select("id", "source_run", E.diagnosis().alias("diagnosis"), E.refusal_verdict().alias("settled"))


def reused_rows(spark, d):
    """The last run's rows for what is answered again, the first run's for what is copied."""
    v = _verdicts(spark, d).select("id", "source_run", "verdict")
    runs = v.agg(F.min("source_run").alias("a"), F.max("source_run").alias("b"))
    first, last = [v.join(F.broadcast(runs.select(F.col(c).alias("source_run"))), "source_run", "left_semi") for c in "ab"]
    again, copies = E.to_answer(routes(spark, d), first)
    return E.reused(last.join(again.select("id"), "id", "left_semi"), copies).select("id", "source_run", "verdict")


def judge_replies(spark, d):
    """Statuses read from replies of a judge: every other reply lacks its last fact, some are no JSON."""
    v = _verdicts(spark, d).select("id", "source_run", E.split_facts(F.col("key_facts")).alias("facts"))
    n = F.size("facts")
    said = F.when(F.length("id") + F.length("source_run") % 3 == 0, "not json").otherwise(
        F.concat(F.lit('{"facts": ['), F.array_join(F.transform(F.slice("facts", 1, F.greatest(n - 1, F.lit(0))), lambda x: F.when(F.length(x) % 2 == 0, '{"status": "present"}').otherwise('{"status": "odd"}')), ", "), F.lit('], "reason": "r"}')))
    got = E.parsed_judgement(said, n)
    return v.select("id", "source_run", F.array_join(got["statuses"], ",").alias("statuses"), E.verdict_from_facts(got["statuses"]).alias("verdict"))


def judge_costs(spark, d):
    v = _verdicts(spark, d).select("source_run", F.length("question").alias("input_tokens"), F.length("system_answer").alias("output_tokens"), F.when(F.col("type") != "simple", F.length("question") / 1000.0).alias("cost"))
    return E.judged_cost(v, ["source_run"])


def cache_counts(spark, d):
    """Hits and misses of requests of which those about simple questions are already answered."""
    q = read(spark, d, "questions").select("id", "question", "type")
    cache = q.filter("type = 'simple'").select(A.cache_key(["question"]).alias("key"), F.lit("x").alias("answer"))
    return A.cached(q, cache.dropDuplicates(["key"]), lambda df: df.withColumn("answer", F.upper("question")), ["question"])[2]


def graded(spark, d):
    return E.graded_rows(_verdicts(spark, d).filter("verdict is not null or trim(coalesce(my_verdict, '')) = ''"), "my_verdict").select("id", "source_run", "my_verdict")


def markdown_report(spark, d):
    """Verdicts by type as the lines of a Markdown table."""
    lines = K.markdown_table(verdict_counts(spark, d).orderBy("type")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def chunk_findings(spark, d):
    return C.findings(_chunks(spark, d, "text", "part", "boilerplate", "amendment_note"))


def searched(spark, d):
    """The search as a whole, by keyword, with columns of the chunks."""
    corpus = written(_chunks(spark, d, "status", "boilerplate", "tsv", "doc", "para"))
    return S.search(corpus, _questions(spark, d), 5, ("active",), False, "keyword", stem=False, columns=("doc", "para"))


def event_windows(spark, d):
    return V.event_windows(read(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def event_stream(spark, d):
    return V.run_available(spark, f"{d}/events.parquet").withColumn("total", F.round("total", 4)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def chosen_questions(spark, d):
    return K.chosen(read(spark, d, "questions").select("id", "type"), "id", ["q005", "q003", "q100", "none"], 2)


QUERIES = {
    f.__name__: f
    for f in (
        chunk_versions, register_rows, in_scope_documents, load_report, lexeme_df, index_update, keyword_terms, keyword_topk, keyword_terms_stemmed, keyword_topk_stemmed, vector_topk, vector_topk_filtered, hybrid_rrf, recall_by_label, delta_detect,
        upsert_chunks, stale_chunks, clean_texts, squash_texts, numbers_in_answers, chunk_labels, boilerplate_flags, status_labels, best_documents, source_prompts, generated_answers, cited_sources,
        cost_estimate, eval_targets, vector_hits, hybrid_hits, retrieval_results, recall_at_k, method_ranks, differing_ranks, retrieval_report, unparseable, policy_hits, half_found, resolved_documents, judged_answers, embedded_delta, majority_votes, fact_verdicts, confusion_matrix, agreement_rate, verdict_counts, answer_stats, run_spread,
        unstable_questions, changed_questions, cited_records, quote_pages, question_checks, check_outcomes, chunk_summary, sections_in_order, numbers_rise, shortest_chunks, seeded_sample,
        chunked_documents, repeated_stamps, status_records, routes, answer_rows, diagnoses, reused_rows, judge_replies, judge_costs, cache_counts, graded, markdown_report, chunk_findings, searched,
        chosen_questions, event_windows, event_stream,
    )
}
