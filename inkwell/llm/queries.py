"""One query per operator over the whole of its table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, jaccard, lines, packing, phrases, quality, secrets, sharding, surrogates, token_counts, topk, toxicity, whitening
from inkwell.plans.registry import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Vocabulary files; a caller of the operators gives a path of its own.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
PACKING = {"longest": packing.LONGEST, "buckets": packing.BUCKETS, "budget": packing.BUDGET}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


@query()
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_VOCABULARY)
    return bpe.round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_sql(rules: quality.Rules) -> str:
    """The rules of ``quality.judge`` over the lists of each document."""
    known = quality.vocabulary()
    languages = ", ".join(f"'{n}'" for n in quality.COMMON_WORDS)
    left, classes = "j", []
    for pattern in quality.CLASSES.values():
        quoted = pattern.replace("'", "''")
        rest = f"regexp_replace({left}, '{quoted}', '', 'g')"
        classes.append(f"length({left}) - length({rest})")
        left = rest
    classes.append(f"length({left})")
    words = "list_concat(common, [n_words - list_sum(common)])"

    def sums(column: str, n: int) -> str:
        return "[" + ", ".join(f"sum({column}[{i + 1}])" for i in range(n)) + "]"

    def reference(name: str, rows: str) -> str:
        return f"""{name} as (
            select list_transform(c, lambda x: x / list_sum(c)) as cs, list_transform(v, lambda x: x / list_sum(v)) as vs
            from (select {sums("classes", len(classes))} as c, {sums("all_words", len(known) + 1)} as v from {rows}
                  where lang in ({languages}) group by lang having sum(n_words) > 0)
        )"""

    def distance(counts: str, total: str, shares: str) -> str:
        def half(p: str, q: str) -> str:
            return f"(case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end)"

        both = f"{half('z.p', 'z.q')} + {half('z.q', 'z.p')}"
        return f"""sqrt(greatest(list_sum(list_transform(
            list_transform(list_zip({counts}, {shares}), lambda y: {{'p': y[1] / greatest({total}, 1), 'q': y[2]}}), lambda z: {both})) / 2, 0))"""

    def judged(name: str, rows: str, references: str) -> str:
        return f"""{name} as (
            select r.*, (select min({distance("r.classes", "r.word_chars", "k.cs")}) from {references} k) as cd,
                   (select min({distance("r.all_words", "r.n_words", "k.vs")}) from {references} k) as wd from {rows} r
        )"""

    strange = f"""coalesce(word_chars >= {rules.least_chars} and cd > {rules.classes} + {rules.allowance} / sqrt(greatest(word_chars, 1))
        or n_words >= {rules.least_words} and wd > {rules.words}, false)"""
    return rf"""with cut as materialized (
            select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(t, '[^ 	-
]+') as w, array_to_string(w, '') as j,
                   list_filter(w, lambda x: x in ({", ".join(f"'{w}'" for w in known)})) as cw,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as lines
            from documents
        ), windows as (
            select doc_id, i, count(*) over (partition by doc_id, s) as n
            from (select doc_id, unnest(v) as s, generate_subscripts(v, 1) as i
                  from (select doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) as v from cut))
        ), covered as (
            select doc_id, count(distinct k) as n_repeat_words
            from (select doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) as k from windows where n > 1) group by doc_id
        ), base as materialized (
            select doc_id, lang, len(w) as n_words, length(j) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
                   len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                   [{", ".join(classes)}] as classes,
                   list_transform({known}, lambda v: len(list_filter(cw, lambda x: x = v))) as common, {words} as all_words
            from cut left join covered using (doc_id)
        ), measured as materialized (
            select *, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words as base_failed from base
        ), {reference("crude", "measured")}, {judged("first", "measured", "crude")},
        trimmed as (select * from first where not base_failed and not {strange}),
        {reference("known", "trimmed")}, {judged("last", "measured", "known")}
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and not {strange} as kept from last"""


@query(quality_sql(quality.Rules()))
def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query(
    """with rows as (
           select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
       ), scores as (
           select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
           from rows q join rows c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
       ), ranked as (
           select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores
       )
       select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5"""
)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_VOCABULARY)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


@query()
def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.length_buckets(table(spark, sf_dir, "documents"), **PACKING)


def not_held_out(key: str = "doc_id") -> Column:
    """Rows whose labels may be learnt."""
    return F.crc32(F.col(key).cast("string")) % 4 != 2


@query()
def op4_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), not_held_out())
    return toxicity.score(docs, model).select("doc_id", (~not_held_out()).alias("held_out"), "score", "predicted")


@query()
def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


#: Key of the surrogates here; a deployment keeps its own.
SURROGATE_SECRET = "surrogates-of-the-corpus"


@query()
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_SECRET).select("doc_id", "n_entities", "text")


@query(
    r"""with recursive words as (
           select doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
           from documents
       ), shingles as (
           select doc_id, unnest(list_distinct(list_transform(
               range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from words where len(w) > 0
       ), sizes as (select doc_id, count(*) as n from shingles group by 1),
       shared as (
           select a.doc_id as x, b.doc_id as y, count(*) as i from shingles a join shingles b using (s)
           where a.doc_id < b.doc_id group by 1, 2
       ), links as (
           select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * i >= 75 * (a.n + b.n - i)
       ), edges as (select x, y from links union all select y, x from links),
       reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
       select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(least_id, doc_id)) as component_id
       from words left join sizes using (doc_id) left join (select x as doc_id, min(y) as least_id from reach group by 1) using (doc_id)"""
)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


@query(
    r"""with cut as (
           select rid, doc_id, line, place, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
           from (select rid, doc_id, unnest(v) as line, generate_subscripts(v, 1) as place
                 from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as v from documents))
       ), often as (
           select k, max(doc_id) as last from cut where length(k) >= 20 group by k having count(distinct doc_id) >= 3
       ), judged as (
           select c.*, o.k is not null and (doc_id is null or doc_id < last) as goes from cut c left join often o on c.k = o.k
       )
       select doc_id, count(*) as n_lines, count(*) filter (goes) as n_dropped,
              sha256(coalesce(string_agg(line, chr(10) order by place) filter (not goes), '')) as kept_sha256
       from judged group by rid, doc_id"""
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(
    r"""with pieces as (
           select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents
       ), words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
       totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
       grams as materialized (
           select lang, g, len(string_split(g, ' ')) as k, count(*)::hugeint as f from (
               select lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                   list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g from words
           ) group by lang, g
       ), candidates as (select lang, g, k, f as a, string_split(g, ' ') as v from grams where k > 1 and f >= 10),
       halves as (
           select lang, g, a, cut, array_to_string(v[1:cut], ' ') as x, array_to_string(v[cut + 1:], ' ') as y
           from (select *, unnest(range(1, k)) as cut from candidates)
       ), cuts as (
           select h.lang, h.g, h.a, cut, x.f as l, y.f as r, 1000000 * h.a * h.a // (x.f * y.f) as score
           from halves h join grams x on x.lang = h.lang and x.g = h.x join grams y on y.lang = h.lang and y.g = h.y
       ), lowest as (select *, row_number() over (partition by lang, g order by score, cut) as place from cuts),
       longer as (
           select lang, v[1] || ' ' || v[2] as g, a from candidates where k = 3
           union all select lang, v[2] || ' ' || v[3], a from candidates where k = 3
       ), covered as (
           select distinct c.lang, c.g from candidates c join longer o on o.lang = c.lang and o.g = c.g where 100 * o.a >= 50 * c.a
       ), ranked as (
           select lang, row_number() over (partition by lang order by score desc, a desc, g) as rank, g as phrase, a, l, r, score
           from lowest anti join covered using (lang, g) where place = 1
       )
       select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score
       from ranked join totals using (lang) where rank <= 2000"""
)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
