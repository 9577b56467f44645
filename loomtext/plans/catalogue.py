"""Every query over the test tables, with the SQL that must give the same rows.

The text tables hold invented words, so vocabulary queries are given words that occur beside the default lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lemma, text as t, vectors
from ..functions.features import with_features
from ..operators import classify, profile as p, relational as r, similarity as s, terms
from ..session import shared_folder, spread
from ..sources import delimited
from ..sources.corpus import load_corpus, save_corpus
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SKILL_WORDS = ("the", "of", "thatin", "tech", "and", "hehely", "ciónes", "der", "node js")
DOMAIN_WORDS = ("that", "is", "tech", "la", "und")
IMPLIED = {"tech": ("the", "der"), "business": ("hehely", "ion")}
TAGS = {"common": ("the of", "und der"), "techy": ("tech",), "rare": ("thatin", "heheth"), "src": ("src1",)}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table whose texts are to be worked on: a small one is dealt over all cores first."""
    return spread(read(spark, sf, name))


def cleaned(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return texts(spark, sf).select(*columns, t.clean(F.col("text")).alias("desc_clean"))


# SQL pieces
def q_clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{t.LINK}', '', 'g'), '{t.MAIL}', '', 'g'), '[^a-z]+', ' ', 'g'))"


def q_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{t.TOKEN}')"


def q_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def q_match(tokens: str, vocabulary) -> str:
    return f"list_filter({q_list(vocabulary)}, lambda v: list_contains({tokens}, v))"


def q_tags(title: str, body: str, table) -> str:
    low = f"lower(coalesce({title}, '') || ' ' || coalesce({body}, ''))"
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains({low}, {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{c}' END" for c, ks in table.items())
    return f"coalesce(nullif(array_to_string(list_filter([{cases}], lambda v: v IS NOT NULL), ','), ''), 'other')"


D_CLEAN = f"c AS (SELECT doc_id, source, lang, {q_clean('text')} AS x FROM documents), w AS (SELECT *, {q_words('x')} AS ws FROM c)"
FEATURES = "CAST(len(ws) AS BIGINT) AS desc_text_length, CASE WHEN len(ws) = 0 THEN 0.0 ELSE length(array_to_string(ws, ''))::DOUBLE / len(ws)::DOUBLE END AS desc_avg_word_length, CAST(len(list_distinct(ws)) AS BIGINT) AS desc_unique_word_count, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws))::DOUBLE / len(ws)::DOUBLE END AS desc_lexical_diversity"


@query(f"SELECT doc_id, {q_clean('text')} AS desc_clean FROM documents")
def clean_text(spark, sf):
    return cleaned(spark, sf, "doc_id")


@query(f"SELECT page_id, {q_clean(chr(39) + 'www.x.example ' + chr(39) + ' || url || ' + chr(39) + ' ' + chr(39) + ' || html')} AS page_clean FROM pages")
def clean_html_noise(spark, sf):
    return texts(spark, sf, "pages").select("page_id", t.clean(F.concat(F.lit("www.x.example "), "url", F.lit(" "), "html")).alias("page_clean"))


@query(f"WITH {D_CLEAN} SELECT doc_id, {FEATURES} FROM w")
def text_features(spark, sf):
    return with_features(cleaned(spark, sf, "doc_id"), "desc_clean", "desc_").drop("desc_clean")


@query(f"WITH {D_CLEAN} SELECT doc_id, array_to_string({q_match('ws', SKILL_WORDS)}, ',') AS skills, array_to_string({q_match('ws', t.SKILLS)}, ',') AS default_skills FROM w")
def skills_extract(spark, sf):
    c = F.col("desc_clean")
    return cleaned(spark, sf, "doc_id").select("doc_id", F.array_join(t.skills(c, SKILL_WORDS), ",").alias("skills"), F.array_join(t.skills(c), ",").alias("default_skills"))


def q_domains(vocabulary, skills, implied) -> str:
    found = q_match("ws", skills)
    parts = [q_match("ws", vocabulary)] + [f"(CASE WHEN list_has_any({found}, {q_list(by)}) THEN ['{d}'] ELSE [] END)" for d, by in implied.items()]
    return f"array_to_string(list_sort(list_distinct({' || '.join(parts)})), ',')"


@query(f"WITH {D_CLEAN} SELECT doc_id, {q_domains(DOMAIN_WORDS, SKILL_WORDS, IMPLIED)} AS domains, {q_domains(t.DOMAINS, t.SKILLS, t.IMPLIED)} AS default_domains FROM w")
def domains_extract(spark, sf):
    c = F.col("desc_clean")
    return cleaned(spark, sf, "doc_id").select("doc_id", F.array_join(t.domains(c, t.skills(c, SKILL_WORDS), DOMAIN_WORDS, IMPLIED), ",").alias("domains"), F.array_join(t.domains(c, t.skills(c)), ",").alias("default_domains"))


@query(f"SELECT doc_id, {q_tags('source', 'text', TAGS)} AS categories, {q_tags('source', 'text', t.CATEGORIES)} AS default_categories FROM documents")
def category_tagger(spark, sf):
    a, b = F.col("source"), F.col("text")
    return texts(spark, sf).select("doc_id", F.array_join(t.categories(a, b, TAGS), ",").alias("categories"), F.array_join(t.categories(a, b), ",").alias("default_categories"))


@query(f"WITH {D_CLEAN} SELECT doc_id, x AS desc_clean, array_to_string({q_match('ws', SKILL_WORDS)}, ',') AS desc_skills, {q_domains(DOMAIN_WORDS, SKILL_WORDS, t.IMPLIED)} AS desc_domains, {FEATURES} FROM w")
def preprocess_pipeline(spark, sf):
    out = pipeline.preprocess(texts(spark, sf).select("doc_id", "text"), "text", "desc_", skills=lambda c: t.skills(c, SKILL_WORDS), domains=lambda c, k: t.domains(c, k, DOMAIN_WORDS))
    out = with_features(out, "desc_clean", "desc_").drop("text")
    return out.withColumns({c: F.array_join(c, ",") for c in ("desc_skills", "desc_domains")})


PARTS = "(SELECT p_partkey, p_name FROM part WHERE p_size < 25)"


def links(spark, sf):
    parts = read(spark, sf, "part").where("p_size < 25").select("p_partkey", "p_name")
    own = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return r.map_codes(own, parts, "l_partkey", "p_partkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN {PARTS} p ON l_partkey IS NOT DISTINCT FROM p_partkey")
def map_codes_left_join(spark, sf):
    return links(spark, sf)


LISTS = f"(SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT lower(p_name)) FILTER (p_name IS NOT NULL)) AS names FROM lineitem LEFT JOIN {PARTS} p ON l_partkey IS NOT DISTINCT FROM p_partkey WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)"


@query(f"SELECT o_orderkey, coalesce(array_to_string(names, '|'), '') AS names, CAST(coalesce(len(names), 0) AS BIGINT) AS n FROM {LISTS}")
def collect_distinct_names(spark, sf):
    out = r.distinct_names(links(spark, sf), "l_orderkey", "p_name", "names")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.array_join("names", "|").alias("names"), F.size("names").cast("long").alias("n"))


@query(f"SELECT o.o_orderkey, o_orderstatus, CASE WHEN l.o_orderkey IS NULL THEN NULL ELSE coalesce(array_to_string(names, '|'), '') END AS names FROM orders o LEFT JOIN {LISTS} l ON o.o_orderkey = l.o_orderkey")
def enrich_left_join(spark, sf):
    lists = r.distinct_names(links(spark, sf), "l_orderkey", "p_name", "names").withColumnRenamed("l_orderkey", "o_orderkey")
    out = r.enrich(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), lists, "o_orderkey")
    return out.withColumn("names", F.array_join("names", "|"))


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status, o_totalprice FROM orders")
def project_rename_drop(spark, sf):
    return r.renamed_and_dropped(read(spark, sf, "orders"), {"o_orderkey": "id", "o_orderstatus": "status"}, ["o_orderdate", "o_orderpriority"])


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return r.seeded_sample(read(spark, sf, "documents").select("doc_id", "source"), "doc_id", 50)


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(spark, sf):
    return r.head(read(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")


def _describe_sql() -> str:
    one = "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c}::DOUBLE) AS low, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c}::DOUBLE) AS high FROM lineitem"
    return " UNION ALL ".join(one.format(c=c) for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax"))


@query(_describe_sql())
def describe_numeric(spark, sf):
    return p.describe(read(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_discount", "l_tax"])


DOC_TYPES = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS non_null, count(*) AS n_rows FROM documents" for c, k in DOC_TYPES))
def column_info(spark, sf):
    return p.column_info(read(spark, sf, "documents"))


TOKENS = f"{D_CLEAN}, tk AS (SELECT doc_id, source, lang, unnest(ws) AS term FROM w)"


@query(f"WITH {TOKENS} SELECT term AS Word, count(*) AS Frequency FROM tk GROUP BY term ORDER BY Frequency DESC, Word LIMIT 10")
def word_freq_top10(spark, sf):
    return terms.word_frequency(cleaned(spark, sf), "desc_clean")


def q_cloud(group: str, grams: str, n: int) -> str:
    return f"""WITH {D_CLEAN}, g AS (SELECT doc_id, source, lang, list_filter(ws, lambda v: length(v) >= 2) AS ws FROM w), tk AS (SELECT {group}, unnest({grams}) AS term FROM g),
n AS (SELECT {group}, term, count(*) AS n FROM tk WHERE term NOT IN ('the', 'of') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, term) AS rank FROM n)
SELECT {group}, CAST(rank AS INTEGER) AS rank, term, n, n::DOUBLE / max(n) OVER (PARTITION BY {group})::DOUBLE AS weight FROM k WHERE rank <= {n}"""


PAIRS = "list_transform(list_zip(ws[:-2], ws[2:]), lambda v: v[1] || ' ' || v[2])"
GRAMS = f"ws || (CASE WHEN len(ws) < 2 THEN [] ELSE {PAIRS} END)"


@query(q_cloud("source", "ws", 20))
def term_weights_by_category(spark, sf):
    return terms.term_weights(cleaned(spark, sf, "source"), "source", "desc_clean", 20, ("the", "of"))


@query(q_cloud("lang", GRAMS, 30))
def word_cloud_collocations(spark, sf):
    return terms.term_weights(cleaned(spark, sf, "lang"), "lang", "desc_clean", 30, ("the", "of"), longest=2)


JOINED = "(SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, (count(*) - count({c}))::DOUBLE / count(*)::DOUBLE AS share_missing FROM {JOINED}" for c in ("doc_id", "source", "quality", "toxic")))
def missingness(spark, sf):
    docs, labels = read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels")
    return p.missingness(docs.join(labels, "doc_id", "left"))


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(spark, sf):
    return p.duplicates(read(spark, sf, "documents"), [F.md5("text").alias("text_md5")])


@query(f"WITH a AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS is_empty, len({q_words('text')}) < 20 AS is_short, coalesce(n_chars <> length(text), true) AS length_differs, {q_match(q_words(q_clean('text')), SKILL_WORDS)} AS tags FROM documents) SELECT doc_id, is_empty, is_short, length_differs, len(tags) > 0 AND is_empty AS tags_without_text FROM a")
def text_qa_flags(spark, sf):
    docs = texts(spark, sf)
    return p.text_flags(docs, "text", "n_chars", t.skills(t.clean(F.col("text")), SKILL_WORDS)).select("doc_id", "is_empty", "is_short", "length_differs", "tags_without_text")


@query("WITH b AS (SELECT quantile_cont(n_chars, 0.01)::DOUBLE AS p_low, quantile_cont(n_chars, 0.99)::DOUBLE AS p_high FROM documents) SELECT doc_id, n_chars, p_low, p_high FROM documents, b WHERE n_chars < p_low OR n_chars > p_high")
def length_outliers(spark, sf):
    return p.outliers(read(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


@query("SELECT source, min(n_chars)::DOUBLE AS low, quantile_cont(n_chars, 0.25)::DOUBLE AS q25, quantile_cont(n_chars, 0.5)::DOUBLE AS q50, quantile_cont(n_chars, 0.75)::DOUBLE AS q75, max(n_chars)::DOUBLE AS high FROM documents GROUP BY source")
def boxplot_stats(spark, sf):
    return p.five_numbers(read(spark, sf, "documents"), "source", "n_chars")


@query("SELECT source, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS share, count(*) < 50 AS is_few, count(*) < 20 AS is_very_few FROM documents GROUP BY source")
def category_balance(spark, sf):
    return p.balance(read(spark, sf, "documents"), "source")


@query("WITH l(lang) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('it'), ('pt')), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, coalesce(n, 0) AS n, n IS NULL AS is_gap FROM l LEFT JOIN n USING (lang)")
def domain_coverage(spark, sf):
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "it", "pt")])).alias("lang"))
    return p.coverage(listed, read(spark, sf, "documents"), "lang")


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n_domains FROM n) SELECT source, lang AS main_domain, n::DOUBLE / total::DOUBLE AS main_share, n_domains, n_domains > 1 AS is_multi FROM k WHERE r = 1")
def category_domain_bridge(spark, sf):
    return p.bridge(read(spark, sf, "documents"), "source", "lang")


@query("WITH a AS (SELECT lang, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS x FROM documents GROUP BY lang), b AS (SELECT lang, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY lang) SELECT lang, coalesce(x, 0.0) AS left_share, coalesce(y, 0.0) AS right_share, coalesce(x, 0.0) - coalesce(y, 0.0) AS difference FROM a FULL JOIN b USING (lang)")
def domain_share_diff(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    return p.share_difference(docs, docs.join(read(spark, sf, "labels").where("quality = 0"), "doc_id"), "lang")


@query("SELECT CAST(floor(n_chars / 500.0) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, sf):
    return p.histogram(read(spark, sf, "documents"), "n_chars", 500)


MEASURED = f"{D_CLEAN}, f AS (SELECT doc_id, source, lang, {FEATURES} FROM w)"


def measured(spark, sf):
    return with_features(cleaned(spark, sf, "doc_id", "lang"), "desc_clean", "desc_")


@query(f"WITH {MEASURED} SELECT count(*) AS n, round(corr(desc_text_length::DOUBLE, desc_lexical_diversity), 6) AS r FROM f")
def length_pearson(spark, sf):
    return p.pearson(measured(spark, sf), "desc_text_length", "desc_lexical_diversity")


@query(f"WITH {MEASURED} SELECT lang, count(*) AS n, round(avg(desc_text_length), 6) AS mean_length, round(avg(desc_lexical_diversity), 6) AS mean_diversity FROM f GROUP BY lang")
def profile_by_domain(spark, sf):
    return p.profile(measured(spark, sf), "lang", "desc_text_length", "desc_lexical_diversity")


@query(f"""WITH {TOKENS}, c1 AS (SELECT source, term, count(*) AS n FROM tk GROUP BY ALL), tt AS (SELECT term, sum(n) AS all_n FROM c1 GROUP BY term), gg AS (SELECT source, sum(n) AS group_n FROM c1 GROUP BY source),
k AS (SELECT source, term, n, round(n::DOUBLE * (SELECT sum(group_n) FROM gg)::DOUBLE / (group_n::DOUBLE * all_n::DOUBLE), 6) AS lift FROM c1 JOIN tt USING (term) JOIN gg USING (source) WHERE n >= 20)
SELECT source, CAST(rank AS INTEGER) AS rank, term, n, lift FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lift DESC, term) AS rank FROM k) WHERE rank <= 5""")
def signature_terms(spark, sf):
    return terms.signature_terms(cleaned(spark, sf, "source"), "source", "desc_clean")


SIDES = f"a AS (SELECT doc_id AS id, {q_words(q_clean('text'))} AS ws FROM documents), b AS (SELECT item_id AS id, {q_words(q_clean('text'))} AS ws FROM benchmark)"


def benchmark(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", t.clean(F.col("text")).alias("desc_clean"))


@query(f"""WITH {SIDES}, x AS (SELECT term, 1 AS l FROM (SELECT unnest(ws) AS term FROM a) GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000), y AS (SELECT term, 1 AS r FROM (SELECT unnest(ws) AS term FROM b) GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000)
SELECT count(*) FILTER (l = 1 AND r = 1) AS n_shared, count(*) AS n_all, count(*) FILTER (l = 1 AND r = 1)::DOUBLE / count(*)::DOUBLE AS jaccard FROM x FULL JOIN y USING (term)""")
def vocab_jaccard_topn(spark, sf):
    return terms.jaccard_top(cleaned(spark, sf, "doc_id"), benchmark(spark, sf), "desc_clean")


def q_tfidf(name: str, rows: str, grams: str = "ws", keep: str = "id") -> str:
    """CTEs from ``rows`` (id, ws) to ``name`` (id, term, tf, w)."""
    return f"""{name}_g AS (SELECT id, unnest({grams}) AS term FROM (SELECT id, list_filter(ws, lambda v: length(v) >= 2) AS ws FROM {rows})), {name}_c AS (SELECT id, term, count(*) AS tf FROM {name}_g GROUP BY ALL),
{name}_v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {name}_c GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 5000),
{name}_r AS (SELECT id, term, tf, tf * (ln(((SELECT count(*) FROM {rows}) + 1)::DOUBLE / (df + 1)::DOUBLE) + 1) AS raw FROM {name}_c JOIN {name}_v USING (term)), {name} AS (SELECT id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM {name}_r)"""


@query(f"WITH {SIDES}, {q_tfidf('p', 'a')}, {q_tfidf('q', 'b')}, x AS (SELECT term, sum(w) / (SELECT count(*) FROM a) AS w FROM p GROUP BY term), y AS (SELECT term, sum(w) / (SELECT count(*) FROM b) AS v FROM q GROUP BY term) SELECT count(*) AS n_shared, round(sum(least(w, v)), 6) AS overlap FROM x JOIN y USING (term)")
def vocab_weighted_overlap(spark, sf):
    return terms.weighted_overlap(read(spark, sf, "documents"), read(spark, sf, "benchmark"), "doc_id", "text", "item_id", clean=t.clean)


@query(f"""WITH {TOKENS}, a AS (SELECT DISTINCT lang AS left_group, term FROM tk), b AS (SELECT DISTINCT lang AS right_group, term FROM tk), na AS (SELECT left_group, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT right_group, count(*) AS nb FROM b GROUP BY 1), sh AS (SELECT left_group, right_group, count(*) AS n_shared FROM a JOIN b USING (term) GROUP BY ALL)
SELECT left_group, right_group, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared, 0)::DOUBLE / (na + nb - coalesce(n_shared, 0))::DOUBLE AS jaccard FROM na CROSS JOIN nb LEFT JOIN sh USING (left_group, right_group)""")
def category_jaccard_matrix(spark, sf):
    docs = cleaned(spark, sf, "lang")
    return terms.jaccard_matrix(docs, docs, "lang", "desc_clean")


@query(f"""WITH {SIDES}, {q_tfidf('p', 'a')}, m AS (SELECT lang, term, sum(w) AS w FROM p JOIN documents d ON d.doc_id = p.id GROUP BY ALL), l AS (SELECT lang, sqrt(sum(w * w)) AS len FROM m GROUP BY lang), d AS (SELECT x.lang AS left_group, y.lang AS right_group, sum(x.w * y.w) AS d FROM m x JOIN m y USING (term) GROUP BY ALL)
SELECT left_group, right_group, round(d / (x.len * y.len), 6) AS cosine FROM d JOIN l x ON x.lang = left_group JOIN l y ON y.lang = right_group""")
def category_tfidf_cosine(spark, sf):
    return terms.group_cosine(read(spark, sf, "documents"), "doc_id", "lang", "text", clean=t.clean)


@query(f"""WITH a AS (SELECT unnest({q_match(q_words(q_clean('text')), SKILL_WORDS)}) AS tag FROM documents), b AS (SELECT unnest({q_match(q_words(q_clean('text')), SKILL_WORDS)}) AS tag FROM conversations), x AS (SELECT tag, count(*) AS supply FROM a GROUP BY tag), y AS (SELECT tag, count(*) AS demand FROM b GROUP BY tag)
SELECT tag, coalesce(supply, 0) AS supply, coalesce(demand, 0) AS demand, coalesce(demand, 0) - coalesce(supply, 0) AS gap FROM x FULL JOIN y USING (tag)""")
def skill_supply_demand(spark, sf):
    sides = [texts(spark, sf, n).select(t.skills(t.clean(F.col("text")), SKILL_WORDS).alias("tag")) for n in ("documents", "conversations")]
    return p.supply_demand(*sides, "tag")


@query(f"WITH {SIDES}, {q_tfidf('p', 'a', GRAMS)} SELECT term, df, cf FROM p_v")
def tfidf_vocab(spark, sf):
    return terms.vocabulary(terms.dealt(read(spark, sf, "documents"), "doc_id", "text"), "doc_id", "text", clean=t.clean)


@query(f"WITH {SIDES}, {q_tfidf('p', 'a', GRAMS)} SELECT id AS doc_id, term, tf, round(w, 6) AS tfidf FROM p")
def tfidf_weights(spark, sf):
    return terms.tfidf(read(spark, sf, "documents"), "doc_id", "text", clean=t.clean).withColumn("tfidf", F.round("tfidf", 6))


def q_nearest(score: str) -> str:
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), x AS (SELECT q.vec_id AS query_id, e.vec_id, round({score}, 6) AS sim_score FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, sim_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim_score DESC, vec_id) AS rank FROM x) WHERE rank <= 5"""


@query(q_nearest("list_inner_product(q.v, e.v)"))
def vector_top_n_ip(spark, sf):
    e = read(spark, sf, "embeddings")
    return s.vector_top_n(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", cosine=False)


@query(q_nearest("list_cosine_similarity(q.v, e.v)"))
def vector_top_n_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    return s.vector_top_n(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding")


@query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS length, round(list_inner_product(u, u), 6) AS unit FROM (SELECT vec_id, v, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))")
def vector_normalize(spark, sf):
    v, u = F.col("embedding"), F.col("u")
    return read(spark, sf, "embeddings").withColumn("u", vectors.normalized(v)).select("vec_id", F.round(vectors.norm(v), 6).alias("length"), F.round(vectors.dot(u, u), 6).alias("unit"))


@query(f"""WITH {SIDES}, {q_tfidf('p', 'a')}, q_r AS (SELECT id, term, count(*) * (ln(((SELECT count(*) FROM a) + 1)::DOUBLE / (df + 1)::DOUBLE) + 1) AS raw FROM (SELECT id, unnest(list_filter(ws, lambda v: length(v) >= 2)) AS term FROM b) JOIN p_v USING (term) GROUP BY id, term, df), q AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM q_r),
x AS (SELECT q.id AS item_id, p.id AS doc_id, round(sum(p.w * q.w), 6) AS sim_score FROM p JOIN q USING (term) GROUP BY ALL) SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, sim_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim_score DESC, doc_id) AS rank FROM x) WHERE rank <= 5""")
def recommend_tfidf_top5(spark, sf):
    return s.tfidf_top_n(read(spark, sf, "documents"), read(spark, sf, "benchmark"), "doc_id", "item_id", "text", clean=t.clean)


@query("SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2) THEN 'test' ELSE 'train' END AS split FROM labels")
def stratified_split(spark, sf):
    return r.stratified_split(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("SELECT term, n, cf FROM (SELECT unnest(['a', 'b']) AS term, 1 AS n, 2 AS cf) WHERE false UNION ALL (SELECT lang AS term, CAST(1 AS INTEGER) AS n, CAST(2 AS INTEGER) AS cf FROM documents) UNION ALL (SELECT role, 1, 2 FROM conversations)")
def bag_union(spark, sf):
    a = read(spark, sf, "documents").select(F.col("lang").alias("term"), F.lit(1).alias("n"), F.lit(2).alias("cf"))
    b = read(spark, sf, "conversations").select(F.lit(1).alias("n"), F.col("role").alias("term"), F.lit(2).alias("cf"))
    return r.bag_union(a, b)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def corpus_roundtrip(spark, sf):
    at = save_corpus(read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), f"{folder(spark, 'roundtrip')}.parquet")
    return load_corpus(spark, at)


def trained(spark: SparkSession, sf: str, path: str | None = None, **options):
    docs, labels = read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return classify.train(docs.join(labels, "doc_id"), "doc_id", "text", "quality", path, **options)


@query()
def classifier_train_predict(spark, sf):
    model, test = trained(spark, sf)
    return classify.predict(model, test).select("doc_id", "quality", "predicted")


@query()
def classifier_metrics(spark, sf):
    model, test = trained(spark, sf, balanced=True, iterations=50)
    return classify.metrics(classify.predict(model, test), "quality")


def q_lemma(w: str) -> str:
    cases = " ".join(f"WHEN {w} = '{form}' THEN '{by}'" for form, by in lemma.IRREGULAR.items())
    cases += " " + " ".join(f"WHEN regexp_matches({w}, '{x}') THEN regexp_replace({w}, '{x}', '{y}')" for x, y in lemma.ENDINGS)
    return f"CASE {cases} ELSE {w} END"


@query(f"""WITH {D_CLEAN}, u AS (SELECT DISTINCT unnest(ws) AS word FROM w), m AS (SELECT map_from_entries(list((word, {q_lemma('word')}))) AS t FROM u), k AS (SELECT doc_id, ws, list_transform(ws, lambda v: t[v]) AS ls FROM w, m)
SELECT doc_id, array_to_string(ws, ' ') AS terms, array_to_string(list_transform(list_filter(list_zip(ws, ls), lambda z: NOT list_contains(['the', 'of', 'and', 'is'], z[1])), lambda z: z[2]), ' ') AS lemmas, CAST(len(ws) AS BIGINT) AS n_tokens FROM k""")
def lemmatize(spark, sf):
    found = lemma.dictionary_lemmas(F.col("desc_clean"), ["the", "of", "and", "is"], counted=True)
    return cleaned(spark, sf, "doc_id").withColumn("l", found).select("doc_id", "l.terms", "l.lemmas", F.col("l.n_tokens").cast("long").alias("n_tokens"))


STOPS = ("the", "of", "and", "is", "la", "und", "der", "que")


@query(f"""WITH {D_CLEAN}, tk AS (SELECT lang, unnest(list_filter(ws, lambda v: length(v) >= 2)) AS term FROM w), n AS (SELECT lang, term, count(*) AS n FROM tk WHERE term NOT IN ({', '.join(f"'{x}'" for x in STOPS)}) GROUP BY ALL),
m AS (SELECT a.lang, coalesce(b.term, a.term) AS term, CAST(sum(a.n) AS BIGINT) AS n FROM n a LEFT JOIN n b ON a.lang = b.lang AND regexp_matches(a.term, '[^s]s$') AND b.term = left(a.term, length(a.term) - 1) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM m)
SELECT lang, CAST(rank AS INTEGER) AS rank, term, n, n::DOUBLE / max(n) OVER (PARTITION BY lang)::DOUBLE AS weight FROM k WHERE rank <= 40""")
def word_cloud_plurals(spark, sf):
    return terms.term_weights(cleaned(spark, sf, "lang"), "lang", "desc_clean", 40, STOPS, plurals=True)


@query(f"WITH a AS (SELECT doc_id, text, sha256(text) AS h, trim(coalesce(text, '')) = '' OR len({q_words('text')}) < 20 AS gone FROM documents), f AS (SELECT h, min(doc_id) AS doc_id FROM a WHERE NOT gone GROUP BY h) SELECT a.doc_id, a.h AS text_sha FROM a JOIN f USING (doc_id)")
def qa_pruned(spark, sf):
    docs = texts(spark, sf)
    flagged = p.text_flags(docs, "text", "n_chars", F.array().cast("array<string>"))
    return p.pruned(flagged, "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query(f"""WITH a AS (SELECT lang, unnest({q_match(q_words(q_clean('text')), SKILL_WORDS)}) AS tag FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, unnest({q_match(q_words(q_clean('text')), SKILL_WORDS)}) AS tag FROM documents WHERE doc_id % 2 = 1), x AS (SELECT lang, tag, count(*) AS supply FROM a GROUP BY ALL), y AS (SELECT lang, tag, count(*) AS demand FROM b GROUP BY ALL)
SELECT lang, tag, coalesce(supply, 0) AS supply, coalesce(demand, 0) AS demand, coalesce(demand, 0) - coalesce(supply, 0) AS gap FROM x FULL JOIN y USING (lang, tag)""")
def skill_gap_by_domain(spark, sf):
    tagged = texts(spark, sf).select("doc_id", "lang", t.skills(t.clean(F.col("text")), SKILL_WORDS).alias("tag"))
    return p.supply_demand_by(tagged.where("doc_id % 2 = 0"), tagged.where("doc_id % 2 = 1"), "lang", "tag")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that the session names for checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id AS job_id, source AS title, text AS description FROM documents")
def csv_postings(spark, sf):
    path = folder(spark, "postings")
    delimited.write_csv(read(spark, sf, "documents").select("lang", F.col("source").alias("title"), F.col("text").alias("description"), F.col("doc_id").alias("job_id")), path)
    return delimited.read_csv(spark, path, delimited.POSTINGS)


@query("SELECT doc_id AS ID, text AS Resume_str, '<p>' || source || '</p>' AS Resume_html, lang AS Category FROM documents")
def csv_resumes(spark, sf):
    path = folder(spark, "resumes")
    delimited.write_csv(read(spark, sf, "documents").select(F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), F.concat(F.lit("<p>"), "source", F.lit("</p>")).alias("Resume_html"), F.col("lang").alias("Category")), path)
    return delimited.read_csv(spark, path, delimited.RESUMES)


@query("SELECT l_orderkey AS job_id, l_returnflag AS skill_abr, CASE l_returnflag WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'November' END AS skill_name FROM lineitem")
def csv_links_and_mapping(spark, sf):
    links_at, names_at = folder(spark, "job_skills"), folder(spark, "skills")
    delimited.write_csv(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("skill_abr")), links_at)
    delimited.write_csv(spark.createDataFrame([("A", "Alpha"), ("N", "November")], delimited.SKILL_NAMES), names_at)
    return r.map_codes(delimited.read_csv(spark, links_at, delimited.SKILL_LINKS), delimited.read_csv(spark, names_at, delimited.SKILL_NAMES), "skill_abr")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _row_pos, doc_id, source FROM documents")
def csv_processed(spark, sf):
    path = folder(spark, "processed")
    delimited.write_csv(read(spark, sf, "documents").select("doc_id", "source"), path)
    return delimited.read_processed(spark, path, "doc_id bigint, source string", "doc_id")


@query("WITH s AS (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2) AS test FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n_test, 0::BIGINT AS n_different FROM s WHERE test")
def classifier_saved_and_loaded(spark, sf):
    path = folder(spark, "classifier")
    model, test = trained(spark, sf, path)
    a, b = (classify.predict(m, test).select("doc_id", F.col("predicted").alias(n)) for m, n in ((model, "a"), (classify.load(path), "b")))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n_test"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_different"))


LETTERS = "abcdefgh"


def letter_counts():
    """A stand-in for an encoder from outside: how often each of a few letters is in a text."""
    return lambda texts: [[float(x.count(c)) for c in LETTERS] for x in texts]


Q_COUNTS = "[" + ", ".join(f"(length(x) - length(replace(x, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


@query(f"""WITH {D_CLEAN}, v AS (SELECT doc_id, {Q_COUNTS} AS v FROM c), q AS (SELECT {Q_COUNTS} AS q FROM (SELECT {q_clean("'A bad cab had a fed egg, deaf beach hag'")} AS x)), s AS (SELECT doc_id, CASE WHEN list_inner_product(v, v) = 0 THEN 0.0 ELSE list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) END AS sim FROM v, q)
SELECT doc_id, round(sim, 9) AS sim_score FROM s ORDER BY sim DESC, doc_id LIMIT 5""")
def recommend_one_text(spark, sf):
    encode = s.encoder(letter_counts)
    items = cleaned(spark, sf, "doc_id").select("doc_id", encode(F.col("desc_clean")).alias("v"))
    return s.recommend("A bad cab had a fed egg, deaf beach hag", items, "doc_id", "v", encode).select("doc_id", F.round("sim_score", 9).alias("sim_score"))


@query("SELECT doc_id, 'report not available' AS report FROM documents")
def report_stub(spark, sf):
    return read(spark, sf, "documents").select("doc_id", t.report(F.col("text")).alias("report"))
