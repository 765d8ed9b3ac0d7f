"""Queries over concepts: phrases, mentions, co-occurrence, scores, supports, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.catalog import sql as q
from studyloom.catalog.text import lines, sentences
from studyloom.operators import concepts, lint_script
from studyloom.session import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


_LIKE = f"""len(string_split(phrase, ' ')) BETWEEN 2 AND 4 AND string_split(phrase, ' ')[1] NOT IN {q.values(concepts.STOPWORDS + concepts.BOUNDARY_VERBS)} AND string_split(phrase, ' ')[-1] NOT IN {q.values(concepts.STOPWORDS + concepts.BOUNDARY_VERBS)}
 AND phrase NOT IN {q.values(concepts.NON_CONCEPTS)} AND NOT list_has_any(string_split(phrase, ' '), ['and', 'or', 'but', 'versus', 'vs']) AND len(list_filter(string_split(phrase, ' '), lambda w: length(w) <= 1)) = 0"""
_GRAMS = f"toks AS (SELECT doc_id, ord, sent_ix, text, {q.tokens('text')} AS t FROM sents)"
_PHRASES = f"""grams AS (SELECT doc_id, ord, sent_ix, unnest(list_concat(list_concat({q.ngrams('t', 2)}, {q.ngrams('t', 3)}), {q.ngrams('t', 4)})) AS phrase FROM toks),
rep AS (SELECT doc_id, phrase, count(*) AS mentions FROM grams WHERE {_LIKE} GROUP BY doc_id, phrase HAVING count(*) >= 4)"""
_BASE = f"WITH {q.LINES}, {q.SENTENCES}, {_GRAMS}, {_PHRASES}"
#: Concepts of the set-based queries: the repeated phrases of each document.
_CONCEPTS = ", con AS (SELECT doc_id, 'c_' || substr(sha256(phrase), 1, 10) AS concept_id, phrase AS canonical FROM rep)"
_MENTIONS = ", men AS (SELECT doc_id, ord, sent_ix, concept_id, count(*) AS n FROM grams JOIN con ON grams.doc_id = con.doc_id AND grams.phrase = con.canonical GROUP BY ALL)".replace("SELECT doc_id, ord", "SELECT grams.doc_id, ord")


def phrase_concepts(spark: SparkSession, d: str) -> DataFrame:
    rep = concepts.repeated_phrases(sentences(spark, d))
    from studyloom.schema import concept_id

    return rep.select("doc_id", concept_id(F.col("phrase")).alias("concept_id"), F.col("phrase").alias("canonical"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("short_def"))


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sentences and concepts, kept (memory, then disk) because every signal reads them again."""
    return sentences(spark, d).persist(), phrase_concepts(spark, d).persist()


@query(f"{_BASE} SELECT * FROM rep")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return concepts.repeated_phrases(sentences(spark, d))


@query(f"{_BASE}{_CONCEPTS}{_MENTIONS} SELECT doc_id, concept_id, sum(n)::BIGINT AS mentions, count(*) AS sentences FROM men GROUP BY doc_id, concept_id")
def concept_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = concepts.mentions(sentences(spark, d), phrase_concepts(spark, d))
    return found.groupBy("doc_id", "concept_id").agg(F.sum("n").alias("mentions"), F.count("*").alias("sentences"))


@query(f"{_BASE}{_CONCEPTS}{_MENTIONS} SELECT a.doc_id, a.concept_id, count(DISTINCT b.concept_id) AS degree FROM men a JOIN men b ON a.doc_id = b.doc_id AND a.ord = b.ord AND a.sent_ix = b.sent_ix AND a.concept_id <> b.concept_id GROUP BY ALL")
def concept_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return concepts.cooccurrence(concepts.mentions(sentences(spark, d), phrase_concepts(spark, d)))


_W = "regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9_''-]*')"
_CONC = f"(CASE WHEN length(w) <= 3 THEN 3.0 WHEN regexp_matches(w, '({'|'.join(concepts.ABSTRACT_SUFFIXES)})$') THEN 1.8 WHEN regexp_matches(w, '({'|'.join(concepts.CONCRETE_SUFFIXES)})$') THEN 4.0 WHEN length(w) >= 11 THEN 2.5 WHEN length(w) <= 5 THEN 3.6 ELSE 3.0 END)::DOUBLE"
_CW = "regexp_extract_all(lower(canonical), '[a-z][a-z''-]+')"
_RAW = f""", raw AS (SELECT c.doc_id, c.concept_id, c.canonical,
  (5 - least(5.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN len({_CW}) = 0 THEN 3.0::DOUBLE ELSE list_sum(list_transform({_CW}, lambda w: {_CONC})) / len({_CW}) END))) / 4 AS abstractness,
  (len(list_filter({_W.format(t='canonical')}, lambda x: length(x) > 3)) + 2 * len(regexp_extract_all(canonical, '(?i)\\b(and|or|between|with|relative to|per|versus|while)\\b')) + 2 * len(regexp_extract_all(canonical, '(?i)\\b(which|that|where|when|whose)\\b')))::DOUBLE AS interactivity,
  (list_sum(list_transform({_W.format(t='canonical')}, lambda x: length(x))) / len({_W.format(t='canonical')}) / 12.0::DOUBLE + len(list_filter({_W.format(t='canonical')}, lambda x: length(x) >= 9)) / len({_W.format(t='canonical')}))::DOUBLE AS unfamiliarity,
  len({_W.format(t='canonical')})::DOUBLE AS span, coalesce(m.reprise, 0)::DOUBLE AS reprise, coalesce(m.density, 0)::DOUBLE AS density, 0::DOUBLE AS position, coalesce(m.author_signal, 0)::DOUBLE AS author_signal, 0::DOUBLE AS evidence, coalesce(g.degree, 0)::DOUBLE AS connectedness
 FROM con c LEFT JOIN (SELECT men.doc_id, concept_id, sum(n) AS reprise, avg(CASE WHEN len({_W.format(t='text')}) > 0 THEN len({_W.format(t='text')}) / 25.0::DOUBLE + len(regexp_extract_all(text, '[0-9]')) / 20.0::DOUBLE + len(regexp_extract_all(text, ',')) / 6.0::DOUBLE END) AS density,
   count(*) FILTER (regexp_matches(text, {q.quoted(concepts.AUTHOR_SIGNALS)})) AS author_signal FROM men JOIN sents ON men.doc_id = sents.doc_id AND men.ord = sents.ord AND men.sent_ix = sents.sent_ix GROUP BY men.doc_id, concept_id) m USING (doc_id, concept_id)
 LEFT JOIN (SELECT a.doc_id, a.concept_id, count(DISTINCT b.concept_id) AS degree FROM men a JOIN men b ON a.doc_id = b.doc_id AND a.ord = b.ord AND a.sent_ix = b.sent_ix AND a.concept_id <> b.concept_id GROUP BY ALL) g USING (doc_id, concept_id))"""


def _scaled(c: str) -> str:
    low, high = f"min({c}) OVER (PARTITION BY doc_id)", f"max({c}) OVER (PARTITION BY doc_id)"
    return f"CASE WHEN abs({high} - {low}) <= 1e-9 * greatest(abs({high}), abs({low})) THEN 0.5 ELSE ({c} - {low}) / ({high} - {low}) END"


_SCORED = f""", norm AS (SELECT doc_id, concept_id, canonical, {', '.join(f'{_scaled(c)} AS {c}' for c in (*concepts.DIFFICULTY, *concepts.IMPORTANCE))} FROM raw),
 sc AS (SELECT doc_id, concept_id, canonical, least(1.0, greatest(0.0, ({' + '.join(f'{c} * {w}::DOUBLE' for c, w in concepts.DIFFICULTY.items())}) * 1.15::DOUBLE))::DOUBLE AS difficulty, least(1.0, greatest(0.0, {' + '.join(f'{c} * {w}::DOUBLE' for c, w in concepts.IMPORTANCE.items())}))::DOUBLE AS importance FROM norm)"""


@query(f"{_BASE}{_CONCEPTS}{_MENTIONS}{_RAW}{_SCORED} SELECT doc_id, concept_id, round(difficulty, 6) AS difficulty, round(importance, 6) AS importance, round(difficulty * importance, 6) AS budget FROM sc")
def concept_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ten signals per concept, scaled within its document and weighed into difficulty, importance and budget."""
    s, c = _corpus(spark, d)
    scored = concepts.score(concepts.raw_signals(s, c, concepts.mentions(s, c).persist()))
    return scored.select("doc_id", "concept_id", *(F.round(x, 6).alias(x) for x in ("difficulty", "importance", "budget")))


@query(f"{_BASE}{_CONCEPTS}{_MENTIONS}{_RAW}{_SCORED} SELECT doc_id, concept_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(difficulty * importance, 9) DESC, canonical) AS rank FROM sc) WHERE rank <= 3")
def ranked_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The three concepts of every document with the largest budget (a top-k by definition)."""
    s, c = _corpus(spark, d)
    scored = concepts.score(concepts.raw_signals(s, c, concepts.mentions(s, c).persist())).withColumn("budget", F.round("budget", 9))
    return concepts.ranked(scored, 3).select("doc_id", "concept_id", "rank")


@query(f"WITH s AS (SELECT concept_id, (substr(concept_id, 3, 6)) AS h FROM (SELECT DISTINCT 'c_' || substr(sha256(p_name), 1, 10) AS concept_id FROM part)), v AS (SELECT concept_id, ('0x' || h)::BIGINT / 16777216.0::DOUBLE AS x FROM s) SELECT concept_id, (2 + round_even(1 * least(1.0, greatest(0.0, x * 1.5::DOUBLE)), 0))::INT AS reps FROM v")
def repetitions(spark: SparkSession, d: str) -> DataFrame:
    """How many exposures a budget earns, half-even rounding included (budgets from hashes of names)."""
    from studyloom.operators.exposure import repetitions_for
    from studyloom.schema import digest

    ids = table(spark, d, "part").select(digest("c_", F.col("p_name"), length=10).alias("concept_id")).distinct()
    x = F.conv(F.substring("concept_id", 3, 6), 16, 10).cast("bigint") / F.lit(16777216.0)
    return ids.select("concept_id", repetitions_for(x, F.lit(1.5)).alias("reps"))


@query(f"""{_BASE}, sub AS (SELECT doc_id, phrase AS long, mentions AS n_long, unnest(list_distinct(list_filter(list_concat(list_concat(string_split(phrase, ' '), {q.ngrams("string_split(phrase, ' ')", 2)}), {q.ngrams("string_split(phrase, ' ')", 3)}), lambda g: g <> phrase))) AS short FROM rep),
pr AS (SELECT sub.doc_id, short, long, n_long, r.mentions AS n_short, CASE WHEN n_long >= 0.8::DOUBLE * r.mentions THEN 'short' WHEN n_long < 0.35::DOUBLE * r.mentions THEN 'long' END AS loser FROM sub JOIN rep r ON sub.doc_id = r.doc_id AND sub.short = r.phrase)
SELECT doc_id, short, long, n_long, n_short, loser FROM pr WHERE loser IS NOT NULL""")
def redundant_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of phrases of which one explains the other."""
    return concepts.redundant_pairs(concepts.repeated_phrases(sentences(spark, d)))


@query()
def drop_redundant(spark: SparkSession, d: str) -> DataFrame:
    return concepts.drop_redundant(concepts.repeated_phrases(sentences(spark, d)))


@query()
def acronym_defs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("ord"), F.lit(0).alias("sent_ix"), F.concat(F.lit("the solid electrolyte interphase (SEI) and "), F.substring("text", 1, 1 << 30)).alias("text"))
    return concepts.acronyms(docs).groupBy("canonical", "alias").agg(F.count("*").alias("n"))


@query()
def definition_finds(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of each document's repeated phrases, where the text gives one."""
    s = sentences(spark, d).withColumn("text", F.regexp_replace("text", r"^(\w+ \w+) ", "$1 is a thing that keeps its shape under load; "))
    return concepts.find_definitions(s, concepts.repeated_phrases(s).select("doc_id", F.col("phrase").alias("term")))


@query()
def concept_candidates(spark: SparkSession, d: str) -> DataFrame:
    return concepts.candidates(sentences(spark, d))


_INFO = f"CASE WHEN {q.word_count('text')} = 0 THEN 0.0 ELSE 0.5 * least({q.word_count('text')} / 25.0::DOUBLE, 1.0::DOUBLE) + 0.5 * least(len(regexp_extract_all(text, '[0-9]')) / {q.word_count('text')}::DOUBLE * 4, 1.0::DOUBLE) - CASE WHEN regexp_matches(text, '(?i)\\bmay\\b|\\bmight\\b|\\bcould\\b|\\bpossibly\\b') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END END"


@query(f"""{_BASE}{_CONCEPTS}{_MENTIONS}, sup AS (SELECT sents.doc_id, concept_id, sents.ord, sents.sent_ix, 0.4::DOUBLE + ({_INFO}) + CASE WHEN regexp_matches(text, {q.quoted(concepts.DEFINES)}) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS score,
 regexp_matches(text, {q.quoted(concepts.DEFINES)}) AS definitional, regexp_matches(text, {q.quoted(concepts.CAUSES)}) AS causal FROM sents JOIN men ON sents.doc_id = men.doc_id AND sents.ord = men.ord AND sents.sent_ix = men.sent_ix WHERE {q.word_count('text')} BETWEEN 6 AND 35)
SELECT doc_id, concept_id, row_number() OVER (PARTITION BY doc_id, concept_id ORDER BY round(score, 9) DESC, ord, sent_ix)::INT AS rank, ord::INT AS ord, sent_ix::INT AS sent_ix, round(score, 6) AS score, definitional, causal FROM sup""")
def support_rank(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    ranked = concepts.supports(s, concepts.mentions(s, phrase_concepts(spark, d)))
    return ranked.select("doc_id", "concept_id", "rank", "ord", "sent_ix", F.round("score", 6).alias("score"), "definitional", "causal")


@query()
def distinct_supports(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    kept = concepts.distinct_supports(concepts.supports(s, concepts.mentions(s, phrase_concepts(spark, d))))
    return kept.groupBy("doc_id", "concept_id").agg(F.count("*").alias("kept"), F.max("rank").alias("last_rank"))


_AB = f"(5 - least(5.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN len(regexp_extract_all(lower(p_name), '[a-z][a-z''-]+')) = 0 THEN 3.0::DOUBLE ELSE list_sum(list_transform(regexp_extract_all(lower(p_name), '[a-z][a-z''-]+'), lambda w: {_CONC})) / len(regexp_extract_all(lower(p_name), '[a-z][a-z''-]+')) END))) / 4"


@query(f"SELECT p_partkey, round({_AB}, 9) AS abstractness FROM part")
def word_abstractness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(concepts.abstractness(F.col("p_name")), 9).alias("abstractness"))


@query(f"""WITH norms(word, mean) AS (VALUES ('gold', 4.9), ('green', 4.1), ('red', 4.3), ('part', 3.2)), w AS (SELECT DISTINCT p_name AS phrase FROM part), u AS (SELECT phrase, unnest(regexp_extract_all(lower(phrase), '[a-z][a-z''-]+')) AS w FROM w)
SELECT phrase, round(avg(coalesce(a.mean::DOUBLE, b.mean::DOUBLE, {_CONC})), 9) AS mean FROM u LEFT JOIN norms a ON u.w = a.word LEFT JOIN norms b ON u.w = b.word || 's' GROUP BY phrase""")
def norms_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Words looked up in a norms table, exactly and without a plural s, with the shape rule behind it."""
    norms = spark.createDataFrame([("gold", 4.9), ("green", 4.1), ("red", 4.3), ("part", 3.2)], "word string, mean double")
    out = concepts.phrase_concreteness(table(spark, d, "part").select(F.col("p_name").alias("phrase")), norms)
    return out.select("phrase", F.round("mean", 9).alias("mean"))


_FRESH = "SELECT doc_id, 'k' || (doc_id % 7) AS concept_id, lang AS canonical, (n_chars % 100) / 100.0::DOUBLE AS difficulty, (n_chars % 10) / 10.0::DOUBLE AS importance FROM documents"
_PREV = "SELECT doc_id, 'k' || ((doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 7) AS concept_id, 'old' AS canonical, 0.5::DOUBLE AS difficulty, 0.5::DOUBLE AS importance, CASE WHEN quality = 1 THEN '0.9' END AS over FROM labels"


@query(f"""WITH n AS ({_FRESH}), o AS ({_PREV})
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.concept_id, o.concept_id) AS concept_id, coalesce(n.canonical, o.canonical) AS canonical, round(coalesce(over::DOUBLE, n.difficulty, o.difficulty), 6) AS difficulty, round(coalesce(n.importance, o.importance), 6) AS importance, n.canonical IS NULL AS orphan
FROM n FULL OUTER JOIN o ON n.doc_id = o.doc_id AND n.concept_id = o.concept_id WHERE n.canonical IS NOT NULL OR over IS NOT NULL""")
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """A fresh registry over an edited one: overrides win, edited orphans stay (documents against labels, some under another concept)."""
    docs = table(spark, d, "documents")
    key = F.concat(F.lit("k"), (F.col("doc_id") % 7).cast("string"))
    fresh = docs.select("doc_id", key.alias("concept_id"), F.col("lang").alias("canonical"), (F.col("n_chars") % 100 / 100.0).alias("difficulty"), (F.col("n_chars") % 10 / 10.0).alias("importance"))
    over = F.when(F.col("quality") == 1, F.create_map(F.lit("difficulty"), F.lit("0.9"))).otherwise(F.create_map().cast("map<string,string>"))
    previous = table(spark, d, "labels").select("doc_id", F.concat(F.lit("k"), ((F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)) % 7).cast("string")).alias("concept_id"), F.lit("old").alias("canonical"), F.lit(0.5).alias("difficulty"), F.lit(0.5).alias("importance"), over.alias("overrides"))
    out = concepts.merge_registry(fresh, previous)
    return out.select("doc_id", "concept_id", "canonical", F.round("difficulty", 6).alias("difficulty"), F.round("importance", 6).alias("importance"), "orphan")


_BW = "regexp_extract_all(lower(text), '[a-z0-9_''-]+')"
_RUNS = f"(CASE WHEN len({_BW}) >= 8 THEN list_transform(range(1, len({_BW}) - 6), lambda i: array_to_string({_BW}[i : i + 7], ' ')) ELSE []::VARCHAR[] END)"


@query(f"""WITH a AS (SELECT doc_id, unnest(list_distinct({_RUNS})) AS run FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, unnest(list_distinct({_RUNS})) AS run FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (run) GROUP BY doc_id, item_id""")
def verbatim_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Runs of eight words that documents and benchmark items share."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(lint_script.runs("text"))).alias("run"))
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(lint_script.runs("text"))).alias("run"))
    return docs.join(items, "run").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query(f"WITH {q.LINES} SELECT doc_id, count(*) AS blocks FROM lines GROUP BY doc_id")
def block_counts(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("blocks"))
