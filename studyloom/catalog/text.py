"""Queries over texts: sources, cleaning, triage, verbalization, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.catalog import sql as q
from studyloom.functions import spoken, text
from studyloom.operators import clean, grounding, lint_text, triage
from studyloom.session import table
from studyloom.schema import block_id
from studyloom.sources import adapters, layout

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of all documents; dealt by document, as every pass that orders or groups a document's blocks needs them."""
    return clean.line_blocks(table(spark, d, "documents").select("doc_id", "text").repartition("doc_id"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, sent_ix, text) of the lines, without abbreviation guards."""
    return lines(spark, d).select("doc_id", "ord", F.posexplode(text.sentences("text")).alias("sent_ix", "text"))


_REASON = "CASE " + " ".join(f"WHEN regexp_matches(text, {q.quoted('(?is)' + p)}) THEN {q.quoted(n)}" for n, p in triage.BOILERPLATE) + " END"
_BARE_WORD = r"regexp_replace(lower(w), '^[.,;:()\[\]’''\"]+|[.,;:()\[\]’''\"]+$', '', 'g')"
_PROSE = f"({q.word_count('text')} < 8 OR len(list_filter({q.words('text')}, lambda w: {_BARE_WORD} IN {q.values(triage.FUNCTION_WORDS)})) > 0)"
_MATHS = "(length(text) - length(replace(text, 'inline-eq', ''))) / 9 > 2"
_SHORT = rf"({q.word_count('text')} < 4 AND NOT regexp_matches(rtrim({q.spaced('text')}), '[.!?]$'))"
_JUDGED = f"""judged AS (SELECT doc_id, ord, text, {q.word_count('text')}::BIGINT AS n_words, {_REASON} AS boiler, {_PROSE} AS prose, {_MATHS} AS maths, {_SHORT} AS short FROM lines),
decided AS (SELECT *, CASE WHEN boiler IS NOT NULL THEN 'drop' WHEN NOT prose THEN 'drop' WHEN maths THEN 'transform' WHEN short THEN 'drop' ELSE 'keep' END AS action,
 CASE WHEN boiler IS NOT NULL THEN boiler WHEN NOT prose THEN 'no function words: a table, an axis, a contents page or front matter'
  WHEN maths THEN 'prose depends on inline mathematics that the text layer does not hold' WHEN short THEN 'fragment, too short to be a sentence' ELSE 'carries the argument' END AS reason FROM judged)"""


@query(f"""WITH {q.LINES}, {_JUDGED}
SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (action = 'keep') AS n_keep, 0::BIGINT AS n_compress, count(*) FILTER (action = 'transform') AS n_transform, count(*) FILTER (action = 'drop') AS n_drop,
 sum(n_words)::BIGINT AS words_total, sum(CASE WHEN action <> 'drop' THEN n_words ELSE 0 END)::BIGINT AS words_kept,
 CASE WHEN sum(n_words) = 0 THEN 0 ELSE (100 * sum(CASE WHEN action <> 'drop' THEN n_words ELSE 0 END)) // sum(n_words) END::BIGINT AS retained_pct,
 round(sum(CASE WHEN action <> 'drop' THEN n_words ELSE 0 END) * 60.0::DOUBLE / 155, 6) AS est_seconds
FROM decided GROUP BY doc_id""")
def triage_summary(spark: SparkSession, d: str) -> DataFrame:
    """What survives triage in every document, and how long a straight read is."""
    return triage.summary(triage.triage(lines(spark, d)))


@query(f"""WITH {q.LINES}, {_JUDGED}
SELECT 'COH-01' AS rule, reason, count(*) AS n_blocks, sum(n_words)::BIGINT AS n_words, arg_min(substr(text, 1, 160), doc_id * 1000000 + ord) AS example FROM decided WHERE action = 'drop' GROUP BY reason""")
def drop_report(spark: SparkSession, d: str) -> DataFrame:
    return triage.drop_report(triage.triage(lines(spark, d)))


@query(f"WITH {q.LINES} SELECT doc_id, ord::INT AS ord, reason FROM (SELECT doc_id, ord, {_REASON} AS reason FROM lines) WHERE reason IS NOT NULL")
def boilerplate_reason(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "ord", triage.boilerplate_reason().alias("reason")).filter("reason IS NOT NULL")


@query(f"WITH {q.LINES} SELECT doc_id, count(*) FILTER ({_PROSE}) AS n_prose, count(*) AS n_blocks FROM lines GROUP BY doc_id")
def function_word_prose(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("doc_id").agg(F.count_if(triage.reads_as_prose()).alias("n_prose"), F.count("*").alias("n_blocks"))


@query(f"""WITH {q.LINES} SELECT doc_id, ord::INT AS ord, 'b_' || substr(sha256(concat_ws(chr(31), 'paragraph', '', ord::VARCHAR, substr(text, 1, 400))), 1, 12) AS block_id, {q.word_count('text')}::INT AS n_words, length(text)::INT AS n_chars FROM lines""")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "ord", block_id(F.col("kind"), F.col("page"), F.col("ord"), F.col("text")).alias("block_id"), text.word_count("text").alias("n_words"), F.length("text").alias("n_chars"))


_CTRL, _MARK = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]", clean.MATH_MARKER


@query(f"""WITH {q.LINES}, c AS (SELECT doc_id, len(regexp_extract_all(text, '{_CTRL}')) AS nc, len(regexp_extract_all(text, '{_MARK}')) AS nm, text,
 trim(regexp_replace(regexp_replace(regexp_replace(text, '{_CTRL}', ' ', 'g'), '{_MARK}', 'inline-eq', 'g'), '[ \\t]{{2,}}', ' ', 'g')) AS tidy FROM lines)
SELECT doc_id, sum(nc)::BIGINT AS n_controls, sum(nm)::BIGINT AS n_markers, sum(length(CASE WHEN nc + nm > 0 THEN tidy ELSE text END))::BIGINT AS n_chars FROM c GROUP BY doc_id""")
def control_char_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.strip_control(lines(spark, d)).groupBy("doc_id").agg(F.sum("n_controls").cast("long").alias("n_controls"), F.sum("n_markers").cast("long").alias("n_markers"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {q.LINES}, e AS (SELECT doc_id, sum(len(regexp_extract_all(text, {q.quoted(clean.MATH_FONT_EVIDENCE)})))::BIGINT AS evidence FROM lines GROUP BY doc_id)
SELECT doc_id, evidence >= 3 AS broken_font, count(*) AS n_blocks, sum(length(CASE WHEN evidence >= 3 THEN replace(replace(replace(replace(replace(text, '¼', ' = '), 'þ', '+'), 'ð', '('), 'Þ', ')'), 'Ð', '(') ELSE text END))::BIGINT AS n_chars
FROM lines JOIN e USING (doc_id) GROUP BY doc_id, evidence""")
def math_font_gate(spark: SparkSession, d: str) -> DataFrame:
    return clean.repair_math_font(lines(spark, d)).groupBy("doc_id", "broken_font").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH n AS (SELECT l_suppkey AS doc_id, l_orderkey AS o, l_linenumber AS v, count(*) OVER (PARTITION BY l_suppkey) * 3 AS total_lines, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS step FROM lineitem),
s AS (SELECT doc_id, count(*) AS n, max(total_lines) AS lines, count(DISTINCT v) AS distinct_n, max(v) - min(v) + 1 AS span, count(*) FILTER (step > 0) AS rising, quantile_cont(step, 0.5) FILTER (step > 0) AS median_step FROM n GROUP BY doc_id)
SELECT *, coalesce(n >= 20 AND n >= 0.10 * lines AND distinct_n >= 0.5 * span AND rising >= 0.70 * (n - 1) AND median_step <= 5, false) AS numbered FROM s""")
def line_number_gate(spark: SparkSession, d: str) -> DataFrame:
    """The line-number tests on the line numbers of every supplier's orders (a synthetic sequence)."""
    items = table(spark, d, "lineitem")
    from pyspark.sql import Window

    rows = items.select(F.col("l_suppkey").alias("doc_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"), F.col("l_linenumber").alias("v"), (F.count("*").over(Window.partitionBy("l_suppkey")) * 3).alias("total_lines"))
    return clean.line_number_stats(rows)


_SIG = r"substr(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace(text, '^\s*[A-Za-z0-9]\s*$', '', 'g'), chr(10), ' ', 'g')), '^[A-Za-z0-9]\s+|\s+[A-Za-z0-9]$', '', 'g')), '[0-9]+', '#', 'g'), '\s+', '', 'g'), 1, 120)"


@query(f"""WITH {q.LINES}, s AS (SELECT source, doc_id, {_SIG} AS sig FROM lines JOIN documents USING (doc_id) WHERE length(lines.text) <= 200),
p AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM documents GROUP BY source)
SELECT source, sig, count(DISTINCT doc_id) AS pages, n_pages FROM s JOIN p USING (source) WHERE sig <> '' GROUP BY source, sig, n_pages HAVING count(DISTINCT doc_id) >= greatest(2, ceil(0.05 * n_pages))""".replace("lines JOIN documents USING (doc_id)", "lines JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"))
def page_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Signatures that come back in many documents of a source, as running heads do on pages."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    rows = lines(spark, d).filter(F.length("text") <= 200).select("doc_id", text.signature("text").alias("sig")).filter("sig <> ''").join(docs, "doc_id")
    pages = docs.groupBy("source").agg(F.count_distinct("doc_id").alias("n_pages"))
    return rows.groupBy("source", "sig").agg(F.count_distinct("doc_id").alias("pages")).join(pages, "source").filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(0.05 * F.col("n_pages"))))


_OPEN = r"(regexp_matches(rtrim(prev), '[-,(\[]\s*$') OR regexp_matches(rtrim(prev), '(?i)\b(?:e\.g|i\.e|cf|vs|et al|Fig|Eq|Ref|approx|ca)\.\s*$'))"
_ENDS = r"regexp_matches(rtrim(prev), '[.!?:;][''\")\]]?\s*$')"


@query(f"""WITH {q.LINES}, p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM lines),
j AS (SELECT *, coalesce({_OPEN} OR (NOT {_ENDS} AND regexp_matches(ltrim(text), '^[a-z(\\[]')), false) AS joins FROM p)
SELECT doc_id, count(*) FILTER (NOT joins) AS n_merged, count(*) AS n_blocks, coalesce(max(run), 1)::INT AS longest FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS run FROM (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM j)) GROUP BY doc_id""")
def merge_islands(spark: SparkSession, d: str) -> DataFrame:
    return clean.merge_continuations(lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_merged"), F.sum("merged_from").cast("long").alias("n_blocks"), F.max("merged_from").alias("longest"))


@query()
def back_matter_cut(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs cut where rights notices or back matter start (a fourth of the lines is glued to get some)."""
    glued = table(spark, d, "documents").select("doc_id", F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.concat("text", F.lit(" All rights reserved by the owner.")).alias("text"))
    return clean.split_back_matter(glued).groupBy("doc_id").agg(F.count("*").alias("parts"), F.min(F.length("text")).alias("shortest"))


@query()
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """All cleaning passes over the corpus: blocks and words by kind and role."""
    done = clean.clean(lines(spark, d))
    return done.groupBy("kind", "role").agg(F.count("*").alias("blocks"), F.sum(text.word_count("text")).cast("long").alias("n_words"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return adapters.html_blocks(pages).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("n_chars"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)<(h[1-6]|p|li)\b[^>]*>([^<]+)', 1) AS tags, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)<(h[1-6]|p|li)\b[^>]*>([^<]+)', 2) AS texts FROM pages),
b AS (SELECT page_id, unnest(tags) AS tag, unnest(texts) AS text, generate_subscripts(tags, 1) AS ord FROM h),
s AS (SELECT *, last_value(CASE WHEN lower(tag) LIKE 'h%' THEN ord END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b)
SELECT page_id, section::INT AS section, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY page_id, section""")
def section_assign(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every page under the heading that governs them."""
    from pyspark.sql import Window

    tidy = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    pattern = F.lit(r"(?i)<(h[1-6]|p|li)\b[^>]*>([^<]+)")
    pairs = F.arrays_zip(F.regexp_extract_all("t", pattern, 1).alias("tag"), F.regexp_extract_all("t", pattern, 2).alias("text"))
    rows = table(spark, d, "pages").select("page_id", tidy.alias("t")).select("page_id", F.posexplode(pairs).alias("k", "b")).select("page_id", (F.col("k") + 1).alias("ord"), "b.tag", "b.text")
    section = F.last(F.when(F.lower("tag").startswith("h"), F.col("ord")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("ord"))
    return rows.withColumn("section", section).groupBy("page_id", "section").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {q.LINES}, {q.SENTENCES} SELECT doc_id, count(*) AS n_sentences, max({q.word_count('text')})::INT AS longest, count(*) FILTER ({q.word_count('text')} > 35) AS over_long, sum(length(text))::BIGINT AS n_chars FROM sents GROUP BY doc_id""")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    n = text.word_count("text")
    return sentences(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(n).alias("longest"), F.count_if(n > 35).alias("over_long"), F.sum(F.length("text")).alias("n_chars"))


@query()
def guarded_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with the abbreviation guards, as offsets."""
    return clean.split_sentences(lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"))


_IDS = "text"
for _p in spoken.IDENTIFIERS:
    _IDS = f"regexp_replace({_IDS}, {q.quoted(_p)}, '', 'g')"


@query(f"SELECT doc_id, length({_IDS})::INT AS n_chars, md5({_IDS}) AS digest FROM documents WHERE regexp_matches(text, '@|://|www[.]|10[.][0-9]')")
def strip_identifiers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").rlike("@|://|www[.]|10[.][0-9]"))
    return docs.select("doc_id", spoken.strip_identifiers(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


_PARENS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s*\(\s*([A-Z][A-Za-z0-9]{0,9}s?)\s*\)', ', or \1,', 'g'), '\s*\(\s*([^()\s]+(?:\s+[^()\s]+){0,7})\s*\)', ', \1,', 'g'), '\s*\([^()]{1,300}\)', '', 'g'), ',\s*([.,;:!?])', '\1', 'g'), '\s{2,}', ' ', 'g'))"


@query(f"WITH a AS (SELECT conv_id, turn, replace(text, ' the ', ' (THE) and (the one) ') AS t FROM conversations) SELECT conv_id, turn, length({_PARENS})::INT AS n_chars, md5({_PARENS}) AS digest FROM a")
def parens_rewrite(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", spoken.aside_expr(F.replace("text", F.lit(" the "), F.lit(" (THE) and (the one) "))).alias("t"))
    return rows.select("conv_id", "turn", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"""SELECT part.p_partkey, regexp_replace(regexp_replace(p_brand || '_' || p_size || ' x^2', '\b([A-Za-z][A-Za-z]{0,3})_\{?([A-Za-z0-9]{1,6})\}?', '\1 sub \2', 'g'), '\b([A-Za-z][A-Za-z]{0,3})\^\{?([A-Za-z0-9]{1,6})\}?', '\1 to the power \2', 'g') AS said FROM part""")
def indices_rewrite(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return parts.select("p_partkey", spoken.indices_expr(F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string"), F.lit(" x^2"))).alias("said"))


def _number_sql(x: str) -> str:
    small = "[" + ", ".join(map(q.quoted, spoken.SMALL)) + "]"
    tens = "[" + ", ".join(map(q.quoted, ["", "", *spoken.TENS])) + "]"
    below = lambda v: f"(CASE WHEN {v} < 20 THEN {small}[{v} + 1] ELSE {tens}[{v} // 10 + 1] || CASE WHEN {v} % 10 = 0 THEN '' ELSE ' ' || {small}[{v} % 10 + 1] END END)"
    thousand = lambda v: f"(CASE WHEN {v} < 100 THEN {below(v)} ELSE {small}[{v} // 100 + 1] || ' hundred' || CASE WHEN {v} % 100 = 0 THEN '' ELSE ' and ' || {below(f'({v} % 100)')} END END)"
    high, low = f"({x} // 1000)", f"({x} % 1000)"
    return f"(CASE WHEN {x} < 1000 THEN {thousand(x)} ELSE {thousand(high)} || ' thousand' || CASE WHEN {low} = 0 THEN '' WHEN {low} < 100 THEN ' and ' || {thousand(low)} ELSE ' ' || {thousand(low)} END END)"


@query(f"SELECT DISTINCT n, {_number_sql('n')} AS said FROM (SELECT p_size::INT AS n FROM part UNION ALL SELECT (o_orderkey % 1000000)::INT FROM orders)")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_size").cast("int").alias("n")).unionByName(table(spark, d, "orders").select((F.col("o_orderkey") % 1000000).cast("int").alias("n"))).distinct()
    return n.select("n", spoken.small_number_words(F.col("n")).alias("said"))


@query()
def unit_words(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([(u,) for u in ["mAh", "kWh", "cm2", "cm-1", "mA/cm2", "mAhg-1", "°C", "m/s", "C", "cells", "µm", "wt%"]], "unit string")
    return units.select("unit", spoken.spoken_unit_of(F.col("unit")).alias("said"))


@query()
def verbalize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document in speakable text; superscript citations only where the document shows the style."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id").withColumn("raised", F.coalesce(spoken.raised_count(F.when(F.col("text").rlike("[0-9]"), F.col("text"))), F.lit(0)) >= 10)
    said = docs.select("doc_id", spoken.speaker()(F.col("text"), F.col("raised")).alias("said"))
    return said.select("doc_id", F.length("said").alias("n_chars"), text.word_count("said").alias("n_words"), F.round(text.seconds_for("said"), 3).alias("seconds"))


_LINT_TEXT = "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _counted_sql(rule: str, patterns: list[tuple[str, str]], severity: str = "error") -> str:
    one = " UNION ALL ".join(f"SELECT doc_id, {q.quoted(rule)} AS rule, {q.quoted(label)} AS message, regexp_extract(text, {q.quoted(p)}) AS excerpt, {q.quoted(severity)} AS severity, len(regexp_extract_all(text, {q.quoted(p)}))::BIGINT AS n {_LINT_TEXT}" for p, label in patterns)
    return f"SELECT * FROM ({one}) WHERE n > 0"


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(rf"SELECT doc_id, 'TTS-01' AS rule, 'unspeakable character' AS message, excerpt, 'error' AS severity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q.quoted(lint_text.UNSPEAKABLE)})) AS excerpt {_LINT_TEXT}) GROUP BY doc_id, excerpt")
def lint_text_tts_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.tts_01(texts(spark, d))


@query(_counted_sql("NUM-02", [(r"[0-9]+(?:[.,][0-9]+)*", "unverbalized number")]))
def lint_text_num_02(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.num_02(texts(spark, d))


@query(_counted_sql("CIT-01", lint_text.CITATIONS))
def lint_text_cit_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.cit_01(texts(spark, d))


@query(_counted_sql("SENT-03", [(r"[()\[\]{}]", "parenthetical")]))
def lint_text_sent_03(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.sent_03(texts(spark, d))


@query(_counted_sql("SENT-04", lint_text.WRITTEN_ONLY))
def lint_text_sent_04(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.sent_04(texts(spark, d))


@query(_counted_sql("STR-08", lint_text.DANGLING))
def lint_text_str_08(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.str_08(texts(spark, d))


@query(f"WITH s AS (SELECT doc_id, list_filter({q.sentences('text')}, lambda x: {q.word_count('x')} > 35) AS long {_LINT_TEXT}) SELECT doc_id, 'SENT-01' AS rule, 'sentence over the word cap' AS message, substr(long[1], 1, 80) AS excerpt, 'warning' AS severity, len(long)::BIGINT AS n FROM s WHERE len(long) > 0")
def lint_text_sent_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.sent_01(texts(spark, d))


@query()
def lint_text_sym_02(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.sym_02(texts(spark, d))


@query()
def lint_text_summary(spark: SparkSession, d: str) -> DataFrame:
    return lint_text.summary(lint_text.lint(texts(spark, d)))


_LEAN = rf"CASE WHEN NOT regexp_matches(trim(text), {q.quoted(spoken.EXPLETIVE)}) AND (regexp_matches(trim(text), {q.quoted(spoken.BARE_OPENING)}) OR regexp_matches(trim(text), {q.quoted(spoken.FORMER)})) THEN lower(regexp_extract(trim(text), '^(\S+)', 1)) END"


@query(f"WITH {q.LINES}, {q.SENTENCES} SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {_LEAN} AS word FROM sents) WHERE word IS NOT NULL GROUP BY doc_id, word")
def unresolved_openings(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences(spark, d).select("doc_id", spoken.unresolved_opening(F.col("text")).alias("word")).filter("word IS NOT NULL")
    return rows.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


_NUM = r"list_distinct(list_transform(list_transform(regexp_extract_all(coalesce({t}, ''), '[0-9][0-9.,·]*'), lambda x: regexp_replace(x, '[.,]+$', '')), lambda x: {c}))"
_POINT = r"replace(CASE WHEN contains(replace(x, '·', '.'), ',') AND NOT contains(replace(x, '·', '.'), '.') AND length(regexp_extract(replace(x, '·', '.'), ',(\d*)$', 1)) <> 3 THEN regexp_replace(replace(x, '·', '.'), ',(\d*)$', '.\1') ELSE replace(x, '·', '.') END, ',', '')"
_SHORT_N = rf"regexp_replace(CASE WHEN contains({_POINT}, '.') THEN regexp_replace(regexp_replace({_POINT}, '0+$', ''), '\.$', '') ELSE {_POINT} END, '^0+([0-9])', '\1')"
_CANON = f"CASE WHEN {_SHORT_N} = '' THEN '0' WHEN starts_with({_SHORT_N}, '.') THEN '0' || {_SHORT_N} ELSE {_SHORT_N} END"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS source FROM conversations),
n AS (SELECT conv_id, turn, {_NUM.format(t='text', c=_CANON)} AS g, {_NUM.format(t='source', c=_CANON)} AS s FROM t WHERE role = 'assistant')
SELECT conv_id, turn, unnest(list_filter(g, lambda v: NOT list_contains(s, v))) AS value FROM n""")
def grounding_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in an assistant's turn that the turn before it does not hold."""
    rows = _turns(spark, d)
    return grounding.findings(rows, kinds=("number",)).select("conv_id", "turn", "value")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").withColumn("source", before).filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("generated"), "source")


_PAIRS = ", ".join(f"('{a}', '{b}')" for p in grounding.DIRECTIONS for a, b in (p, p[::-1]))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS source FROM conversations),
p(used, opposite) AS (VALUES {_PAIRS}), w AS (SELECT conv_id, turn, regexp_extract_all(lower(text || ' more'), '[a-z][a-z0-9_''-]*') AS g, regexp_extract_all(lower(coalesce(source, '') || CASE WHEN turn % 2 = 1 THEN ' less' ELSE ' more' END), '[a-z][a-z0-9_''-]*') AS s FROM t WHERE role = 'assistant')
SELECT conv_id, turn, used AS value FROM w, p WHERE list_contains(g, used) AND NOT list_contains(s, used) AND list_contains(s, opposite)""")
def grounding_directions(spark: SparkSession, d: str) -> DataFrame:
    """Flipped directions between an assistant's turn and the one before; both get a word so that some flip."""
    rows = _turns(spark, d).withColumn("generated", F.concat("generated", F.lit(" more"))).withColumn("source", F.concat(F.coalesce("source", F.lit("")), F.when(F.col("turn") % 2 == 1, F.lit(" less")).otherwise(F.lit(" more"))))
    return grounding.findings(rows, kinds=("direction",)).select("conv_id", "turn", "value")


@query()
def grounding_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return grounding.verdicts(_turns(spark, d), ["conv_id", "turn"]).groupBy("verified").agg(F.count("*").alias("n"))


@query()
def split_verification(spark: SparkSession, d: str) -> DataFrame:
    """Line breaks put at sentence ends as if they were rewrites; why each would be refused."""
    rows = sentences(spark, d).select("doc_id", "text", F.regexp_replace("text", ", ", ". ").alias("split")).filter("text <> split")
    return rows.select("doc_id", F.explode_outer(grounding.verify_split(F.col("text"), F.col("split"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_orderkey AS doc_id, l_suppkey AS page, l_quantity AS size, count(*) AS chars FROM lineitem GROUP BY ALL)
SELECT doc_id, arg_max(size, w * 1000000 + size) AS mode FROM (SELECT doc_id, size, sum(chars) AS w FROM f GROUP BY doc_id, size) GROUP BY doc_id""")
def weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    """The weighted mode with its tie-break, on order quantities (a primitive check)."""
    spans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_suppkey", F.col("l_quantity").alias("size")).agg(F.count("*").alias("chars"))
    return layout.weighted_mode(spans, ["doc_id"])


@query("SELECT o_custkey AS doc_id, quantile_cont(o_totalprice, 0.5) AS body_font_size FROM orders GROUP BY o_custkey")
def median_size(spark: SparkSession, d: str) -> DataFrame:
    """The median that gives a body font size, on order prices (a primitive check)."""
    return layout.body_font_size(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_totalprice").alias("font_mode")))


@query(r"""SELECT s_suppkey, list_filter(list_transform(string_split_regex(s_name || '; ' || s_suppkey || ' and Ann & Bo', '\s*(?:[;,]|\band\b|&)\s*'), lambda a: trim(a)), lambda a: a <> '') AS authors FROM supplier""")
def author_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", layout.split_authors(F.concat("s_name", F.lit("; "), F.col("s_suppkey").cast("string"), F.lit(" and Ann & Bo"))).alias("authors"))


@query(f"WITH {q.LINES} SELECT doc_id, substr(arg_min(text, ord), 1, 120) AS title FROM lines GROUP BY doc_id")
def titles(spark: SparkSession, d: str) -> DataFrame:
    return adapters.titles(lines(spark, d))
