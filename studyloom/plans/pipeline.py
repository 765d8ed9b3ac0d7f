"""The whole way from documents to programmes: blocks, triage, concepts, plans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.config import Listener, Profile
from studyloom.functions.text import word_count
from studyloom.operators import clean, evaluate, lint_script, triage
from studyloom.plans import document, measured, planner
from studyloom.session import written

_PLACE = "struct<ord:int,char_start:int,char_end:int>"
#: The tables of a build, as arrays of a document's row.
PARTS = {
    "sentences": "array<struct<section_id:string,section_title:string,ord:int,sent_ix:int,char_start:int,char_end:int,text:string,concept_ids:array<string>>>",
    "concepts": f"array<struct<concept_id:string,canonical:string,difficulty:double,importance:double,budget:double,signals:map<string,double>,short_def:string,def_at:{_PLACE},first_ord:int>>",
    "supports": "array<struct<concept_id:string,rank:int,ord:int,sent_ix:int,text:string,score:double,definitional:boolean,causal:boolean,char_start:int,char_end:int>>",
    "beats": planner.as_array(planner.PLAN_BEATS),
    "cards": planner.as_array(planner.PLAN_CARDS),
}
#: Blocks whose sentences are laid out, of those that triage retains.
SPOKEN = "role <> 'title' AND kind <> 'heading'"
#: Documents in one Arrow batch of results.
RESULT_ROWS = 64


@dataclass
class Build:
    """Tables of one build; those that were not asked for are missing."""

    blocks: DataFrame
    sentences: DataFrame | None = None
    concepts: DataFrame | None = None
    supports: DataFrame | None = None
    beats: DataFrame | None = None
    cards: DataFrame | None = None


def build(blocks: DataFrame, profile: Profile | None = None, listener: Listener | None = None, cleaned: bool = False, only: tuple[str, ...] = tuple(PARTS), keep: bool = True) -> Build:
    """Programmes for every document of ``blocks`` (as the sources return them).

    A document's sentences are gathered once and go from concepts to the plan in one row; a concept without a
    definition of its own takes the first that its document states.  The tables in ``only`` are made and, with
    ``keep``, written down once for all that read them; a caller that reads one table once needs no ``keep``.
    """
    judged = judge(blocks, cleaned)
    kept = triage.retained(judged).filter(SPOKEN)
    rows, fields = by_document(judged, document.described(clean.split_sentences(kept, "section")))
    plans = laid_out(rows, fields, only, profile or Profile(), listener or Listener())
    plans = written(plans) if keep else plans
    return Build(judged, **{name: plans.select(*(() if name in ("beats", "cards") else ("doc_id",)), F.explode(name).alias("x")).select(*(() if name in ("beats", "cards") else ("doc_id",)), "x.*") for name in only})


def metrics(blocks: DataFrame, profile: Profile | None = None, listener: Listener | None = None, cleaned: bool = False) -> DataFrame:
    """The metrics of every document's build (``operators.evaluate.measure`` with the rules that need beats and cards).

    A document's beats are measured where they are laid out and no table of them is made; its words are counted as its
    sentences are gathered, so that its blocks are judged once.
    """
    judged = judge(blocks, cleaned)
    words = judged.withColumns({"kept": F.coalesce(triage.is_retained(), F.lit(False)), "n_words": word_count("text")})
    said = document.described(clean.split_sentences(words, "section", "kept", "n_words", only=F.col("kept") & F.expr(SPOKEN)))
    first = F.coalesce("sent_ix", F.lit(0)) == 0
    rows, fields = by_document(judged, said, all_words=F.sum(F.when(first, F.col("n_words"))), kept_words=F.sum(F.when(first & F.col("kept"), F.col("n_words"))))
    return evaluate.shown(measured_rows(rows.filter("size(said) > 0"), fields, profile or Profile(), listener or Listener()).withColumn("values_raw", F.lit(1.0)), len(lint_script.SCRIPT_RULES) - len(measured.SKIPPED), len(measured.SKIPPED))


def judge(blocks: DataFrame, cleaned: bool) -> DataFrame:
    judged = triage.triage(blocks if cleaned else clean.clean(blocks))
    return judged if "section" in judged.columns else judged.withColumn("section", F.lit(None).cast("int"))


def by_document(judged: DataFrame, said: DataFrame, **sums: Column) -> tuple[DataFrame, list[str]]:
    """(a row a document: doc_id, its sentences ``said``, ``sums``, heads and title; the sentences' fields)."""
    heads = judged.filter("kind = 'heading'").groupBy("doc_id").agg(F.collect_list(F.struct("ord", "text")).alias("heads"))
    titles = judged.filter("role = 'title'").groupBy("doc_id").agg(F.min_by("text", "ord").alias("title"))
    fields = [c for c in said.columns if c not in ("doc_id", "kept", "n_words")]
    sentence = F.struct(*fields)
    gather = [F.collect_list(F.when(F.col("sent_ix").isNotNull(), sentence) if sums else sentence).alias("said"), *(v.alias(k) for k, v in sums.items())]
    return said.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*gather).join(heads, "doc_id", "left").join(titles, "doc_id", "left"), fields


def facts(batch: pa.RecordBatch, fields: list[str], listener: Listener) -> Iterator[tuple[int, int, str, dict[str, list]]]:
    """(place in the batch, document, title, sentences, concepts and supports) of rows (doc_id, said, heads, title)."""
    docs, said, heads, titles = (batch.column(c) for c in ("doc_id", "said", "heads", "title"))
    for k in range(batch.num_rows):
        values = said[k].values
        sentences = [dict(zip(fields, v, strict=True)) for v in zip(*(values.field(i).to_pylist() for i in range(len(fields))), strict=True)]
        headings = {h["ord"]: h["text"] for h in heads[k].as_py() or ()}
        yield k, docs[k].as_py(), titles[k].as_py() or "", dict(zip(("sentences", "concepts", "supports"), document.facts_of(sentences, headings, listener), strict=True))


def plan_of(title: str, tables: dict[str, list], profile: Profile, listener: Listener) -> planner.Plan:
    return planner.Plan(profile, title, tables["sentences"], tables["concepts"], tables["supports"], listener.lexicon)


def laid_out(rows: DataFrame, fields: list[str], only: tuple[str, ...], profile: Profile, listener: Listener) -> DataFrame:
    """(doc_id, the tables in ``only``) of rows (doc_id, said, heads, title): a document at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(["doc_id bigint", *(f"{name} {PARTS[name]}" for name in only)])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, doc, title, tables in facts(batch, fields, listener):
                if "beats" in only or "cards" in only:
                    plan = plan_of(title, tables, profile, listener)
                    tables |= {"beats": plan.rows(doc) if "beats" in only else [], "cards": plan.card_rows(doc)}
                out.append((doc, *(tables[name] for name in only)))
                if len(out) == RESULT_ROWS:
                    yield gathered(out, schema)
                    out = []
            if out:
                yield gathered(out, schema)

    return rows.mapInArrow(run, ddl)


def measured_rows(rows: DataFrame, fields: list[str], profile: Profile, listener: Listener) -> DataFrame:
    """(doc_id, all_words, kept_words, the measures) of rows (doc_id, said, heads, title, all_words, kept_words): a document at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"doc_id bigint, all_words bigint, kept_words bigint, {measured.MEASURES}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, doc, title, tables in facts(batch, fields, listener):
                plan = plan_of(title, tables, profile, listener)
                found = measured.measures_of(plan.rows(doc), plan.cards, tables["concepts"], profile)
                if found:
                    out.append((doc, batch.column("all_words")[k].as_py(), batch.column("kept_words")[k].as_py(), *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, ddl)


def gathered(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a document's id and its tables (lists of tuples or dicts) as one batch."""
    ids, *tables = zip(*out, strict=True)
    columns = [pa.array(ids, schema.field(0).type)]
    for lists, field in zip(tables, list(schema)[1:], strict=True):
        kind, ends, flat = field.type.value_type, [0], []
        for rows in lists:
            flat += rows
            ends.append(len(flat))
        take = (lambda r, i, name: r[name]) if flat and isinstance(flat[0], dict) else (lambda r, i, name: r[i])
        cells = [[take(r, i, f.name) for r in flat] for i, f in enumerate(kind)]
        cells = [pa.array([list(v.items()) for v in c] if pa.types.is_map(f.type) else c, f.type) for c, f in zip(cells, kind, strict=True)]
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cells, fields=list(kind)), type=field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)
