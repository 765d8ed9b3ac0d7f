"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become sequences of canonical tokens: numbers, units after a number and names (capitalised
words inside a sentence; neighbouring ones are one name) are typed placeholders, every other word is
itself in lower case.  A capitalised word that begins a sentence, line or quote may be a name or not, so
texts and items have a second form in which every capitalised word is a name; each form is matched by
itself, and a pair found in both is reported by the first.  Windows of ``WINDOW`` canonical tokens are
hashed, and the windows of all texts are hash-joined with those of the benchmark.  What matches is
aligned by offset; within an alignment the values that fill the placeholders must be consistent both
ways: each value of the item always stands for the same value in the text, and different ones for
different ones.  Identical values make an exact copy, other consistent ones a re-parameterised question.
A text is contaminated by an item when consistent alignments cover at least ``COVERAGE`` of the item's
windows.

The texts are read once: all forms and window sizes come from one scan.  Windows are generated and
joined inside its stage while the item side, counted in rows and bytes, is small enough to broadcast;
beyond that only (text, place, hash, slots) is shuffled, never a text's arrays.

Defined cases: null and empty texts match nothing; an item with fewer tokens than a window is one
window of its own length; one with fewer than ``MIN_TOKENS`` tokens is too short to be evidence inside
a text and matches texts that consist of its words; item windows with fewer than ``MIN_LITERALS``
literal tokens are not evidence either unless the whole item has no better ones; an item without tokens
matches nothing; rows that share a doc_id (or a null one) count as one document; repeated items count
once, items that share an item_id (or a null one) are one row, that of the best match; texts of any
length give rows in proportion to it; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import materialize, workspace

WINDOW, MIN_TOKENS, MIN_LITERALS, COVERAGE = 8, 5, 4, 0.5
#: Item windows above this count or size are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 200_000_000

# Units of measure and money that may follow a number.
UNITS = "m km cm mm nm mi ft in inch inches mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw j kj v mv a ma k c f mol mmol pa kpa bar mph kmh kph percent dollar dollars cent cents euro euros pound pounds usd eur gbp".split()

#: Mark a name and a unit; join the parts of one number or one name.
NAME, GLUE, UNIT = "\x01", "\x02", "\x03"
NUMBER_HASH, UNIT_HASH, NAME_HASH = -1, -2, -3


#: What stands before a name, by form: inside a sentence, or anywhere.
BEFORE_NAME = (r"(?<=[\p{L}\p{N},;][ ]{1,2})", r"(?<![\p{L}\p{N}])")


def prepared(text: Column) -> Column:
    """What both forms share: no marks in the text itself, decimal numbers as one token."""
    return F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), NAME + GLUE + UNIT, "   "), r"[.,](?<=\d[.,])(?=\d)", GLUE)


def marked(text: Column, form: int = 0) -> Column:
    """Lower-cased text of a prepared one in which names and units carry marks; full names are one token."""
    text = F.regexp_replace(text, r"(?=\p{Lu})" + BEFORE_NAME[form], NAME)
    text = F.lower(F.regexp_replace(text, f" (?={NAME})(?<={NAME}" + r"[\p{L}]{1,40} )", GLUE))
    return F.regexp_replace(text, r"(?<=\d)\s?(?=(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}]))", " " + UNIT)


def tokens(text: Column, form: int = 0) -> Column:
    return F.array_remove(F.split(marked(text, form), f"[^\\p{{L}}\\p{{N}}{NAME}{GLUE}{UNIT}]+"), "")


def canonical(words: Column) -> Column:
    """One 64-bit number per token: its hash, or the number of its placeholder.

    The lambda reads nothing but its own element: the optimizer may inline ``words`` wherever it is named.
    """
    first = F.ascii
    return F.transform(words, lambda w: F.when(first(w) > 57, F.xxhash64(w)).when(first(w) == 1, F.lit(NAME_HASH).cast("long")).when(first(w) == 3, F.lit(UNIT_HASH).cast("long")).when(first(w) >= 48, F.lit(NUMBER_HASH).cast("long")).otherwise(F.xxhash64(w)))


def windows(rows: DataFrame, keep: list[str], sizes: list[tuple[int, int]]) -> DataFrame:
    """One row per window of ``rows`` (keep, text): ``keep``, form, size, its place ``at``, its hash, and the words and tokens it came from.

    Windows below ``MIN_TOKENS`` are whole texts of that length, hashed by their words alone.
    """
    forms = sorted({form for form, _ in sizes})
    words = rows.select(*keep, prepared(F.col("text")).alias("text"))
    words = words.select(*keep, *(tokens(F.col("text"), form).alias(f"w{form}") for form in forms))  # columns of their own: each is worked out once
    words = words.select(*keep, *(F.struct(F.lit(form).alias("form"), F.lit(size).alias("size"), F.col(f"w{form}").alias("w"), canonical(F.col(f"w{form}")).alias("h")).alias(f"f{form}_{size}") for form, size in sizes))
    forms = words.select(*keep, F.explode(F.array(*(f"f{form}_{size}" for form, size in sizes))).alias("f")).select(*keep, "f.*")
    length = F.when((F.col("size") >= MIN_TOKENS) | (F.size("h") == F.col("size")), F.size("h") - F.col("size"))
    out = forms.select(*keep, "form", "size", "w", "h", F.explode(F.when(length >= 0, F.sequence(F.lit(0), length))).alias("at"))
    hashed = None
    for size in sorted({size for _, size in sizes}):
        parts = [F.get("h", F.col("at") + k) if size >= MIN_TOKENS else F.get("w", F.lit(k)) for k in range(size)]
        case = (F.col("size") == size, F.xxhash64(F.lit(size), F.col("form"), *parts))
        hashed = F.when(*case) if hashed is None else hashed.when(*case)
    return out.withColumn("window", hashed)


def slots() -> Column:
    """The words that fill the placeholders of a window, in order."""
    span = F.slice("w", F.col("at") + 1, F.col("size"))
    return F.filter(span, lambda w, k: F.get(F.col("h"), F.col("at") + k).between(-3, -1) & (F.col("size") >= MIN_TOKENS))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, form, size, n_windows, window, item_at, item_slots) of the windows that are evidence; ``item`` is a key of the (id, text) pair."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = materialize(rows.withColumn("item", F.monotonically_increasing_id()))
    every = [(form, size) for form in range(len(BEFORE_NAME)) for size in range(1, WINDOW + 1)]
    length = F.least(F.size("h"), F.lit(WINDOW))
    out = windows(rows, ["item", "item_id"], every).filter((F.col("size") == length) & ((F.col("size") >= MIN_TOKENS) | (F.col("form") == 0)))
    out = out.select("item", "item_id", "form", "size", "window", F.col("at").alias("item_at"), slots().alias("item_slots")).withColumn("literals", F.col("size") - F.size("item_slots"))
    best = out.groupBy("item", "form").agg(F.least(F.max("literals"), F.lit(MIN_LITERALS)).alias("floor"))
    out = out.join(best, ["item", "form"]).filter("literals >= floor").drop("literals", "floor")
    return out.join(out.groupBy("item", "form").agg(F.count("*").alias("n_windows")), ["item", "form"])


def matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, item_id, n_windows, item_windows, coverage, n_slots, kind) of every contaminated (text, item) pair."""
    with workspace(df.sparkSession) as finish:
        return finish(find_matches(df, benchmark, text_col, id_col, item_col, item_text_col, coverage))


def find_matches(df: DataFrame, benchmark: DataFrame, text_col: str, id_col: str, item_col: str, item_text_col: str, coverage: float) -> DataFrame:
    items = materialize(item_windows(benchmark, item_col, item_text_col))
    counted = items.groupBy("form", "size").agg(F.count("*").alias("n"), F.sum(F.lit(40) + F.octet_length(F.concat_ws("", "item_slots"))).alias("bytes")).collect()  # at most WINDOW sizes a form
    sizes = sorted((r["form"], r["size"]) for r in counted) or [(0, WINDOW)]
    few = sum(r["n"] for r in counted) <= BROADCAST_ROWS and sum(r["bytes"] for r in counted) <= BROADCAST_BYTES
    texts = windows(df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), ["doc"], sizes)
    if few:  # joined inside the scan's stage, so the slots are cut for matches only
        found = texts.join(F.broadcast(items), ["window", "form", "size"]).withColumn("text_slots", slots())
    else:  # only places, hashes and slots travel
        found = texts.select("doc", "form", "size", "at", "window", slots().alias("text_slots")).join(items, ["window", "form", "size"])
    hits = found.select("doc", "item", "item_id", "form", "n_windows", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), F.arrays_zip(F.col("item_slots").alias("item"), F.col("text_slots").alias("text")).alias("pairs"))
    pairs = F.array_distinct(F.flatten("pairs"))
    aligned = hits.groupBy("doc", "item", "item_id", "form", "n_windows", "offset").agg(F.collect_set("item_at").alias("ats"), F.flatten(F.collect_set("pairs")).alias("pairs")).withColumn("pairs", F.array_distinct("pairs"))
    apart = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    aligned = aligned.filter((apart("item") == F.size("pairs")) & (apart("text") == F.size("pairs")))
    whole = aligned.groupBy("doc", "item", "item_id", "form", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("found"), F.collect_set("pairs").alias("pairs"))
    same = F.forall(pairs, lambda p: p["item"] == p["text"])
    return (
        whole.withColumn("coverage", F.col("found") / F.col("n_windows"))
        .filter(F.col("coverage") >= coverage)
        .groupBy("doc", "item_id")
        .agg(F.min_by(F.struct("found", "n_windows", "coverage", "pairs"), F.struct("form", -F.col("coverage"), "item")).alias("best"))
        .select("doc", "item_id", "best.*")
        .select(F.col("doc").alias(id_col), "item_id", F.col("found").alias("n_windows"), F.col("n_windows").cast("long").alias("item_windows"), "coverage", F.size(pairs).cast("long").alias("n_slots"), F.when(same, "exact").otherwise("reparameterised").alias("kind"))
    )
