"""Benchmark decontamination by templates, in DataFrame operations only.

A text is a sequence of tokens (words and numbers).  Its template replaces numbers, units and names (capitalised words inside a
sentence) by typed placeholders and lower-cases the rest.  Windows of WINDOW template tokens of benchmark items are hash-joined
with those of documents.  Along each alignment of document and item (their difference of positions) the values in the
placeholders must be consistent: where one value of the item stands for several in the document, the commonest (of equally
common ones the item's own) counts, and only windows with another are dropped; windows that are as in the item always count.
An item is found in a document that holds at least COVERAGE of its windows so, or RUN of its tokens in a row, whatever share of
the item they are; with other values than the item's it is a re-parameterised copy.

Null and empty texts have no tokens; items of fewer than WINDOW tokens have one shorter window, compared with windows of that
length; rows equal in id and text give equal results; several items may be found in one document; extra columns are ignored
(and kept, whatever their names, by ``keep_clean``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import small, stored

WINDOW, COVERAGE, RUN = 8, 0.3, 13
NO_ID = -(1 << 63)
#: Words that count as units.
UNITS = (
    "km", "cm", "mm", "kg", "mg", "lb", "lbs", "oz", "ft", "kilometers", "kilometres", "meters", "metres", "miles", "feet", "inches",
    "kilograms", "grams", "pounds", "ounces", "liters", "litres", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months",
    "years", "dollars", "cents", "euros", "percent", "degrees", "watts", "volts", "joules",
)
_MARK = "\ue002"
_TOKEN = f"{_MARK}?\\p{{L}}+|[0-9]+(?:[.,][0-9]+)*"


def tokens(text: Column) -> Column:
    """Words and numbers in turn; a name has a mark before it."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[\\p{Ll},;] )(?=\\p{Lu}\\p{Ll})", _MARK)
    return F.regexp_extract_all(marked, F.lit(_TOKEN), 0)


def _placeholder(token: Column) -> Column:
    units = F.lower(token).isin(*UNITS)
    return F.when(token < ":", F.lit("<number>")).when(token.startswith(_MARK), F.lit("<name>")).when(units, F.lit("<unit>")).otherwise(F.lower(token))


def template(own: Column) -> Column:
    return F.transform(own, _placeholder)


def _windows(templated: Column, width: Column) -> Column:
    """Hashes of all windows of the width, in order; none for fewer tokens."""

    def hashed(t: Column) -> Column:
        return F.when(F.size(t) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(t, i, width)))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(templated), hashed), 0)


def _all_windows(templated: Column, widths: list[int]) -> Column:
    """array<struct<width, place, hash>> of all windows of all these widths; the template is made once."""

    def of_width(t: Column, width: Column) -> Column:
        return F.transform(_windows(t, width), lambda h, i: F.struct(width.alias("width"), i.alias("place"), h.alias("hash")))

    return F.get(F.transform(F.array(templated), lambda t: F.concat(*(of_width(t, F.lit(w)) for w in widths))), 0)


def _in_run(own: Column, near: Column, at: Column, lead: Column) -> Column:
    """Whether a window that begins at these places (of the item, and of the document's tokens near it) lies in RUN tokens that
    are equal but for case."""
    plain = lambda tokens, start: F.transform(F.slice(tokens, start + 1, RUN), lambda t: F.lower(F.ltrim(t, F.lit(_MARK))))

    def equal(back: Column) -> Column:
        inside = (at >= back) & (lead >= back) & (at - back + RUN <= F.size(own))
        return inside & (plain(own, F.greatest(at - back, F.lit(0))) == plain(near, F.greatest(lead - back, F.lit(0))))

    return F.exists(F.sequence(F.lit(0), F.lit(RUN - WINDOW)), equal)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def matches(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """id, text_hash, item_id, share (of the item's windows) and exact (no value differs in an alignment) of what is found."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("own")).where(F.size("own") > 0).withColumn("width", F.least(F.size("own"), F.lit(WINDOW)))
    items = stored(items.withColumn("total", F.size("own") - F.col("width") + 1), "benchmark-tokens")
    wanted = stored(items.select("item_id", "width", F.posexplode(_windows(template(F.col("own")), F.col("width"))).alias("at", "hash")), "benchmark-windows")
    # At most WINDOW widths: those under it are of items of fewer tokens.
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())
    docs = _keyed(documents)
    if not widths:
        return docs.sparkSession.createDataFrame([], "id bigint, text_hash bigint, item_id bigint, share double, exact boolean")
    windows = docs.select("id", "text_hash", F.inline(_all_windows(template(tokens(F.col("text"))), widths)))
    met = stored(windows.join(small(wanted), ["hash", "width"]).select("id", "text_hash", "place", "item_id", "at", "width").distinct(), "benchmark-matches")
    # A text meets its own places, each once however many items share its window, so a row holds no more than the text itself; then
    # each place goes on alone, with the tokens near it.  The joins are merges at every size, so their shuffles grow in proportion.
    places = met.groupBy("id", "text_hash").agg(F.collect_set("place").alias("places")).hint("merge")
    own = docs.join(places, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("id", "text_hash", "places", tokens(F.col("text")).alias("doc"))

    def cut(place: Column) -> Column:
        lead = F.least(place, F.lit(RUN - WINDOW))
        return F.struct(place.alias("place"), lead.alias("lead"), F.slice("doc", place - lead + 1, F.lit(2 * RUN - WINDOW)).alias("near"))

    near = own.select("id", "text_hash", F.inline(F.transform("places", cut)))
    pairs = stored(met.hint("merge").join(near, ["id", "text_hash", "place"]), "benchmark-near")
    pairs = pairs.join(small(items.select("item_id", "own", "total"), items), "item_id")
    slots = F.filter(
        F.arrays_zip(F.slice("own", F.col("at") + 1, F.col("width")).alias("mine"), F.slice("near", F.col("lead") + 1, F.col("width")).alias("theirs")),
        lambda s: _placeholder(s["mine"]).startswith("<"),
    )
    line = ["id", "text_hash", "item_id", "shift"]
    pairs = pairs.select("id", "text_hash", "item_id", (F.col("place") - F.col("at")).alias("shift"), "total", "at", _in_run(F.col("own"), F.col("near"), F.col("at"), F.col("lead")).alias("run"), slots.alias("slots"))
    filled = pairs.select(*line, "at", F.explode("slots").alias("slot")).select(*line, "at", "slot.mine", "slot.theirs")
    votes = filled.groupBy(*line, "mine", "theirs").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy(*line, "mine").agg(F.max_by("theirs", F.struct("n", F.col("theirs") == F.col("mine"), "theirs")).alias("value"))
    agreed = filled.join(chosen.hint("merge"), [*line, "mine"]).groupBy(*line, "at").agg(F.min(F.col("theirs") == F.col("value")).alias("consistent"), F.min(F.col("theirs") == F.col("mine")).alias("exact"))
    windows = pairs.drop("slots").join(agreed.hint("merge"), [*line, "at"], "left").withColumns({c: F.coalesce(c, F.lit(True)) for c in ("consistent", "exact")})
    kept = F.when(F.col("consistent") | F.col("exact") | F.col("run"), F.col("at"))
    found = windows.groupBy(*line).agg(F.collect_set(kept).alias("kept"), F.min("exact").alias("exact"), F.max("run").alias("run"), F.first("total").alias("total")).where(F.size("kept") > 0)
    out = found.groupBy("id", "text_hash", "item_id").agg((F.size(F.array_distinct(F.flatten(F.collect_list("kept")))) / F.first("total")).alias("share"), F.min("exact").alias("exact"), F.max("run").alias("run"))
    return out.where((F.col("share") >= coverage) | F.col("run")).drop("run")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document: doc_id, n_items, items (sorted ids), best_share, exact (some item as it is)."""
    found = matches(documents, benchmark).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("best_share"), F.max("exact").alias("exact"))
    rows = _keyed(documents).drop("text").join(stored(found, "benchmark-found"), ["id", "text_hash"])
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_items", "items", "best_share", "exact")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with their columns, whatever their names."""
    found = stored(matches(documents, benchmark).select("id", "text_hash").distinct(), "benchmark-found")
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]
    own = documents.select(*key, F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    return own.join(found, ["id", "text_hash"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in documents.columns))
