"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are lower-case words (runs of characters other than space and 9 to 13), weighted by how often the text has them; a
text without words has the empty word once.  For each of SAMPLES samples and each term, gamma(2, 1) draws r and c and a
uniform draw b come from a hash of term and sample; a term of weight w gets t = floor(ln w / r + b) and the value
c exp(-r (t - b + 1)), and the sample is the (term, t) of the least value.  Two texts agree in a sample with a probability
equal to their generalised Jaccard similarity, so the share of equal samples estimates it.

The value of a term of weight w is exponential with rate w, so the least value of a text of n words exceeds CLOSE / n with a
probability below exp(-CLOSE).  Only values below such a limit are looked at: of most draws a bound without logarithms tells that
they are above it.  A text that has no value below its limit in some sample is drawn again without a limit, so the samples are
always those of all terms.

What a (term, weight) draws is the same in every text.  So the samples of the commonest terms at low weights are drawn once, into
a table of at most 2 * HEAD rows that is broadcast, each in order with the number of its values below each limit; all others are
drawn where they occur, by the same expressions.

Order for "the next document": descending doc_id, null ids last, equal ids by a hash of the text; after the last comes the
first.  Rows equal in id and text share one place and one result, returned once for each.  Null texts count as empty; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import partitions, stored

SAMPLES = 64
#: Terms whose samples are drawn beforehand, at most; the one of rank k at weights up to the square root of HEAD / k.
HEAD = 1 << 15
#: Hex digits of a sample in the fingerprint.
DIGITS = 4
#: Expected number of values below a text's limit, at least; and the limits' number, each half of the one before, the first of which
#: is above every value.
CLOSE, LEVELS = 16, 25
#: Stands for a null id, so that keys are never null.
NO_ID = -(1 << 63)
_KEY, _DIGEST = ("id", "text_hash"), ("digest0", "digest1", "digest2", "digest3")


def following(rows: DataFrame) -> DataFrame:
    """rows (distinct in id, text_hash; small ones) with next_id and next_text_hash in the circular order."""
    order = [F.col("id").desc(), F.col("text_hash")]
    dealt = stored(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    own = Window.partitionBy("part").orderBy(*order)
    pair = F.struct(*_KEY)
    # One row for each part; its first row follows the last row of the part before.
    firsts = dealt.withColumn("n", F.row_number().over(own)).where("n = 1").select("part", pair.alias("first"))
    begin = Window.orderBy("part")
    after = firsts.select(F.col("part").alias("at"), F.coalesce(F.lead("first").over(begin), F.first("first").over(begin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    led = dealt.withColumn("next", F.lead(pair).over(own)).join(F.broadcast(after), F.col("part") == F.col("at"))
    return led.withColumn("next", F.coalesce("next", "after")).select(*rows.columns, F.col("next.id").alias("next_id"), F.col("next.text_hash").alias("next_text_hash"))


def _share(bits: str, at: int, n: int) -> str:
    """A uniform draw from n bits of a long, in SQL."""
    return f"((CAST(shiftrightunsigned({bits}, {at}) & {(1 << n) - 1}L AS DOUBLE) + 0.5D) / {float(1 << n)}D)"


def _hashed(terms: DataFrame, samples: int, unless: str = "false") -> DataFrame:
    """terms with the hashes x0, y0, x1, ... that samples are drawn from, null where `unless` holds: made once, used several times.
    (In SQL, which is built much faster than as many columns are.)"""
    return terms.selectExpr("*", "ln(CAST(weight AS DOUBLE)) AS log_weight", *(f"CASE WHEN NOT ({unless}) THEN xxhash64(term, {seed}) END AS {name}{i}" for i in range(samples) for name, seed in (("x", -1 - i), ("y", i))))


def _sample(i: int) -> str:
    """Sample i of a term and weight as a long, in SQL: the value c exp(-r (t - b + 1)) above, then i, (term, t) below."""
    b, rate, c = _share(f"x{i}", 48, 16), f"(-ln({_share(f'x{i}', 0, 24)} * {_share(f'x{i}', 24, 24)}))", f"-ln({_share(f'y{i}', 0, 32)} * {_share(f'y{i}', 32, 32)})"
    t = f"floor(log_weight / {rate} + {b})"

    def long(exponent: str, term: str) -> str:
        return f"(shiftleft(CAST(least({c} * exp({exponent}), 31.0D) * {float(1 << 34)}D AS BIGINT), 24) | {i << 16}L | ({term} & {(1 << 4 * DIGITS) - 1}L))"

    # b is below 1, so t is 0 at weight 1.
    return f"CASE WHEN weight = 1L THEN {long(f'-{rate} * (0.0D - {b} + 1.0D)', 'term')} ELSE {long(f'-{rate} * ({t} - {b} + 1.0D)', f'(term ^ shiftleft({t}, 4))')} END"


def _near(i: int) -> str:
    """Whether sample i may be below the limit `reach` / weight, in SQL: c is at least 1 - exp(-c), the rest at least exp(-r) / weight."""
    return f"(1.0D - {_share(f'y{i}', 0, 32)} * {_share(f'y{i}', 32, 32)}) * ({_share(f'x{i}', 0, 24)} * {_share(f'x{i}', 24, 24)}) < reach"


def _words(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term and the level of the text's limit (0: none; values are below 2 ** (5 - level)) for each word."""
    split = texts.select(*keys, F.split(F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+").alias("words"))
    level = F.least(F.floor(F.log2(F.size("words") / F.lit(float(CLOSE)))) + 5, F.lit(LEVELS - 1))
    # The level before the words are taken apart, or each word's row would hold all words.
    words = split.select(*keys, F.greatest(level, F.lit(0)).cast("int").alias("level"), "words").select(*keys, "level", F.explode_outer("words").alias("word"))
    return words.select(*keys, "level", F.xxhash64("word").alias("term"))


def common_draws(texts: DataFrame, samples: int = SAMPLES, head: int = HEAD) -> DataFrame:
    """(head_term, head_weight, draws, cuts): all samples of the commonest terms at low weights in order, and how many are below the
    limit of each level, to be broadcast.

    Terms are taken by steps of their counts, so that no task or driver sorts them; a step that would exceed `head` ends it."""
    counts = stored(_words(texts, []).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    most, rank = {}, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("step")).collect():
        rank += r.terms
        if rank > head:
            break
        most[r.step] = int((head / rank) ** 0.5)
    if not most:
        return counts.sparkSession.createDataFrame([], "head_term bigint, head_weight bigint, draws array<bigint>, cuts array<tinyint>")
    upto = reduce(lambda case, x: case.when(step == x[0], x[1]), list(most.items())[1:], F.when(step == next(iter(most)), next(iter(most.values()))))
    terms = counts.where(step >= min(most)).select("term", F.explode(F.sequence(F.lit(1), upto)).alias("weight"))
    terms = terms.select("term", F.col("weight").cast("bigint").alias("weight"))
    drawn = _hashed(terms, samples).selectExpr("term AS head_term", "weight AS head_weight", f"sort_array(array({', '.join(map(_sample, range(samples)))})) AS draws")
    drawn = stored(drawn, "term-draws")
    cuts = ", ".join(f"CAST(size(filter(draws, s -> shiftrightunsigned(s, {63 - level}) = 0L)) AS TINYINT)" for level in range(LEVELS))
    return stored(drawn.selectExpr("*", f"array({cuts}) AS cuts"), "term-cuts")


def _prints(texts: DataFrame, keys: list[str], sides: tuple[str, ...], samples: int, draws: DataFrame, limits: bool) -> DataFrame:
    """keys and a fingerprint for each side, null where a sample has no value below the text's limit."""
    weights = [f"w{k}" for k in range(len(sides))]
    terms = _words(texts, [*keys, "side"]).groupBy(*keys, "term").agg(*(F.count_if(F.col("side") == k).alias(w) for k, w in enumerate(weights)), F.min("level" if limits else F.lit(0)).alias("level"))
    if len(sides) > 1:
        new = (f"CASE WHEN {w} > 0 {''.join(f'AND {w} != {v} ' for v in weights[:k])}THEN {w} ELSE 0L END" for k, w in enumerate(weights))
        terms = terms.selectExpr("*", f"explode_outer(array_remove(array({', '.join(new)}), 0L)) AS weight")
    else:
        terms = terms.withColumn("weight", F.col("w0"))
    terms = terms.join(F.broadcast(draws), (F.col("term") == F.col("head_term")) & (F.col("weight") == F.col("head_weight")), "left")
    terms = terms.selectExpr(*keys, *weights, "term", "weight", "level", "CASE WHEN draws IS NOT NULL THEN slice(draws, 1, CAST(get(cuts, level) AS INT)) END AS drawn", "CAST(weight AS DOUBLE) * pow(2.0D, 5 - level) * 1.000001D AS reach")
    here = f"array_remove(array({', '.join(f'CASE WHEN {_near(i)} THEN {_sample(i)} ELSE -1L END' for i in range(samples))}), -1L)"
    # A column of its own, as what is inside a generator is not compiled; outer, or a filter would be inferred that draws all again.
    drawn = _hashed(terms, samples, "drawn IS NOT NULL").selectExpr(*keys, *weights, "weight", "level", f"CASE WHEN drawn IS NULL THEN {here} ELSE drawn END AS drawn")
    found = drawn.selectExpr(*keys, *weights, "weight", "level", "explode_outer(drawn) AS s").where("shiftrightunsigned(s, 63 - level) = 0L")
    least = found.groupBy(*keys, F.expr("CAST(shiftrightunsigned(s, 16) & 255L AS INT)").alias("sample")).agg(*(F.expr(f"min(CASE WHEN {w} = weight THEN s END) AS {w}") for w in weights))
    low = f"{(1 << 4 * DIGITS) - 1}L"
    each = least.groupBy(*keys).agg(*(F.expr(f"sort_array(collect_list(CASE WHEN {w} IS NOT NULL THEN shiftleft(CAST(sample AS BIGINT), 16) | ({w} & {low}) END)) AS {w}") for w in weights))
    return each.selectExpr(*keys, *(f"CASE WHEN size({w}) = {samples} THEN lower(array_join(transform({w}, s -> lpad(hex(s & {low}), {DIGITS}, '0')), '')) END AS {side}" for w, side in zip(weights, sides, strict=True)))


def fingerprints(texts: DataFrame, keys: list[str], sides: tuple[str, ...] = ("fingerprint",), samples: int = SAMPLES, draws: DataFrame | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keys and a fingerprint for each side: the hex digits of each sample in turn, stored.  texts has text and, if there are several
    sides, the number of its own (side, from 0).  Where texts is dealt out by some of the keys, nothing is dealt out again; a term that
    weighs alike on several sides is drawn once.  draws: those of the common terms, if they were made before; again: gives the texts
    of some keys, if that can be done at less cost than from texts."""
    draws = common_draws(texts, samples) if draws is None else draws
    texts = texts if len(sides) > 1 else texts.withColumn("side", F.lit(0))
    prints = stored(_prints(texts, keys, sides, samples, draws, limits=True), "fingerprints")
    whole = reduce(lambda a, b: a & b, (F.col(side).isNotNull() for side in sides))
    short = prints.where(~whole).select(*keys)
    if short.isEmpty():
        return prints
    if again is None:
        some = short.select(*(F.col(k).alias(f"_{k}") for k in keys))
        rest = texts.join(some, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_semi")
    else:
        rest = again(short)
    return prints.where(whole).unionByName(stored(_prints(rest, keys, sides, samples, draws, limits=False), "fingerprints"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints (columns)."""
    same = (f"CAST(substring({a}, {1 + DIGITS * i}, {DIGITS}) = substring({b}, {1 + DIGITS * i}, {DIGITS}) AS INT)" for i in range(samples))
    return F.expr(f"({' + '.join(same)}) / {float(samples)}D")


def near_edits(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text has its last third (rounded down) replaced by as many first code points of the next document, or all."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    counted = docs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n_chars"))
    order = stored(following(counted), "fingerprint-next")
    before = order.select(F.col("next_id").alias("id"), F.col("next_text_hash").alias("text_hash"), F.col("id").alias("taker"), F.col("text_hash").alias("taker_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("part"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), "beginning")

    def both(docs: DataFrame, before: DataFrame) -> DataFrame:
        # The texts are dealt out once, in more parts than a shuffle's so that a part's terms fit in memory; all below stays there,
        # but for the beginnings that the document before takes over.
        own = docs.repartition(4 * partitions(spark), *_KEY).groupBy(*_KEY).agg(F.first("text").alias("text"))
        given = own.join(before, list(_KEY)).select(F.col("taker").alias("id"), F.col("taker_hash").alias("text_hash"), F.expr("substring(text, 1, part)").alias("beginning"))
        changed = own.join(given, list(_KEY)).select(*_KEY, "text", edited.alias("edited"))
        # The digest goes along as a key of four longs: one pass over the texts makes all.
        hashed = changed.withColumn("sha", F.sha2("edited", 256)).select(*_KEY, "text", "edited", *(F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("bigint").alias(d) for i, d in enumerate(_DIGEST)))
        return hashed.select(*_KEY, *_DIGEST, F.posexplode(F.array("text", "edited")).alias("side", "text"))

    def again(some: DataFrame) -> DataFrame:
        taken = before.join(some.select(F.col("id").alias("taker"), F.col("text_hash").alias("taker_hash")), ["taker", "taker_hash"], "left_semi")
        needed = some.select(*_KEY).union(taken.select(*_KEY)).distinct()
        return both(docs.join(needed, list(_KEY), "left_semi"), taken)

    draws = common_draws(documents.select(F.coalesce("text", F.lit("")).alias("text")))
    prints = fingerprints(both(docs, before), [*_KEY, *_DIGEST], ("fingerprint", "edited_fingerprint"), draws=draws, again=again)
    ends = prints.select(F.col("id").alias("next_id"), F.col("text_hash").alias("next_text_hash"), F.col("fingerprint").alias("next_print"))
    out = prints.join(order, list(_KEY)).join(ends, ["next_id", "next_text_hash"])
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.lower(F.concat(*(F.lpad(F.hex(d), 16, "0") for d in _DIGEST))).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_print").alias("near_next"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
