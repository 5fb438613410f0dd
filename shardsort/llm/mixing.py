"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, -ln(u) over its quality weight, from a hash of its
identifier and text, so reruns agree. Within a source the documents stand in the order of their keys
and their sizes are summed from the front; whole epochs of the source come first, then the documents
from the front until the rest of the token budget is spent. Equal rows are counted before anything
is ordered, and a source is dealt over many buckets of equal probability, whose sums are added up
first, so one source or one document may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardsort.llm.common import durable, salted_join

#: Weights of the sources in code point order, repeating: fixed values.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all sizes, as a fraction.
SHARE = (3, 2)
#: No source is taken more often than this.
MOST_EPOCHS = 2
#: Quality weight of documents whose words are unusually short or long; others weigh 1.
LOW_QUALITY = 0.25
#: Documents that are ordered together in one bucket of a source, on average.
BUCKET_ROWS = 4096
#: Sources whose table may be sent to every task.
BROADCAST_SOURCES = 200_000
#: Equal rows that one row of the result is unfolded to at once.
UNFOLD = 4096
_ORDER = ("draw", "doc_id", "size")
_WORD = r"[^\x20\x09-\x0D]+"


def _key_of(source: str) -> Column:
    """Equal for equal sources, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def sized(df: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    """(doc_id, source, of, size, low, draw) of every row; draw is its exponential key.

    ``of`` stands for the source (never null) and ``low`` says that the quality weight is the low one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.regexp_count(body, F.lit(_WORD)).cast("long")
    plain = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), _key_of(source).alias("of"),
        size.alias("size"), F.length(body).alias("chars"), F.md5(body).alias("digest"), *more,
    )
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    drawn = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double")
    per_word = F.col("chars") / F.greatest("size", F.lit(1))
    low = ~((per_word >= 3) & (per_word <= 12))
    draw = -F.log((drawn + 1.0) / float((1 << 48) + 1)) / F.when(F.col("low"), F.lit(LOW_QUALITY)).otherwise(F.lit(1.0))
    return plain.withColumn("low", low).withColumn("draw", draw).drop("chars", "digest")


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(of, source_size, n_groups, n_low, target) of every source, null last; groups are equal rows and their number.

    The budget is dealt by weight. A source stops at ``most`` times its size; what that leaves goes
    to the others by weight, until none is above. In the order of cap over weight the full sources
    come first, so one pass of running sums over the sources finds the level. The sums run in one
    task over one row (some 100 bytes) for each source.
    """
    totals = groups.groupBy("source", "of").agg(
        F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.count("*").alias("n_groups"), F.count_if("low").alias("n_low")
    )
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    listed = totals.withColumn("number", number).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        listed.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", share[0] * F.sum("source_size").over(everything) - share[1] * F.col("caps"))
        .withColumn("open", F.col("cap").cast("decimal(38,0)") * (share[1] * F.col("others")) >= F.col("left").cast("decimal(38,0)") * F.col("weight"))
        .withColumn("step", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("open"), F.struct("step", "left", "others"))).over(everything)
    return level.withColumn("first", first).select(
        "of", "source_size", "n_groups", "n_low",
        F.when(F.col("first").isNull() | (F.col("step") < F.col("first.step")), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("first.left")).cast("double") / (share[1] * F.col("first.others")).cast("double")).alias("target"),
    )


def _placed(df: DataFrame, doc_id: str, text: str, source: str, bucket_rows: int) -> DataFrame:
    """Groups of equal rows with source_size, target, epochs, what is left after these (rest), and the sizes ahead.

    A bucket's bounds follow from the law of the draws of the source's two quality weights together,
    so each holds about ``bucket_rows`` groups whatever their shares.
    """
    groups = durable(sized(df, doc_id, text, source).groupBy("source", "of", *_ORDER, "low").agg(F.count("*").alias("equal")))
    aims = durable(targets(groups))
    span = F.greatest(F.ceil(F.col("n_groups") / bucket_rows), F.lit(1)).cast("long")
    placed = salted_join(groups, aims, ["of"], "inner", BROADCAST_SOURCES)
    low = F.col("n_low") / F.col("n_groups")
    below = 1 - (1 - low) * F.exp(-F.col("draw")) - low * F.exp(-LOW_QUALITY * F.col("draw"))
    placed = placed.withColumn("bucket", F.least(F.floor(below * span), span - 1).cast("long"))
    sums = placed.groupBy("of", "bucket").agg(F.sum(F.col("size") * F.col("equal")).alias("held"))
    earlier = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("of", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("of", "bucket").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    front = placed.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("equal")).over(inside), F.lit(0))).join(offsets, ["of", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    return front.withColumn("ahead", F.col("ahead") + F.col("offset")).withColumn("epochs", epochs).withColumn("rest", rest)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs, draw,
    taken, copies.

    ``size`` counts runs of characters other than space and \\t-\\r (null text: 0); ``taken`` is
    the number of words the mix takes, repeats counted: epochs times the size, plus what of the
    document fits into the rest of its source's budget. ``copies`` says how often the whole document
    is taken: the last one that fits only partly counts if at least half of it fits. Null sources are
    one source, the last. Equal keys are ordered by doc_id and size (null first); rows equal in all
    of these are interchangeable, and take their turns one by one. Documents of size 0 take nothing
    (copies: epochs). An empty table gives no rows; other columns are not read.
    """
    front = _placed(df, doc_id, text, source, bucket_rows)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("equal") - 1) / UNFOLD))
    unfolded = front.withColumn("block", F.explode(blocks))
    turns = F.sequence(F.lit(0).cast("long"), F.least(F.lit(UNFOLD), F.col("equal") - F.col("block") * UNFOLD) - 1)
    unfolded = unfolded.withColumn("at", F.explode(turns)).withColumn("turn", F.col("block") * UNFOLD + F.col("at"))
    room = F.col("rest") - F.col("ahead") - F.col("turn") * F.col("size")
    part = F.greatest(F.least(room, F.col("size")), F.lit(0))
    return unfolded.withColumn("part", part).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "draw",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        (F.col("epochs") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")).alias("copies"),
    )


def repeat_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mixed corpus: the rows of df with all their columns, each as often as ``copies`` says.

    Where a source's last epoch ends is one place in its order, so every row is decided where it is
    read, from one row per source; texts are not shuffled. Only if it ends among equal rows are these
    numbered, so that exactly as many are taken. Nulls, empty texts, ties and repeated rows count
    as in `mix`; an empty table stays empty.
    """
    front = _placed(df, doc_id, text, source, bucket_rows)
    room = F.greatest(F.col("rest") - F.col("ahead"), F.lit(0))
    whole = F.least(F.floor(room / F.col("size")), F.col("equal"))
    partly = room - F.col("whole") * F.col("size")
    front = front.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0).cast("long"))
    again = F.col("whole") + ((F.col("whole") < F.col("equal")) & (partly > 0) & (2 * partly >= F.col("size"))).cast("long")
    front = front.withColumn("again", F.when(F.col("size") > 0, again).otherwise(0))
    last = F.max(F.when(F.col("again") > 0, F.struct(F.struct(*_ORDER).alias("key"), "again", "equal")))
    cuts = durable(front.groupBy("of").agg(F.min("epochs").alias("__epochs"), last.alias("__last")))
    kept = F.struct(*(F.col(c).alias(f"__{c}") for c in df.columns)).alias("__row")
    rows = sized(df, doc_id, text, source, kept).withColumn("__key", F.struct(*_ORDER))
    rows = salted_join(rows, cuts, ["of"], "inner", BROADCAST_SOURCES)
    among = F.coalesce((F.col("size") > 0) & (F.col("__key") == F.col("__last.key")) & (F.col("__last.again") < F.col("__last.equal")), F.lit(False))
    sooner = F.coalesce((F.col("size") > 0) & (F.col("__key") <= F.col("__last.key")), F.lit(False))

    def repeated(some: DataFrame, more: Column) -> DataFrame:
        copies = (F.col("__epochs") + more.cast("long")).cast("int")
        each = some.filter(copies > 0).select("__row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__n"))
        return each.select(*(F.col(f"__row.__{c}").alias(c) for c in df.columns))

    if cuts.filter("__last.again < __last.equal").isEmpty():
        return repeated(rows, sooner)
    ties = durable(rows.filter(among).select("of", "__row", "__epochs", "__last", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("__deal")))
    dealt = ties.groupBy("of", "__deal").agg(F.count("*").alias("__held"))
    ahead = Window.partitionBy("of").orderBy("__deal").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("of", "__deal", F.coalesce(F.sum("__held").over(ahead), F.lit(0)).alias("__ahead"))
    numbered = ties.join(dealt, ["of", "__deal"]).withColumn("__at", F.col("__ahead") + F.row_number().over(Window.partitionBy("of", "__deal").orderBy(F.lit(0))))
    return repeated(rows.filter(~among), sooner).unionByName(repeated(numbered, F.col("__at") <= F.col("__last.again")))


ORACLE = r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce("text", '')) AS chars,
               (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce("text", ''))), 1, 12))::BIGINT::DOUBLE + 1.0) / 281474976710657.0 AS u FROM documents
    ), r AS (
        SELECT *, -ln(u) / CASE WHEN chars::DOUBLE / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS k FROM d
    ), s AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS num FROM r GROUP BY source
    ), w AS (
        SELECT *, CASE num % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight, 2 * source_size AS cap FROM s
    ), c AS (
        SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS caps, (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS others,
               row_number() OVER (ORDER BY cap::DOUBLE / weight, num) AS step, (3 * sum(source_size) OVER ())::BIGINT AS budget
        FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), l AS (SELECT *, budget - 2 * caps AS remaining, 2 * cap * others >= weight * (budget - 2 * caps) AS open FROM c
    ), f AS (SELECT min(step) AS step FROM l WHERE open
    ), t AS (
        SELECT l.source, l.source_size, CASE WHEN f.step IS NULL OR l.step < f.step THEN l.cap::DOUBLE
               ELSE (l.weight * x.remaining)::DOUBLE / (2 * x.others)::DOUBLE END AS target
        FROM l CROSS JOIN f LEFT JOIN l AS x ON x.step = f.step
    ), p AS (
        SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
               coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
        FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           (epochs * size + greatest(least(floor(target)::BIGINT - epochs * source_size - ahead, size), 0))::BIGINT AS taken FROM p"""
