"""Mixing sources to target weights, with DataFrame functions alone.

Words per source are summed, each source gets a target, and each document is emitted ``floor(rate)`` times plus one more
time with the probability ``rate - floor(rate)``, decided by a hash of the document, where ``rate`` is the source's target
over its words.

Cases: null text has no words; null is a source like any other, last in order; a source without words has the target 0 and
its documents are not emitted; repeated rows take the same decision, since it hangs on identifier, text and seed alone; an
empty table gives an empty mix; other columns are kept by :func:`emit` and not read by :func:`mix_plan`; a very long text
is counted and hashed whole, as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.common import WORD, cut

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and how often a source may be repeated.
SHARE, MOST = 1.5, 2
#: So many sources may be sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, nth`` of each source, ``nth`` counting from 0 in the order of code points, null last.

    One sort by range, whose written partitions each know their rows' places; the rows of the partitions before are summed
    over one row a partition. No task sees more sources than its range.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = cut(rows.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)})
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("place")).alias("nth"))


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of each source, from ``source, size`` rows.

    Weights are handed out by the order of the sources' code points. A target is ``least(most * size, weight * level)``,
    with the one level at which targets add up to ``share`` of all words. It is found as the mix is told: the level of all
    sources, then again of those that are not above their bound, until none is. Each round is one aggregate of the sources
    with one row to the driver, sums are whole numbers, and the level only rises, so rounds end, in practice after a few.
    """
    rows = cut(ranked_sources(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))).withColumn("bound", F.col("source_size") * most))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, bounded = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("bound") <= F.col("weight") * F.lit(level)
        n, held, weights = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weights or n == bounded:
            break
        bounded, level = n, (total * share - held) / weights
    target = F.col("bound").cast("double") if not weights else F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1 from 52 bits of an MD5 of seed, identifier and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_plan(docs: DataFrame, seed: int = 7, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row ``doc_id, size, source_size, target, copies`` and the columns named in ``keep``.

    Sources are summed with a partial aggregate before the shuffle and the targets are written to the shared folder.
    Up to ``BROADCAST_ROWS`` sources are broadcast; beyond that rows are joined by shuffle, where AQE splits hot sources.
    """
    text = F.col(text_col)
    targets = cut(source_targets(docs.select(F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"))))
    side = targets.withColumnRenamed("source", "_mix_source")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if id_col in keep else [F.col(id_col)]), F.col(source_col).cast("string").alias("_mix_key"), n_words(text).alias("size"), draw(F.col(id_col), text, seed).alias("_mix_draw"))
    rows = rows.join(F.broadcast(side) if targets.count() <= BROADCAST_ROWS else side, F.col("_mix_key").eqNullSafe(F.col("_mix_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("_mix_draw") < rate - F.floor(rate), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).drop("_mix_key", "_mix_source", "_mix_draw")


def emit(docs: DataFrame, seed: int = 7, **columns: str) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as the plan says, columns unchanged."""
    named = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    ids = {k: named[v] for k, v in ({"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns).items()}
    plan = mix_plan(docs.toDF(*named.values()), seed, keep=tuple(named.values()), **ids)
    rows = plan.where("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(v).alias(k) for k, v in named.items()])


def mix_digest(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Per document the words that the mix takes of it, repeats counted."""
    return mix_plan(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
b AS (SELECT *, ([5, 2, 1])[nth % 3 + 1] AS weight, (2 * source_size)::DOUBLE AS bound FROM w),
l AS (
  SELECT *, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM b WINDOW o AS (ORDER BY bound / weight, nth)),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE bound > weight * level),
t AS (SELECT l.source, l.source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN l.bound ELSE l.weight * f.level END AS target FROM l CROSS JOIN f),
r AS (SELECT d.doc_id, d.size, d.draw, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken FROM r
"""
