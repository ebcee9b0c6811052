"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame and SQL functions alone.

A source's share of the words asked for, over its own words, is how many copies of each of its documents the mix should
hold; the fraction of a copy has to be rounded. Two documents with fractions pass words from one to the other, at random in
either direction and as many as it takes until one of them has no fraction left: the source's words stay as they are, and
so does what each document may expect.

Blocks of some 32 documents of a source and of like size do that in one grouping; what each leaves, one document with a
fraction at most, meets those of other blocks in a tree of groupings (`FAN` to one). In the last, a source's documents of all
sizes meet from the largest to the smallest, so that what is left over at the end, and is rounded to the nearer side, is
small. Blocks and directions follow from hashes of ids and sizes: reruns agree, whatever the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import heavy_keys, lookup_join, sheltered, written

#: Documents of a block, blocks that meet in the next step, and how many there may be when a source's rest meets at once.
BLOCK, FAN, LAST = 32, 64, 64
#: Equal rows are told out so many to a row, before rows are dealt.
TOLD = 4096
_ENTRY = "struct<size:bigint,id:bigint,n:bigint,whole:bigint,y:double>"


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (source_key, size): one row per source with source_size and target.

    Sources in order have the weights in turn. Each step shares what capped sources leave among the others by weight, until
    none of those is above its own cap. Steps follow from sums over all sources; no task gathers the sources.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # parts in order, each in order within: a source's place is what stands before its part and its place there
    parted = written(sums.repartitionByRange("source_key").withColumn("part", F.spark_partition_id()), "sources")
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = parted.join(F.broadcast(starts), "part").select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    weighed = written(weighed, "weights", small=True)
    budget = share * (weighed.agg(F.sum("source_size")).head()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        row = weighed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).head()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], max(level, (budget - (row["held"] or 0.0)) / row["weight"])
    return weighed.select("source_key", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _settled(e: str) -> str:
    return f"({e}.y <= 0 OR {e}.y >= {e}.size)"


def _folded(entries: str, seed: str) -> str:
    """SQL: the entries of an array meet one after the other; (open: none or one that still has a fraction, done: the others).

    a holds the entry with a fraction so far and the next. Either a[0] rises by what is missing to a whole copy or by what a[1]
    has, whichever is less, or it falls likewise; chances are the other way round as the steps, so that expectations stay.
    """
    up, down = "least(a[0].size - a[0].y, a[1].y)", "least(a[0].y, a[1].size - a[1].y)"
    chance = f"pmod(xxhash64({seed}, a[0].id, a[0].size, a[1].id, a[1].size), 4503599627370496) / 4503599627370496e0"
    first = f"CASE WHEN {chance} * ({up} + {down}) < {down} THEN IF(a[0].size - a[0].y <= a[1].y, CAST(a[0].size AS DOUBLE), a[0].y + a[1].y) ELSE IF(a[0].y <= a[1].size - a[1].y, 0e0, a[0].y - (a[1].size - a[1].y)) END"
    # the second gives what the first took; where it is the one that ends, it ends exactly
    second = "CASE WHEN m.y >= a[0].y THEN IF(m.y >= a[0].size, a[1].y - (a[0].size - a[0].y), 0e0) ELSE IF(m.y <= 0, a[1].y + a[0].y, CAST(a[1].size AS DOUBLE)) END"
    moved = lambda i, y: f"named_struct('size', a[{i}].size, 'id', a[{i}].id, 'n', a[{i}].n, 'whole', a[{i}].whole, 'y', {y})"
    pair = f"flatten(transform(array(concat(s.open, array(e))), a -> transform(array({moved(0, first)}), m -> array(m, {moved(1, second)}))[0]))"
    empty = f"CAST(array() AS array<{_ENTRY}>)"
    return f"""aggregate({entries}, named_struct('open', {empty}, 'done', {empty}), (s, e) -> CASE WHEN size(s.open) = 0 THEN named_struct('open', array(e), 'done', s.done)
        ELSE transform(array({pair}), p -> named_struct('open', filter(p, x -> NOT {_settled('x')}), 'done', concat(s.done, filter(p, x -> {_settled('x')}))))[0] END)"""


def pivoted(entries: DataFrame, seed: int) -> DataFrame:
    """entries (source_key, e) with fractions 0 < y < size of words each: the same with y 0 or size, in groupings by the tree."""
    spark = entries.sparkSession
    blocks = max(1, -(-entries.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.lit(seed), "e.id", "e.size"), F.lit(blocks))
    kind = F.floor(F.log2(F.col("e.size")))
    rows = entries.select("source_key", kind.alias("kind"), block.alias("block"), "e")
    level, tables = 0, []
    while True:
        grouped = rows.groupBy("source_key", "kind", "block").agg(F.sort_array(F.collect_list("e"), asc=False).alias("es"))
        table = written(grouped.select("source_key", "kind", "block", F.expr(_folded("es", f"{seed}L, {level}")).alias("f")), "pivots")
        tables.append(table.select("source_key", F.explode("f.done").alias("e")))
        rows = table.select("source_key", "kind", "block", F.explode("f.open").alias("e"))
        level += 1
        if blocks <= LAST:
            break
        blocks = -(-blocks // FAN)
        rows = rows.withColumn("block", F.floor(F.col("block") / FAN))
    last = rows.groupBy("source_key").agg(F.sort_array(F.collect_list("e"), asc=False).alias("es"))
    last = last.select("source_key", F.expr(_folded("es", f"{seed}L, {level}")).alias("f"))
    nearer = "transform(f.open, x -> named_struct('size', x.size, 'id', x.id, 'n', x.n, 'whole', x.whole, 'y', IF(2 * x.y >= x.size, CAST(x.size AS DOUBLE), 0e0)))"
    tables.append(last.select("source_key", F.explode(F.expr(f"concat(f.done, {nearer})")).alias("e")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 2024, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies and taken (words of all its copies).

    Sources in the order of their code points, null last, have the weights in turn and share `share` times all words; none has
    a target above `most` times its own. A document has one of the two whole numbers of copies next to target / source_size.
    Documents without words are taken never and count 0, sources without words have target 0. Rows with equal key, source and
    size are one entry with a number, so any number of them is no burden; null keys are a key like any other. An
    empty table gives an empty result; further columns are left out, `repeated` brings them back.
    """
    sheltered(documents, key, text, source)
    named = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    sizes = documents.select(F.col(key).cast("long").alias("id"), named.alias("source_key"), word_count(F.col(text).cast("string")).alias("size"))
    sizes = written(sizes.groupBy("source_key", "id", "size").agg(F.count("*").alias("n")), "sizes")
    shares = written(targets(sizes.select("source_key", (F.col("size") * F.col("n")).alias("size")), weights, share, most), "targets", small=True)
    heavy = heavy_keys(sizes.select("source_key"), "source_key")
    rows = lookup_join(sizes, shares, "source_key", heavy)
    rows = rows.withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    part = F.col("n") * (F.col("p") - F.floor("p"))
    rows = rows.withColumns({"whole": F.floor(part), "y": (part - F.floor(part)) * F.col("size")})
    entry = F.struct("size", "id", "n", "whole", F.col("y").alias("y")).cast(_ENTRY)
    entries = written(rows.select("source_key", entry.alias("e")), "entries")
    open_ = (F.col("e.y") > 0) & (F.col("e.y") < F.col("e.size"))
    done = pivoted(entries.where(open_), seed).unionByName(entries.where(~open_))
    # equal rows are told out: first to rows of TOLD at most, which are dealt, then one by one
    extra = F.col("e.whole") + F.when((F.col("e.y") >= F.col("e.size")) & (F.col("e.size") > 0), 1).otherwise(0)
    done = done.select("source_key", "e.id", "e.size", "e.n", extra.alias("extra"))
    once = done.where("n = 1").withColumn("at", F.lit(1).cast("long"))
    spans = done.where("n > 1").withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOLD)))).repartition("id", "size", "span")
    many = spans.withColumn("at", F.explode(F.sequence(F.col("span") * TOLD + 1, F.least((F.col("span") + 1) * TOLD, F.col("n"))))).drop("span")
    out = lookup_join(once.unionByName(many), shares, "source_key", heavy)
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor(p) + F.when(F.col("at") <= F.col("extra"), 1).otherwise(0)).cast("long")
    name = F.when(F.col("source_key") != "1", F.expr("substring(source_key, 2)"))
    return out.select(F.col("id").alias(key), name.alias(source), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated(documents: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as its copies say. Of rows with equal key, source and size, the first texts get most copies."""
    same = Window.partitionBy(key, source, "_size")
    named = documents.withColumn("_size", word_count(F.col(text))).withColumn("_at", F.row_number().over(same.orderBy(F.xxhash64(text), text)))
    told = mixed.where("copies > 0").withColumnRenamed("size", "_size").select(key, source, "_size", "copies")
    told = told.withColumn("_at", F.row_number().over(same.orderBy(F.desc("copies"))))
    a, b = named.alias("a"), told.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (key, source, "_size", "_at")]
    return a.join(b, on).select("a.*", F.col("b.copies").alias("_copies")).withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).drop("_size", "_at", "_copies", "_copy")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_mixing": op12_mixing}
ORACLES: dict[str, str] = {}
