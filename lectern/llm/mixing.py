"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key ``-ln(u) / w``: u a reproducible hash of (seed, doc_id, source, text), w its
quality weight.  Within a source, ascending keys are a weighted order without replacement.  A source whose target is
``e`` times its size plus a rest gives ``e`` complete epochs, then the documents at the head of that order whose prefix
sum fills the rest (the boundary document goes in if that lands nearer the target).

The order is found on narrow rows (source, key, size), range-partitioned by (source, key): a source that holds most
rows is spread over many partitions; prefix sums are local sums plus partition starts.  Only one row per source
reaches the driver.  The outcome per source is a cut-off key, so texts are never shuffled: it is applied by a
broadcast of the source table (below a checked bound, a join beyond it).

The order is total.  Rows equal in (doc_id, source, text) share a key; where the cut falls among them, so many of them go
in as fill the rest best, and which is settled by a number among the rows of that one key (a window over those rows only,
ordered by their other columns; rows equal in all columns are alike, so any of them may be the one).

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; null or
repeated doc_id is allowed; ties of keys of different rows (64-bit hashes) count as equal rows; very long texts are only
counted, in the JVM; a source of size 0 has target 0; an empty table gives an empty result; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, local_table, n_words, table, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 20240607
#: Source rows up to which the source table is broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, cap=CAP) -> dict[str | None, float]:
    """Target words by source: ``share`` of all words by weight, none above ``cap`` times its size, excess reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    left = share * sum(n for _, n in order)
    open_ = {s: (weights[i % len(weights)], n) for i, (s, n) in enumerate(order)}
    out: dict[str | None, float] = {}
    while open_:
        per = left / sum(w for w, _ in open_.values())
        over = [s for s, (w, n) in open_.items() if w * per > cap * n]
        if not over:
            out.update({s: w * per for s, (w, _) in open_.items()})
            break
        for s in over:
            out[s] = cap * open_.pop(s)[1]
            left -= out[s]
    return out


def quality_weight(text):
    """From 0.1 to 1: the share of characters that are not junk symbols."""
    t = F.coalesce(text, F.lit(""))
    junk = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - junk / F.greatest(F.length(t), F.lit(1)))


def _key(text, weight):
    return -F.log(unit_interval(F.lit(SEED), F.col("doc_id"), F.col("source"), text)) / weight


def _local_sums(batches):
    """Running words of each source within this partition; rows come sorted by source and key."""
    part, source, total = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        cum = []
        for s, n in zip(b["source"].to_pylist(), b["size"].to_pylist(), strict=True):
            if s != source:
                source, total = s, 0
            total += n
            cum.append(total)
        yield pa.RecordBatch.from_arrays(
            [b["source"], b["mix_key"], b["size"], pa.array(cum, pa.int64()), pa.array([part] * len(cum), pa.int32())],
            ["source", "mix_key", "size", "cum", "part"],
        )


def plan(docs: DataFrame, weight=None) -> tuple[DataFrame, DataFrame, int]:
    """(narrow rows: doc_id, source, size, mix_key; sources: source, source_size, target, epochs, cutoff, tied; how many sources)."""
    return _plan(docs, weight)[:3]


def _plan(docs: DataFrame, weight=None) -> tuple[DataFrame, DataFrame, int, bool]:
    """As ``plan``; last, whether a cut falls among rows of one key."""
    spark = docs.sparkSession
    text = F.col("text")
    narrow = docs.select("doc_id", "source", n_words(text).alias("size"), _key(text, quality_weight(text) if weight is None else weight).alias("mix_key"))
    narrow = cut(narrow, "mix-keys")
    sizes = [(r["source"], r["n"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(sizes)
    rows = [(s, n, float(goal[s]), int(goal[s] // n) if n else 0) for s, n in sizes]
    sources = local_table(spark, rows, "source string, source_size long, target double, epochs int")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["source", "mix_key"]
    ordered = narrow.select("source", "mix_key", "size").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = cut(ordered.mapInArrow(_local_sums, "source string, mix_key double, size long, cum long, part int"), "mix-order")
    # One row per (source, partition it touches): at most sources + partitions rows.
    starts = ordered.groupBy("source", "part").agg(F.max("cum").alias("here"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"))
    starts = small(starts.select(F.col("source").alias("src"), F.col("part").alias("p"), "start"), len(rows) + parts)
    placed = ordered.join(starts, F.col("source").eqNullSafe(F.col("src")) & (F.col("part") == F.col("p")))
    placed = placed.select("src", "mix_key", "size", (F.col("start") + F.col("cum")).alias("cum"))
    few = small(sources, len(rows))
    # The boundary document goes in if the target lies past its midpoint.
    inside = placed.join(few, F.col("src").eqNullSafe(F.col("source"))).where((2 * F.col("cum") - F.col("size") <= 2 * rest) & (rest > 0))
    last = inside.groupBy("src").agg(F.max(F.struct("mix_key", "cum")).alias("x")).select("src", "x.mix_key", "x.cum").collect()
    cuts = {r["src"]: (r["mix_key"], r["cum"]) for r in last}
    # Rows that share the cut-off key go in by number: as many as lie up to the cut.
    at = local_table(spark, [(s, *cuts.get(s, (None, None))) for s, *_ in rows], "s string, k double, c long")
    ties = placed.join(small(at, len(rows)), F.col("src").eqNullSafe(F.col("s")) & (F.col("mix_key") == F.col("k")))
    tied = {r["src"]: (r["n"], r["of"]) for r in ties.groupBy("src").agg(F.sum((F.col("cum") <= F.col("c")).cast("int")).alias("n"), F.count("*").alias("of")).collect()}
    out = local_table(spark, [(*r, cuts.get(r[0], (None,))[0], tied.get(r[0], (0,))[0]) for r in rows], "source string, source_size long, target double, epochs int, cutoff double, tied long")
    return narrow, out, len(rows), any(n < of for n, of in tied.values())


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def copies(key, epochs, cutoff, number, tied):
    """How often a document is taken: once more before the cut-off key, and at it for the first ``tied`` rows."""
    more = cutoff.isNotNull() & ((key < cutoff) | ((key == cutoff) & (number <= tied)))
    return (epochs + F.when(more, 1).otherwise(0)).cast("int")


def numbered(rows: DataFrame, ties: bool, key: str, cutoff: str, source: str, order) -> DataFrame:
    """``rows`` with __mix_no: the number among the rows of a source that stand at its cut-off key, else 1.  Without ties all of these go in."""
    if not ties:
        return rows.withColumn("__mix_no", F.lit(1).cast("long"))
    at = F.col(key).eqNullSafe(F.col(cutoff)) & F.col(key).isNotNull()
    no = F.row_number().over(Window.partitionBy(source).orderBy(order)).cast("long")
    return rows.where(~at).withColumn("__mix_no", F.lit(1).cast("long")).unionByName(rows.where(at).withColumn("__mix_no", no))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every document's row as often as it is taken, with the columns it came with."""
    _, sources, n, ties = _plan(docs)
    src = small(sources.select(*(F.col(c).alias(f"__mix_{c}") for c in sources.columns)), n)
    names = docs.columns
    text = F.col("text")
    keyed = docs.withColumn("__mix_key", _key(text, quality_weight(text))).withColumn("__mix_n", n_words(text))
    taken = keyed.join(src, F.col("source").eqNullSafe(F.col("__mix_source"))).where(F.col("__mix_n") > 0)
    taken = numbered(taken, ties, "__mix_key", "__mix_cutoff", "__mix_source", F.xxhash64(*(F.col(f"`{c}`") for c in names)))
    times = copies(F.col("__mix_key"), F.col("__mix_epochs"), F.col("__mix_cutoff"), F.col("__mix_no"), F.col("__mix_tied"))
    taken = taken.withColumn("__mix_times", times).where(F.col("__mix_times") > 0)
    return taken.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*names)


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    narrow, sources, n, ties = _plan(table(spark, sf_dir, "documents"))
    src = small(sources.withColumnRenamed("source", "src"), n)
    joined = numbered(narrow.join(src, F.col("source").eqNullSafe(F.col("src"))), ties, "mix_key", "cutoff", "src", F.col("doc_id"))
    times = copies(F.col("mix_key"), F.col("epochs"), F.col("cutoff"), F.col("__mix_no"), F.col("tied"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), "source")
