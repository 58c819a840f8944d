"""How sources differ from one another, and from their language, in the terms they use.

The terms of a language are those in at least `min_docs` of its documents. Each term is one row with an array of its
counts indexed by source (a wide vector), which becomes an array of smoothed shares p = 1 + floor(SCALE * (count + 2) /
(n + 2 * terms)), n being the source's count of all terms kept. The symmetric chi-square of two shares is
floor((p - q)^2 / (p + q)). Higher-order functions emit the contributions of each pair of sources from a term's array,
and they are summed on the map side, so what is shuffled is a row for each pair and task.

Shares are divided in three steps of a thousand, exact in 64 bits while a language keeps fewer than 9 * 10^15 terms.
A null text has no terms; null languages and sources are empty strings. Repeated rows count as often as they occur.
Only the three columns are read, so other columns may have any name; an empty table gives an empty result. Sources
without terms take part with the share of a count of zero; a language without kept terms has value 0 for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm import common
from tapeline.llm.decontaminate import ascii_lower

#: Characters between terms, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
#: Ranks of the terms of a source.
TOP = 10
#: Sources of all languages up to which their totals are broadcast (below 200 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 50_000


def term_counts(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, count and docs (documents with the term).

    A document's terms are sorted and each is zipped with the one before it, so that the first of its kind is seen
    where it stands. The outer form keeps Catalyst from inferring a filter that would cut the text twice.
    """
    text, empty = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("")
    rows = documents.select(
        F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
        F.sort_array(F.split(F.regexp_replace(ascii_lower(text), BETWEEN, " "), " ")).alias("w"),
    )
    rows = rows.select("lang", "source", F.arrays_zip(F.col("w").alias("term"), F.concat(F.array(F.lit(None).cast("string")), "w").alias("before")).alias("z"))
    rows = rows.select("lang", "source", F.explode_outer("z").alias("t")).where("t.term <> ''")
    return rows.groupBy("lang", "source", "t.term").agg(F.count("*").alias("count"), F.count_if(~F.col("t.term").eqNullSafe(F.col("t.before"))).alias("docs"))


def share(count: Column, n: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 * terms)) in long arithmetic."""
    whole, rest, out = n + 2 * terms, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = 1000 * rest
        out = 1000 * out + _div(rest, whole)
        rest = rest % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _vector(entries: Column, size: Column) -> Column:
    """The counts of entries (place, count), sorted by place, at their places in an array of zeros."""
    zero = F.lit(0).cast("long")
    following = lambda k: F.coalesce(F.get(entries, k + 1)["place"], size)
    runs = F.transform(entries, lambda e, k: F.concat(F.array(e["count"]), F.array_repeat(zero, following(k) - e["place"] - 1)))
    return F.concat(F.array_repeat(zero, F.get(entries, F.lit(0))["place"]), F.flatten(runs))


def divergence(
    documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """lang, source, part, item, value and rank.

    part 'pair': item is each other source of the language, value their distance summed over the kept terms.
    part 'term': item is a term that the source uses more than its language does, value its distance, ranks to `top`.
    Ranks go by falling value, then by item.
    """
    since = common.staged_so_far()
    counts = common.stage(term_counts(documents, text_col=text_col, lang_col=lang_col, source_col=source_col), "counts")
    empty = F.lit("")
    groups = documents.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    groups = common.stage(groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    small = F.broadcast if groups.count() <= BROADCAST_ROWS else (lambda df: df)  # beyond, Spark splits joins on hot keys

    placed = counts.join(small(groups), ["lang", "source"])
    kept = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.sort_array(F.collect_list(F.struct("place", "count"))).alias("entries"))
    kept = common.stage(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept")
    sums = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.place").agg(F.sum("e.count").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    layout = groups.join(sums, ["lang", "place"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    layout = layout.join(terms, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("ns"), "terms", "all")
    layout = common.stage(layout, "layout")

    wide = kept.join(small(layout), "lang").withColumn("counts", _vector(F.col("entries"), F.size("sources")))
    shares = F.zip_with("counts", "ns", lambda c, n: share(c, n, F.col("terms")))
    wide = common.stage(wide.select("lang", "term", "counts", shares.alias("p"), share(F.col("total"), F.col("all"), F.col("terms")).alias("q")), "wide")

    # equal shares have distance 0: a row that gives every pair of a language its sum, even without terms
    vectors = wide.select("lang", "p").unionByName(layout.select("lang", F.transform("ns", lambda _: F.lit(1).cast("long")).alias("p")))
    firsts = vectors.where("size(p) > 1").select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("i"))
    emitted = firsts.select("lang", "i", F.posexplode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q: distance(F.get("p", F.col("i")), q))).alias("j", "value"))
    pairs = emitted.groupBy("lang", "i", (F.col("i") + 1 + F.col("j")).alias("j")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")).join(small(layout), "lang")
    pairs = pairs.select("lang", F.get("sources", F.col("x.i")).alias("source"), F.lit("pair").alias("part"), F.get("sources", F.col("x.j")).alias("item"), "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    used = wide.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("place", "x")).where("x.counts > 0 and x.p > q")
    used = used.select("lang", "place", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("x.p"), F.col("q")).alias("value"))
    ranked = used.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    named = ranked.join(small(groups), ["lang", "place"]).select(*pairs.columns)
    common.sweep(since, layout, groups, wide)
    return pairs.unionByName(named)
