"""Benchmark decontamination with DataFrame functions only.

A benchmark item is cut into windows of `width` words (an item of fewer words is one window). Of a
window's word shingles the rarest in the corpus is its necessary prefix token: a document that holds
the window holds that shingle, and one token is enough because containment must be whole. Documents
are joined on these tokens alone, cut by the positional and length bounds of the window around the
token, and the survivors are verified word for word.

Null and empty texts have no words and are never contaminated. Repeated items and items that share
windows are all counted. Rows without an id are left out. Repeated document rows are judged alike,
one result each. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

#: Characters that end a word, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark shingles up to which the token table is broadcast (below 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and no other letter; the fast built-in serves texts that are ASCII throughout."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; null and texts without words give an empty array."""
    cut = F.split(F.regexp_replace(ascii_lower(text), SEPARATORS, " "), " ")
    return F.coalesce(F.array_remove(cut, ""), F.array().cast("array<string>"))


def _shingles(df: DataFrame, words: str, length: int) -> DataFrame:
    """A row (pos, g) for each shingle of so many words beside df's other columns; g hashes length and words.

    The words and their shifted copies are zipped, so that rows of a shingle leave the generator whole;
    the outer form keeps Catalyst from inferring a filter that would cut the text twice.
    """
    shifted = [F.slice(words, k + 1, 1 << 30).alias(f"c{k}") for k in range(length)]
    keep = [c for c in df.columns if c != words]
    rows = df.select(*keep, F.arrays_zip(*shifted).alias("z")).select(*keep, F.posexplode_outer("z").alias("pos", "t"))
    rows = rows.where(F.col(f"t.c{length - 1}").isNotNull())
    return rows.select(*keep, "pos", F.xxhash64(F.lit(length), *[F.col(f"t.c{k}") for k in range(length)]).alias("g"))


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows: window (words joined by spaces), len, ww (its words), items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("w"))
    items = items.where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("ww"))
    cut = cut.groupBy("ww").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return cut.select(F.array_join("ww", " ").alias("window"), F.size("ww").alias("len"), "ww", "items")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    shingle: int = 3,
) -> DataFrame:
    """doc_id, n_words, hits (array of structs start, len, items; sorted), n_hit and items (sorted strings)."""
    docs = common.rows_in(documents, id_col, text_col)
    spark = docs.sparkSession
    windows = common.stage(windows_of(benchmark, item_col, item_text_col, width), "windows")
    sizes = [r[0] for r in windows.select(F.least("len", F.lit(shingle))).distinct().collect()] or [shingle]  # at most `shingle` rows
    kinds = [windows.where(F.least("len", F.lit(shingle)) == n).select("window", "len", "items", "ww") for n in sizes]
    token_rows = reduce(DataFrame.unionByName, [_shingles(df, "ww", n) for df, n in zip(kinds, sizes, strict=True)])
    tokens = token_rows.select("g").distinct()
    bounded = tokens.count() <= BROADCAST_ROWS
    small = F.broadcast if bounded else (lambda df: df)

    # every occurrence of a benchmark shingle in the corpus, once; these rows give both rarity and candidates
    words = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", "w", F.size("w").alias("n_words"))
    found = reduce(DataFrame.unionByName, [_shingles(words, "w", n).join(small(tokens), "g", "left_semi") for n in sizes])
    found = common.stage(found, "found")

    rarity = found.groupBy("g").agg(F.count("*").alias("seen"))
    ranked = token_rows.join(rarity, "g", "left").groupBy("window", "len", "items").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "g", "pos")).alias("rarest")
    )
    prefix = ranked.where("rarest.seen > 0").select("window", "len", "items", F.col("rarest.g").alias("g"), F.col("rarest.pos").alias("lead"))
    few = bounded and windows.count() <= BROADCAST_ROWS
    candidates = found.join(F.broadcast(prefix) if few else prefix, "g").select(
        "doc_id", "n_words", (F.col("pos") - F.col("lead")).alias("start"), "len", "window", "items"
    )
    candidates = candidates.where("start >= 0 and start + len <= n_words")
    candidates = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "len", "window", "items"))).alias("candidates"))

    joined = docs.join(candidates.hint("shuffle_hash"), "doc_id", "left").select("doc_id", words_of(F.col("text")).alias("w"), "candidates")
    hits = F.filter("candidates", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["len"]), " ") == c["window"])
    hits = F.transform(hits, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["items"].alias("items")))
    none = F.array().cast("array<struct<start:int,len:int,items:array<string>>>")
    judged = joined.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.col("candidates").isNotNull(), hits).otherwise(none).alias("hits"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end")),
        lambda a, h: F.struct(
            (a["sum"] + F.greatest(F.lit(0), h["start"] + h["len"] - F.greatest(a["end"], h["start"]))).cast("long").alias("sum"),
            F.greatest(a["end"], h["start"] + h["len"]).alias("end"),
        ),
        lambda a: a["sum"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return judged.select("doc_id", "n_words", "hits", covered.alias("n_hit"), items.alias("items"))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """The rule: a document is contaminated if a twentieth of its words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
