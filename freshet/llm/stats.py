"""Document statistics as one struct, from built-in functions over the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import NOT_GAP, fresh, hold, text_of, words_of

# Counts that the rules' contract names, then more for learned verdicts.
SHARES = (
    "n_words word_length symbol_share dup_line_share repeat_share distinct_share "
    "upper_share mark_share digit_share line_words end_share other_share"
).split()


def _repeated_words(grams: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    ``grams`` holds a hash and a place per window, sorted by hash.  Windows next to
    an equal hash are repeats; the union of their places is counted by the distance
    from each place to the one after it, three at most.
    """
    n = F.size(grams)
    twice = F.filter(
        grams,
        lambda g, i: ((i > 0) & (F.get(grams, i - 1)["h"] == g["h"]))
        | ((i < n - 1) & (F.get(grams, i + 1)["h"] == g["h"])),
    )
    places = F.sort_array(F.transform(twice, lambda g: g["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def with_stats(df: DataFrame, out: str, text: str = "text") -> DataFrame:
    """Add struct ``out``: counts of the whole text and shares derived from them.

    A null text counts as empty: no words, no lines, all shares 0.  Windows of three
    words are compared by a 64-bit hash.
    """
    keep = df.columns
    t_, w_, h_, g_, l_, c_ = (fresh(df, x) for x in ("_t", "_w", "_h", "_g", "_l", "_c"))
    df = hold(df, t_, text_of(text))
    df = hold(df, w_, words_of(F.col(t_)))
    w = F.col(w_)
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)),
    )
    nothing = F.lit(None).cast(T.ArrayType(T.LongType()))
    df = hold(df, h_, F.when(F.size(w) >= 3, hashes).otherwise(nothing))
    h = F.col(h_)
    # Few texts repeat a window: the others skip the sort.
    repeats = F.size(h) > F.size(F.array_distinct(h))
    sorted_grams = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = hold(df, g_, F.when(repeats, sorted_grams))
    lines = F.filter(F.split(F.col(t_), "\n"), lambda x: x.rlike(NOT_GAP))
    df = hold(df, l_, lines)
    t, n_words = F.col(t_), F.size(w).cast("long")

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("long")

    df = hold(
        df,
        c_,
        F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            (F.size(l_) - F.size(F.array_distinct(l_))).cast("long").alias("n_dup_lines"),
            F.coalesce(_repeated_words(F.col(g_)), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(l_).cast("long").alias("n_lines"),
            count(r"\p{Lu}").alias("n_upper"),
            count(r"[!?]").alias("n_marks"),
            count(r"[0-9]").alias("n_digits"),
            count(r"[.]").alias("n_ends"),
            count(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]").alias("n_punct"),
        ),
    )
    c = F.col(c_)

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(c[part].cast("double"), c[whole]), F.lit(0.0))

    shares = {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "line_words": share("n_words", "n_lines"),
        "end_share": share("n_ends", "n_words"),
        "other_share": share("n_punct", "n_words"),
    }
    counts = [c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.select(*keep, F.struct(*counts, *(v.alias(k) for k, v in shares.items())).alias(out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n_rows: int, where: Column | None = None) -> DataFrame:
    """Documents with a label: ``n_rows`` at most, picked by a hash of the id.

    The bound is a parameter of every caller.  Rows without id or label are left
    out; an id labelled twice takes the greater label.  Only the ids of the sample
    are broadcast.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
    if where is not None:
        known = known.where(where)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(n_rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text"))
    return texts.join(F.broadcast(picked), "_id")
