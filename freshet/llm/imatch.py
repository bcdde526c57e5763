"""I-Match fingerprints: hashes of the set of mid-frequency terms, over randomised lexicons.

A term belongs to the lexicon if the share of documents that hold it lies in a band.  Copies
and near copies count as one document, so that a large group of them does not lose its terms.
A text without a term of the lexicon is told by all of its terms.  The share has a lower bound, so the lexicon has at most (terms of an average document) /
(lower bound) terms however many documents there are; that is what allows a broadcast.
Each further lexicon keeps a random part of the terms, from all of them down to one in
4,096: large ones tell near-exact copies, small ones how much two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import hold, partitions, text_of
from freshet.session import stage

# Document shares between which a term is kept; as idf, ln(1 / share): 2.3 to 6.9.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
LEXICONS = 64
# Of 65,536, how many terms lexicon ``i`` keeps.
KEPT = [round(65_536 * 2 ** (-12 * i / (LEXICONS - 1))) for i in range(LEXICONS)]
# A lexicon of more terms is joined, not broadcast.
BROADCAST_TERMS = 500_000
# Texts whose so many least term hashes agree may be near copies; they are if of a longer list
# of least hashes half agree as well, or, if they have no more terms than that, half of these.
SKETCH, LONG_SKETCH = 4, 32
# The signature of a lexicon without a term of the text.
NONE = 0

_TERM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Distinct terms: lower-cased runs without white space and ASCII punctuation."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _TERM_GAP)), "")


def _ids(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _member(term_id: Column) -> Column:
    """A number with a bit for each lexicon that keeps the term."""
    drawn = F.transform(
        F.array(*map(F.lit, KEPT)),
        lambda kept, i: F.when(
            F.pmod(F.xxhash64(term_id, i), F.lit(65_536)) < kept, F.call_function("shiftleft", F.lit(1).cast("long"), i)
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(drawn, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _without_near_copies(texts: DataFrame) -> DataFrame:
    """``(text)``: the least of each group of texts that count as one document.

    Texts that agree in their short sketch are held against one of them, drawn by a hash, so
    that it comes from the largest group of near copies among them, if there is one.  Texts
    that agree with it in less than half of the long sketch stay apart; of these, such with the
    same terms are one.
    """

    def sketched(rows: DataFrame) -> DataFrame:
        rows = hold(rows, "_ids", F.array_sort(_ids(terms_of(F.col("text")))))
        # The lower halves, as least hashes have like upper ones.
        long = F.transform(F.slice("_ids", 1, LONG_SKETCH), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
        sketch = F.xxhash64(F.slice("_ids", 1, SKETCH))
        return rows.withColumns({"sketch": sketch, "own": F.xxhash64("_ids"), "long": long}).drop("_ids")

    told = sketched(texts.select("text"))
    firsts = told.groupBy("sketch").agg(F.min(F.struct("own", "long")).alias("first"), F.max("own").alias("last"))
    # Only where different texts share a sketch.
    leads, _ = stage(firsts.where(F.col("first.own") != F.col("last")).select("sketch", F.col("first.long").alias("lead")))
    shared, every = F.size(F.array_intersect("long", "lead")), F.size(F.array_union("long", "lead"))
    alike = F.col("lead").isNull() | (2 * shared >= every)
    # Sketches are made again behind the join, as the shuffle is wide enough with the texts.
    held = sketched(told.select("sketch", "text").join(leads, "sketch", "left").drop("sketch"))
    return held.groupBy(F.when(alike, F.col("sketch")).otherwise(F.col("own")).alias("_key")).agg(F.min("text").alias("text")).select("text")


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> tuple[DataFrame, int]:
    """Stored ``(term, id, member)`` of the band over ``texts (text)``, near copies as one, and its size.

    ``member`` has a bit for each lexicon that keeps the term.
    """
    different = _without_near_copies(texts)
    # The empty term, which no text has, counts the texts.
    every = F.concat(terms_of(F.col("text")), F.array(F.lit("")))
    held, _ = stage(different.select(F.explode(every).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    counted = held.where("term = ''").first()
    n = counted["df"] if counted else 0
    band = held.where((F.col("df") >= least * n) & (F.col("df") <= most * n) & (F.col("term") != ""))
    return stage(band.select("term", F.xxhash64("term").alias("id")).withColumn("member", _member(F.col("id"))))


def _kept(term_id: Column, member: Column, i: Column | int) -> Column:
    """The term's id if lexicon ``i`` keeps it, else 0."""
    # Bit i, moved to the sign and back, is a number of ones or zeros.
    left = F.call_function("shiftleft", member, F.lit(LEXICONS - 1) - i)
    return term_id.bitwiseAND(F.shiftright(left, LEXICONS - 1))


def _short(x: Column) -> Column:
    """The upper half of a hash; 0 is left to lexicons without a term."""
    top = F.shiftright(x, 32).cast("int")
    return F.when(x == 0, F.lit(NONE)).when(top == NONE, F.lit(1)).otherwise(top)


def _by_own(ids: Column) -> Column:
    """The fingerprint over all distinct terms of a text, by the same fold as over those of the band."""
    drawn = F.transform(ids, lambda t: F.struct(t.alias("id"), _member(t).alias("member")))

    def folded(terms: Column) -> Column:
        def one(i: Column) -> Column:
            return F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(_kept(t["id"], t["member"], i)))

        return F.transform(F.sequence(F.lit(0), F.lit(LEXICONS - 1)), lambda i: _short(one(i)))

    # An array of one, so that the terms are drawn once.
    return F.get(F.transform(F.array(drawn), folded), F.lit(0))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as lowercase hexadecimal digits, eight for each lexicon."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.right(F.hex(x), F.lit(8)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of the lexicons with a term in either fingerprint, the share on which both agree; 0 to 1."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(both, lambda x: (x["a"] != NONE) | (x["b"] != NONE)))
    same = F.size(F.filter(both, lambda x: (x["a"] != NONE) & (x["a"] == x["b"])))
    return F.coalesce(F.try_divide(same.cast("double"), used), F.lit(0.0))


def fingerprints(texts: DataFrame, key: str, columns: dict[str, str], terms: DataFrame, n_terms: int) -> DataFrame:
    """For text columns of ``texts`` their fingerprints, arrays of ``LEXICONS`` integers.

    ``columns`` maps text columns to the names of the fingerprints; the texts themselves
    are dropped, other columns stay.  ``texts`` is dealt by ``key``, so the terms of a row
    are gathered where the row is, without a shuffle.  Equal texts get equal fingerprints.

    A lexicon's part of a fingerprint is the exclusive or of the 64-bit ids of the distinct
    terms that it keeps.  This does not depend on order, so it tells the sorted terms
    without sorting them.  Null texts have to be made empty before; a text without a term
    of the band goes by all of its terms, one without any by its whole.
    """
    others = [c for c in texts.columns if c not in columns]
    cut = texts
    for i, c in enumerate(columns):
        cut = hold(cut, f"_ids{i}", _ids(terms_of(F.col(c))))

    def tagged(i: int) -> Column:
        return F.transform(F.col(f"_ids{i}"), lambda t: F.struct(F.lit(i).alias("side"), t.alias("id")))

    sides = F.concat(
        *(tagged(i) for i in range(len(columns))),
        # A row without terms stays in the result.
        F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).cast("long").alias("id"))),
    )
    row = F.struct(
        *others,
        *(F.xxhash64(F.lower(c)).alias(f"_whole{i}") for i, c in enumerate(columns)),
        *(f"_ids{i}" for i in range(len(columns))),
    )
    # Numbered before they are spread: a row's terms share its number.
    numbered = cut.select(key, F.monotonically_increasing_id().alias("_uid"), row.alias("_row"), sides.alias("_sides"))
    spread = numbered.select(key, "_uid", "_row", F.explode("_sides").alias("_t"))
    # The row's other columns travel on the row's own entry only.
    spread = spread.select(
        key, "_uid", F.when(F.col("_t.side") < 0, F.col("_row")).alias("_row"), F.col("_t.side").alias("_side"), F.col("_t.id").alias("id")
    )
    known = terms.select("id", "member")
    met = spread.join(F.broadcast(known) if n_terms <= BROADCAST_TERMS else known, "id", "left")
    met = met.where("member is not null or _side < 0").withColumn("member", F.coalesce("member", F.lit(0).cast("long")))
    # Fixed-width sums only, so that they are updated in place by compiled code.
    sums = [F.bit_xor(_kept(F.col("id"), F.col("member"), i)).alias(f"_x{i}") for i in range(LEXICONS)]
    folded = met.groupBy(key, "_uid", "_side", "_row").agg(*sums)
    made = F.array(*(_short(F.col(f"_x{i}")) for i in range(LEXICONS)))
    folded = folded.select(key, "_uid", "_side", "_row", F.when(F.col("_side") >= 0, made).alias("_made"))
    found = folded.groupBy(key, "_uid").agg(
        F.max("_row").alias("_row"),
        *(F.max(F.when(F.col("_side") == i, F.col("_made"))).alias(f"_found{i}") for i in range(len(columns))),
    )

    def told(i: int) -> Column:
        own, whole = F.col(f"_row._ids{i}"), F.col(f"_row._whole{i}")
        without = F.when(F.size(own) > 0, _by_own(own)).otherwise(F.array_repeat(_short(whole), LEXICONS))
        return F.when(F.col(f"_found{i}").isNotNull(), F.col(f"_found{i}")).otherwise(without)

    return found.select(*(F.col("_row")[c].alias(c) for c in others), *(told(i).alias(name) for i, name in enumerate(columns.values())))


# Next documents ----------------------------------------------------------------------


def next_ids(keys: DataFrame) -> DataFrame:
    """``(k, next_k)`` for distinct ``k``: the next lower one, and after the least the greatest.

    Keys are cut into sorted ranges; each range is walked on its own, and the ends of the
    ranges, one row each, are joined.
    """
    spark = keys.sparkSession
    ranged = keys.repartitionByRange(partitions(spark), "k").withColumn("part", F.spark_partition_id())
    stored, _ = stage(ranged)
    walk = Window.partitionBy("part").orderBy(F.desc("k"))
    ends = stored.groupBy("part").agg(F.max("k").alias("top"))
    # A row per range.
    down = Window.orderBy(F.desc("part"))
    over = ends.withColumn("below", F.lead("top").over(down)).select("part", "below")
    top = stored.agg(F.max("k").alias("top")).first()["top"]
    return (
        stored.withColumn("next_k", F.lead("k").over(walk))
        .join(over, "part")
        .select("k", F.coalesce("next_k", "below", F.lit(top)).alias("next_k"))
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``, the fingerprints as arrays.  The next document has the next lower
    ``doc_id``; after the least comes the greatest, and a single document is its own next.
    A null id counts as the least of all.  Of rows that share an id, the least text is the
    one that others see as next.  Null texts are empty.
    """
    no_id = F.lit(-(1 << 63)).cast("long")
    # Two columns only, so that both joins below share one shuffle of the texts.
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("k"), text_of().alias("text"))
    terms, n_terms = lexicon(keyed.select("text"))
    ids = keyed.groupBy("k").agg(F.max(F.length("text").cast("long")).alias("n_chars"))
    order, _ = stage(next_ids(ids.select("k")).join(ids, "k"))
    # What the document before needs of this one's beginning.
    wanted = order.select(F.col("next_k").alias("k"), F.col("k").alias("for_k"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    heads = (
        keyed.join(wanted, "k")
        .select(F.col("for_k").alias("k"), F.expr("left(text, need)").alias("head"))
        .groupBy("k")
        .agg(F.min("head").alias("head"))
    )
    n_chars = F.length("text").cast("long")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("head", half))
    both = keyed.join(heads, "k").join(wanted.select("k", "for_k"), "k")
    both = both.select("k", "for_k", n_chars.alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    made, _ = stage(fingerprints(both, "k", {"text": "fingerprint", "edited": "edited_fingerprint"}, terms, n_terms))
    firsts = made.groupBy(F.col("for_k").alias("k")).agg(F.min("fingerprint").alias("next_fingerprint"))
    return made.join(firsts, "k").select(
        F.when(F.col("k") != no_id, F.col("k")).alias("doc_id"),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
