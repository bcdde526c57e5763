"""Personal data: four kinds found by rule, and more by bootstrapped contexts.

Spans found by rule are the seeds.  The words beside a seed are lexical patterns.  A
pattern is trusted as far as the identifiers in its place are trusted, an identifier as
far as the patterns around it; both are scored in turn over the graph of patterns and
identifiers.  Identifiers of the right shape that trusted patterns surround are added, and
patterns beside them count as well, until no new identifier appears.

All of it runs on built-in functions.  A match's place is the length of what stands before
it, so matches and the gaps between them become rows and places are running sums.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import GAP, fresh, hold, text_of
from freshet.operators.skew import find_hot_keys, spread_join
from freshet.session import stage

# The order of kinds at the same start.
KINDS = ("email", "ip", "card", "phone")

# Each finds the same places as the plain pattern of its kind, but a run that cannot match
# is looked at once, not from each of its characters; card looks only at runs of 14 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A word that may be an identifier: any with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# So may a run of groups of digits with blanks, dashes, dots or brackets between them.
RUN = r"(?<![^\x20\x09-\x0D])\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++)++"
GUARD = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "word": "[0-9@]", "run": r"[0-9][).]?\x20\(?[0-9]"}
CANDIDATES = ("word", "run")
# A longer word of a context goes by its hash, so that a context stays short.
LONG_WORD = 80
# A word that holds matches of a kind is put together from so many of them on either side.
GLUED = 40
# The last words of a text, read from its end: white space, two words and what stands before them.
_TAIL = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){0,2}+[^\x20\x09-\x0D]*+"
# What is glued to a span, two words after it and whether they end.
_HEAD = r"^[^\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++){0,2}+[\x20\x09-\x0D]?"
# Two whole words before a span, read from it backwards, and two after it.
_BEFORE = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)"
_AFTER = r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)"

_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"


class Trust(NamedTuple):
    """When a pattern or an identifier counts as found.

    ``rounds`` of scoring after each growth; ``seeds`` different seeds, or identifiers found
    before, that a pattern needs; ``least``, the score that a new identifier needs.
    """

    rounds: int = 2
    seeds: int = 3
    least: float = 0.8


def _luhn(digits: Column) -> Column:
    """True if the digits, from the last one on, meet the Luhn check."""
    backwards = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda x: x.cast("int"))
    doubled = F.transform(
        backwards, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", hit.rlike(rf"^(?:{_PART})(?:\.{_PART}){{3}}$"))
        .when(kind == "card", n.between(14, 19) & _luhn(digits))
        .when(kind == "phone", n.between(10, 15))
        # Without a blank it is a word.
        .when(kind == "run", hit.contains(" "))
        .otherwise(True)
    )


def _short(text: Column) -> Column:
    """The text with one blank for each gap and the hash for each long word."""
    words = F.split(text, GAP, -1)
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, F.hex(F.xxhash64(w))).otherwise(w)), " ")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Gaps and matches of one pattern, in order, as ``(kind, i, gap, hit, left, right)``."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(gaps)).alias("then")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(x["gap"]).cast("long").alias("gap"),
            x["hit"].alias("hit"),
            _short(F.reverse(F.regexp_extract(F.reverse(x["gap"]), _TAIL, 0))).alias("left"),
            _short(F.regexp_extract(x["then"], _HEAD, 0)).alias("right"),
        ),
    )
    return F.filter(found, lambda x: x["hit"].isNotNull())


def with_matches(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """Add array ``out`` of all matches of the four kinds and of candidates."""
    held = fresh(docs, "_text")
    df = hold(docs, held, text_of(text))
    patterns = {**PATTERNS, "word": CANDIDATE, "run": RUN}
    nothing = "array<struct<kind:string,i:int,gap:bigint,hit:string,left:string,right:string>>"
    parts = []
    for kind, pattern in patterns.items():
        name = fresh(df, f"_{kind}")
        made = F.when(F.col(held).rlike(GUARD[kind]), _matches(F.col(held), kind, pattern))
        df = hold(df, name, F.coalesce(made.cast(nothing), F.array().cast(nothing)))
        parts.append(name)
    return df.withColumn(out, F.concat(*parts)).drop(held, *parts)


def spans_of(rows: DataFrame) -> DataFrame:
    """``(uid, kind, start, end, hit, left, right)`` of a stored ``(uid, found)``.

    Spans of the four kinds that fail their check are dropped; so are candidates
    that share a character with a span that holds.  ``left`` and ``right`` are the two
    whole words before a span and the two after it, other matches included; they are empty
    where the text has fewer.  What is glued to a span is a word before it, and none after it.
    Words of more than ``LONG_WORD`` characters go by a hash.  A word that itself holds matches
    of the kind is seen as far as ``GLUED`` of them.
    """
    each = rows.select("uid", F.explode("found").alias("m")).select("uid", "m.*")
    size = F.length("hit").cast("long")
    row = Window.partitionBy("uid", "kind").orderBy("i")
    before = row.rowsBetween(Window.unboundedPreceding, 0)
    past = F.collect_list(F.concat("left", _short(F.col("hit")))).over(row.rowsBetween(-GLUED, -1))
    coming = F.collect_list(F.concat(_short(F.col("hit")), "right")).over(row.rowsBetween(1, GLUED))
    placed = each.select(
        "*",
        F.sum(F.col("gap") + size).over(before).alias("end"),
        F.reverse(F.regexp_extract(F.reverse(F.concat(F.array_join(past, ""), "left")), _BEFORE, 1)).alias("_left"),
        F.regexp_extract(F.concat("right", F.array_join(coming, "")), _AFTER, 1).alias("_right"),
    )
    placed = placed.withColumns({"_left": _short(F.col("_left")), "_right": _short(F.col("_right"))})
    placed = placed.withColumn("start", F.col("end") - size).drop("left", "right").withColumnsRenamed({"_left": "left", "_right": "right"})
    valid = placed.where(_valid(F.col("kind"), F.col("hit")))
    base = ~F.col("kind").isin(*CANDIDATES)
    order = Window.partitionBy("uid").orderBy("start", "end", "kind")
    earlier = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = base | ((F.coalesce(earlier <= F.col("start"), F.lit(True))) & F.coalesce(later >= F.col("end"), F.lit(True)))
    return valid.withColumn("_clear", clear).where("_clear").select("uid", "kind", "start", "end", "hit", "left", "right")


# What has the digits of a phone number and is none: dates, with the hours that may follow,
# spans of years, decimal numbers, thousands set apart, versions.
_YEAR, _MONTH, _DAY = r"(?:19|20)[0-9]{2}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])"
_BREAK = r"[./\x20-]"
NO_PHONE = "|".join(
    (
        rf"^{_YEAR}{_BREAK}{_MONTH}{_BREAK}{_DAY}(?![0-9])",
        rf"^(?:{_DAY}{_BREAK}{_MONTH}|{_MONTH}{_BREAK}{_DAY}){_BREAK}(?:{_YEAR}|[0-9]{{2}})(?![0-9])",
        r"^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?![0-9])",
        rf"^{_YEAR}{_BREAK}{_YEAR}$",
        r"^[0-9]+\.[0-9]+$",
        r"^[0-9]{1,3}(?:\.[0-9]{3})+$",
        r"^[0-9]{1,3}(?:\x20[0-9]{3})+(?:\.[0-9]+)?$",
        r"^[0-9]{1,2}(?:\.[0-9]+){2,}$",
    )
)


def _shape(core: Column) -> Column:
    """The kind whose identifiers look like this candidate; null if none do."""
    n = F.length(F.regexp_replace(core, "[^0-9]", ""))
    digits = core.rlike(r"^[0-9()+./\x20\x2D]+$")
    return (
        F.when(core.rlike(r"^[^@]+@[^@]+$"), F.lit("email"))
        .when(core.rlike(r"^[0-9]+(?:[.:][0-9]+){3}$"), F.lit("ip"))
        .when(digits & n.between(14, 19), F.lit("card"))
        .when(digits & n.between(7, 15) & ~core.rlike(NO_PHONE), F.lit("phone"))
    )


def discover(spans: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """``(uid, kind, start, end)`` of identifiers that only their contexts give away.

    Patterns are the two words before a span and the two words after it.  A pattern's
    score for a kind is the trust in what stands in its place, over all that stands there
    and one more; an identifier's is what its patterns leave of doubt, taken from one.
    An identifier counts once for each neighbourhood, that is the words on both of its sides, so
    copies of a text weigh no more than the text.  Identifiers that reach ``least`` stay
    and give new patterns; each growth is staged, and growth ends when none is new.

    Rows of a pattern or an identifier that many places share are parted for each join.
    Without seeds nothing is found.  An identifier may stand at many places of a text, and
    repeated rows are told apart by ``uid``: each place is a row of the result.  A place that
    two spans share, one beside each pattern, is one row.
    """
    core = F.regexp_replace(F.regexp_replace("hit", r"^[^0-9A-Za-z(+]++", ""), r"[^0-9A-Za-z)]++$", "")
    word = F.col("kind").isin(*CANDIDATES)
    lead = F.length(F.regexp_extract("hit", r"^[^0-9A-Za-z(+]*+", 0))
    seen = spans.select(
        "uid",
        F.when(word, core).otherwise(F.col("hit")).alias("item"),
        F.when(word, _shape(core)).otherwise(F.col("kind")).alias("kind"),
        (~word).alias("seed"),
        F.when(word, F.col("start") + lead).otherwise(F.col("start")).alias("start"),
        F.explode(
            F.array(
                F.concat(F.lit("< "), F.lower("left")),
                F.concat(F.lit("> "), F.lower("right")),
            )
        ).alias("pattern"),
        F.xxhash64(F.lower("left"), F.lower("right")).alias("around"),
    ).where("length(pattern) > 2 and item <> ''")
    # What is joined on: an identifier and a pattern, each with the kind.
    of_item, of_pattern = F.concat_ws(" ", "kind", "item"), F.concat_ws(" ", "kind", "pattern")
    stored, _ = stage(seen.withColumns({"ik": of_item, "pk": of_pattern}))
    places = stored.groupBy("pattern", "kind", "item", "ik", "pk", "around").agg(F.max("seed").alias("seed"))
    edges = places.groupBy("pattern", "kind", "item", "ik", "pk").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges, _ = stage(edges)
    # All that stands beside a pattern, whatever its kind.
    wide, _ = stage(edges.groupBy("pattern").agg(F.sum("n").alias("all")))
    edges = edges.where("kind is not null").drop("pattern")
    hot_items, hot_patterns = find_hot_keys(edges, "ik"), find_hot_keys(edges, "pk")

    def at_item(rows: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return spread_join(rows, right, "ik", how, ["pk"], hot_items)

    def at_pattern(rows: DataFrame, right: DataFrame) -> DataFrame:
        return spread_join(rows, right, "pk", "inner", ["ik"], hot_patterns)

    found, size, grown = None, 0, True
    while grown:
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        marked = at_item(edges, found, "left").withColumn("score", score) if size else edges.withColumn("score", F.col("seed").cast("double"))
        # Patterns without enough trusted identifiers do not count; few are left.
        useful = (
            marked.where("score > 0").groupBy("pk").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= trust.seeds)
            .withColumn("pattern", F.expr("substr(pk, instr(pk, ' ') + 1)"))
            .join(wide, "pattern").select("pk", "all")
        )
        graph, n = stage(at_pattern(marked, useful))
        scores = graph.groupBy("ik").agg(F.max("score").alias("score"), F.max("seed").alias("known"))
        graph = graph.drop("score")
        for _ in range(trust.rounds if n else 0):
            patterns = (
                at_item(graph, scores.select("ik", "score")).groupBy("pk")
                .agg((F.sum(F.col("n") * F.col("score")) / (F.max("all") + 1)).alias("trust"))
            )
            doubt = F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999999))))
            scored = at_pattern(graph, patterns).groupBy("ik").agg((1 - F.exp(doubt)).alias("score"), F.max("seed").alias("known"))
            scores, _ = stage(scored.withColumn("score", F.when(F.col("known"), 1.0).otherwise(F.col("score"))))
        more = scores.where(~F.col("known") & (F.col("score") >= trust.least)).select("ik", "score")
        every = found.unionByName(more) if size else more
        found, now = stage(every.groupBy("ik").agg(F.max("score").alias("score")))
        size, grown = now, now > size
    # Two rows a place at most, one for each of its patterns.
    asked = stored.where("not seed and kind is not null").select("uid", "kind", "item", "start", "ik")
    hit = spread_join(asked, found.select("ik"), "ik", "left_semi", ["uid", "start"], find_hot_keys(asked, "ik"))
    return hit.distinct().select("uid", "kind", "start", (F.col("start") + F.length("item")).alias("end"))


def _digest(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ","
    )


def find(stored: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """``(uid, base, spans)`` for rows of a stored ``(uid, found)`` that have any span.

    Both are arrays of ``(start, kind, end)``, kind by its place in ``KINDS``, sorted.
    """
    spans, _ = stage(spans_of(stored))
    base = spans.where(~F.col("kind").isin(*CANDIDATES)).select("uid", "kind", "start", "end", F.lit(True).alias("base"))
    more = discover(spans, trust).withColumn("base", F.lit(False))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    one = F.struct("start", number.alias("kind"), "end")
    return (
        base.unionByName(more)
        .groupBy("uid")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base"),
            F.sort_array(F.collect_list(one)).alias("spans"),
        )
    )


def personal_data(docs: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """Each row with ``doc_id``, ``base`` and ``spans``; see ``find``.

    A null text is empty and has none.  Rows are told apart by an own number: repeated
    rows and null ids are reported each; other columns are not read.
    """
    rows = with_matches(docs.select("doc_id", "text"), "found").select("doc_id", "found")
    stored, _ = stage(rows.withColumn("uid", F.monotonically_increasing_id()))
    found = find(stored.select("uid", "found"), trust)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return stored.select("uid", "doc_id").join(found, "uid", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the result of ``personal_data``."""

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; columns unchanged.

    Spans that overlap are replaced as one, by the kind that starts first.  ``n_chars``,
    if there is one, is the length of the new text.  Rows without spans stay as they are.
    """
    found, uid, spans = (fresh(docs, x) for x in ("_found", "_uid", "_spans"))
    stored, _ = stage(with_matches(docs, found).withColumn(uid, F.monotonically_increasing_id()))
    rows = stored.select(F.col(uid).alias("uid"), F.col(found).alias("found"))
    each = find(rows, trust).select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    # Spans that reach into the one before are merged with it.
    order = Window.partitionBy("uid").orderBy("start", "kind", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)).over(order)
    merged = (
        each.withColumn("_reach", reach)
        .withColumn("_group", group)
        .groupBy("uid", "_group")
        .agg(F.min("start").alias("start"), F.min_by("kind", F.struct("start", "kind")).alias("kind"), F.max("end").alias("end"))
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("cuts"))
        .select(F.col("uid").alias("_key"), F.col("cuts").alias(spans))
    )
    text, cuts = F.col("text"), F.col(spans)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    kept = F.transform(
        cuts,
        lambda s, i: F.concat(
            F.substring(
                text,
                (F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0) + 1).cast("int"),
                (s["start"] - F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)).cast("int"),
            ),
            F.get(names, s["kind"]),
        ),
    )
    tail = F.substring(text, (F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(text))
    cleaned = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    # Rows in which nothing was matched take no part in the join.
    matched = F.size(found) > 0
    joined = stored.where(matched).join(merged, F.col(uid) == F.col("_key"), "left")
    out = joined.withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cuts.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns).unionByName(stored.where(~matched).select(*docs.columns))
