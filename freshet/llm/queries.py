"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe, counts, gbt, imatch, k2treap, packing, pii, ppm, recipes, rules, simhash, tries, urls
from freshet.llm.common import remainder_of, table, text_of
from freshet.session import stage

URL_RULES = [
    urls.UrlRule("com", "/", "allow"),
    urls.UrlRule("example.com", "/en/", "block"),
    urls.UrlRule("www.example.com", "/en/", "allow"),
    urls.UrlRule("net", "/es/", "block"),
    urls.UrlRule("net", "/fr/", "block"),
]
TOKEN_LIMIT = 4096
SEARCH_RANKS = 20


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, with a checksum of each piece's ids."""
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the decision list's verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned, "judged").select("doc_id", "judged.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document from trees that have not seen a third of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = gbt.fit_quality(docs, table(spark, sf_dir, "labels"), remainder_of(F.col("_id"), 3) != 1)
    scored = gbt.score(docs, trees, "score")
    return scored.select(
        "doc_id",
        F.coalesce(remainder_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of each text and its edited text, and how alike they are."""
    made = imatch.fingerprint_edits(table(spark, sf_dir, "documents"))
    for name in ("fingerprint", "edited_fingerprint"):
        made = made.withColumn(name, imatch.as_text(F.col(name)))
    return made


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "judged.*")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, with digests of both."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    encoded = bpe.encode(texts, path, pattern).select("doc_id", "ids")
    decoded = bpe.decode(encoded, path, pattern)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths by the byte model, beside add-one word counts, of all documents."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(remainder_of(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "text"
    )
    training = docs.where(~F.col("held_out")).select("text")
    words, corpus = ppm.train_words(training), ppm.learn(training)
    # Stored once, without the texts: what both scores still ask the corpus.
    cut, _ = stage(ppm.cut_words(ppm.meet(docs, corpus, "score", "rare"), words))
    scored = ppm.settle(ppm.add_words(cut, words), corpus, "score", "rare", source=cut.select("row.rare"))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(words.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, by rule and by context."""
    return pii.report(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    texts = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    counted = counts.count_tokens(texts, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each opened with turns of another."""
    runs = tries.turn_runs(table(spark, sf_dir, "conversations"))
    return tries.prefix_trie(tries.conversations(runs), tries.borrow_openings(runs))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and which row of it stays."""
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    index = k2treap.build(table(spark, sf_dir, "documents"))
    return k2treap.search(index, table(spark, sf_dir, "benchmark"), SEARCH_RANKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_quality_rules,
        op3_quality_classifier,
        op4_fingerprints,
        op5_url_filters,
        op6_byte_bpe,
        op7_lm_scoring,
        op8_personal_data,
        op9_simhash,
        op10_token_counts,
        op11_prefix_trie,
        op12_exact_dedup,
        op13_ranked_search,
    )
}

ORACLE_SQL = {
    "op5_url_filters": """
with rules(rule_host, rule_path, rule_verdict) as (values
    ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
    from pages),
parts as (
    select page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from rests),
fits as (
    select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
        row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as place
    from parts left join rules
        on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fits where place = 1
""",
    # crc32 by folding the bytes of the decimal id, each followed by seven zeros, bit by bit.
    "op11_prefix_trie": """
with ids as (select distinct conv_id as c from conversations where conv_id is not null),
own as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
        coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null),
crcs as (
    select c, xor(list_reduce(
        list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''),
            lambda x: list_concat([ascii(x)::bigint], list_resize([]::bigint[], 7, 0::bigint))))),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295::bigint) % 9 as h
    from ids),
lengths as (select c, count(*) as n from own group by c),
plans as (
    select crcs.c, h, crcs.c - crcs.c % 5 as lender, least(h, coalesce(n, 0)) as taken
    from crcs left join lengths on lengths.c = crcs.c - crcs.c % 5),
rebuilt as (
    select p.c, o.pos as depth, role, text from plans p join own o on o.c = p.lender and o.pos <= h
    union all
    select p.c, o.pos - h + taken, role, text from plans p join own o on o.c = p.c and o.pos > h),
paths as (
    select c, depth, strlen(text) as bytes,
        list(struct_pack(r := role, t := text)) over (partition by c order by depth) as path
    from rebuilt
    union all select c, 0, 0, [] from ids),
members as (
    select c, depth, bytes, min(c) over node as conv_id, count(*) over node as n_convs,
        depth = max(depth) over (partition by c) as ends
    from paths window node as (partition by depth, path)),
nodes as (
    select conv_id, depth, any_value(bytes) as bytes, any_value(n_convs) as n_convs,
        sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256
    from members group by conv_id, depth),
links as (
    select n.*, m.conv_id as parent_conv_id
    from nodes n left join members m on m.c = n.conv_id and m.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from links where depth > 0 group by all),
full_nodes as (select l.*, coalesce(n_children, 0) as n_children from links l left join kids using (conv_id, depth)),
sums as (
    select m.conv_id, m.depth, sum((f.n_children = 0)::bigint) as n_leaves, sum((f.n_convs - 1) * f.bytes) as saved_tokens
    from full_nodes f join members m on m.c = f.conv_id and m.depth <= f.depth group by all)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves,
    saved_tokens::bigint as saved_tokens, ends_sha256
from full_nodes join sums using (conv_id, depth)
""",
    "op12_exact_dedup": """
with texts as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
    from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    row_number() over (partition by low order by doc_id desc nulls last) = 1 as kept, sha256(low) as text_sha256
from texts window same as (partition by low)
""",
    "op13_ranked_search": r"""
with found as (
    select doc_id, text, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents),
postings as (select doc_id, term, count(*) as tf from found group by all),
lengths as (select doc_id, sum(tf) as n from postings group by doc_id),
whole as (select count(*) as n_docs, sum(n) as n_terms from lengths),
weights as (
    select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1))) as bigint) as w
    from postings, whole group by term),
impacts as (
    select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) as impact
    from postings join lengths using (doc_id) join weights using (term), whole),
asked as (
    select item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark),
scores as (
    select item_id, doc_id, cast(sum(impact) as bigint) as score
    from asked join impacts using (term) group by item_id, doc_id having sum(impact) > 0),
ranked as (
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
    from scores)
select * from ranked where rank <= 20
""",
}
