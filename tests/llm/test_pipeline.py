"""The pipeline's rows against the same stages in plain Python, one document at a time.

What is learned is learned by the operators, from all documents; verdicts, groups, spans and ids are worked out again here.
"""

import unicodedata
import zlib
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import gbt, rules
from freshet.llm.common import remainder_of, table
from freshet.llm.stats import SHARES

SMALL = "/root/testdata/sf0.001"
NAMES = ("EMAIL", "IP", "CARD", "PHONE")


def shares(text):
    """The statistics that verdicts are learned from."""
    n, chars, symbols, dup, inside, _ = brute.rule_counts(text)
    words = brute.WORD.findall(text)
    lines = sum(bool(brute.WORD.search(x)) for x in text.split("\n"))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    marks, ends = sum(c in "!?" for c in text), text.count(".")
    digits = sum(c in "0123456789" for c in text)
    other = sum("!" <= c <= "~" and not c.isalnum() for c in text)
    parts = {
        "n_words": (n, 1), "word_length": (chars, n), "symbol_share": (symbols, chars), "dup_line_share": (dup, lines),
        "repeat_share": (inside, n), "distinct_share": (len(set(words)), n), "upper_share": (upper, chars),
        "mark_share": (marks, chars), "digit_share": (digits, chars), "line_words": (n, lines),
        "end_share": (ends, n), "other_share": (other, n),
    }
    return {k: a / b if b else 0.0 for k, (a, b) in parts.items()}


def meets(rule, stats):
    return all((stats[x.feature] > x.threshold) == x.above for x in rule)


def plain_score(trees, stats):
    raw, inner = trees.base, trees.feature.shape[1]
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < inner:
            node = 2 * node + (2 if stats[SHARES[feature[node]]] > threshold[node] else 1)
        raw += leaf[node - inner]
    return raw


def one_of_each(docs):
    made = [(d, t, brute.simhash(t)) for d, t in docs]
    roots = brute.components({f for _, _, f in made})
    best = {}
    for d, t, f in made:
        if roots[f] not in best or d < best[roots[f]][0]:
            best[roots[f]] = d, t
    return sorted(best.values())


def redacted(text):
    made, at = [], 0
    spans = brute.base_spans(text)
    while spans:
        start, kind, end = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[2])
        made += [text[at:start], f"[{NAMES[kind]}]"]
        at = end
    return "".join(made) + text[at:]


def plain_documents(spark, folder):
    """``(doc_id, text)`` as they come to the last stage."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learned = rules.fit_rules(docs, labels)
    kept = []
    for d, t in brute.rows(folder, "documents", "doc_id", "text"):
        t = t or ""
        if not brute.rule_counts(t)[5] and not any(meets(r, shares(t)) for r in learned):
            kept.append((d, t))
    trees = gbt.fit_quality(docs, labels, remainder_of(F.col("_id"), 3) != 1)
    kept = [(d, t) for d, t in kept if plain_score(trees, shares(t)) >= 0]
    return [(d, redacted(t)) for d, t in one_of_each(kept)]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_against_plain_stages(spark, odd, which):
    from tokenizers import Tokenizer

    folder = SMALL if which == "small" else odd
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in plain_documents(spark, folder)]
    # An id may come with two texts; their lengths tell them apart.
    wanted = {(d, len(x)): x for d, x in encoded}
    assert len(wanted) == len(encoded) > 20
    pieces = corpus_pipeline.run(spark, folder).select(
        "doc_id", "start", "length", F.crc32("ids").alias("crc"), "doc_tokens", "sequence_id", "offset"
    ).collect()
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == set(wanted)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = wanted[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert p.crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(wanted[d])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_keep_columns_and_rows(spark, odd):
    """Each stage by itself: the columns of documents, and only rows that were there."""
    docs = table(spark, odd, "documents")
    known = Counter(r.doc_id for r in docs.select("doc_id").collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.schema.names == docs.schema.names
        assert not Counter(r.doc_id for r in got.select("doc_id").collect()) - known


def test_classifier_rejects_what_rules_miss(spark):
    """Among documents that the rules keep, junk put back is rejected: the trees have seen junk."""
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    labels = dict(brute.rows(folder, "labels", "doc_id", "quality"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, folder)
    held_out = [d for d, q in labels.items() if q == 0 and brute.remainder(d, 3) == 1]
    junk = docs.where(F.col("doc_id").isin(held_out))
    got = {r.doc_id for r in stages["quality_classifier"](spark, kept.unionByName(junk).distinct(), folder).select("doc_id").collect()}
    clean = {r.doc_id for r in kept.select("doc_id").collect()} - set(held_out)
    assert held_out and len(got & set(held_out)) <= 0.1 * len(held_out)
    assert len(got & clean) >= 0.97 * len(clean)


def test_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
