"""The ten queries against plain versions, on ordinary and odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
from freshet.llm import bpe, queries
from freshet.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(params=["small", "odd"])
def folder(request, odd):
    return SMALL if request.param == "small" else odd


def result(spark, name, folder):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert result(spark, name, empty) == []


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [
        (d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in brute.rows(folder, "documents", "doc_id", "text")
    ]
    pieces = result(spark, "op1_packing", folder)
    # Each id of each document lies in one piece; documents with one id are told apart by what they hold.
    wanted = Counter((d, len(x)) for d, x in ids)
    covered = defaultdict(int)
    for doc_id, _, length, _, doc_tokens, _, _ in pieces:
        covered[doc_id, doc_tokens] += length
    assert covered == {k: n * k[1] for k, n in wanted.items()}
    held = defaultdict(list)
    for d, x in ids:
        held[d, len(x)].append(x)
    for doc_id, start, length, crc, doc_tokens, _, _ in pieces:
        sums = {zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[start : start + length])) for x in held[doc_id, doc_tokens]}
        assert crc in sums and length > 0
    sequences = defaultdict(list)
    for piece in pieces:
        sequences[piece[5]].append((piece[6], piece[2]))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert total == sum(len(x) for _, x in ids) and padding == 0


def test_rules_base(spark, folder):
    got = sorted(((r[0], *r[1:7]) for r in result(spark, "op2_quality_rules", folder)), key=str)
    assert got == sorted(((d, *brute.rule_counts(t)) for d, t in brute.rows(folder, "documents", "doc_id", "text")), key=str)
    assert all(not (r[6] and r[8]) for r in result(spark, "op2_quality_rules", folder))


@pytest.mark.parametrize("name,verdict", [("op2_quality_rules", 8), ("op3_quality_classifier", 3)])
def test_verdicts_fit_labels(spark, name, verdict):
    folder = "/root/testdata/sf0.01"
    labels = dict(brute.rows(folder, "labels", "doc_id", "quality"))
    rows = [r for r in result(spark, name, folder) if r[0] in labels]
    if verdict == 3:
        rows = [r for r in rows if r[1]]
        assert all(0 <= r[2] <= 1 for r in rows)
    else:
        rows = [r for r in rows if not r[6]]
    right = sum(bool(r[verdict]) == bool(labels[r[0]]) for r in rows)
    assert right >= 0.9 * len(rows)
    clean = [r for r in rows if labels[r[0]]]
    assert sum(bool(r[verdict]) for r in clean) >= 0.95 * len(clean)


def test_classifier_rows(spark, folder):
    got = result(spark, "op3_quality_classifier", folder)
    docs = brute.rows(folder, "documents", "doc_id", "text")
    assert sorted((r[:2] for r in got), key=str) == sorted(((d, brute.remainder(d, 3) == 1) for d, _ in docs), key=str)
    assert all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for r in got)


def test_fingerprints(spark, folder):
    docs = brute.rows(folder, "documents", "doc_id", "text")
    no_id = -(1 << 63)
    texts = defaultdict(list)
    for d, t in docs:
        texts[no_id if d is None else d].append(t or "")
    keys = sorted(texts, reverse=True)
    after = dict(zip(keys, [*keys[1:], keys[0]], strict=True))
    wanted = []
    for d, t in docs:
        k, t = no_id if d is None else d, t or ""
        following = min(texts[after[k]], key=lambda x: x.encode())
        n = len(t) // 2
        wanted.append((d, len(t), brute.sha(t[: len(t) - n] + following[:n])))
    got = result(spark, "op4_fingerprints", folder)
    assert sorted((r[:3] for r in got), key=str) == sorted(wanted, key=str)
    assert all(0 <= x <= 1 for r in got for x in r[5:7])
    by_text = defaultdict(set)
    same = {(d, len(t or ""), e): t or "" for (d, t), (_, _, e) in zip(docs, wanted, strict=True)}
    for r in got:
        by_text[same[r[:3]]].add(r[3])
    assert all(len(x) == 1 for x in by_text.values())
    edited, following = (sum(r[i] for r in got) / len(got) for i in (5, 6))
    assert edited > 2 * following


def test_urls(spark, folder):
    got = sorted(result(spark, "op5_url_filters", folder), key=str)
    assert got == sorted(((p, *brute.judge_url(u, URL_RULES)) for p, u in brute.rows(folder, "pages", "page_id", "url")), key=str)


def test_urls_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    sql = connection.execute(ORACLE_SQL["op5_url_filters"]).fetchall()
    assert sorted(sql, key=str) == sorted(result(spark, "op5_url_filters", SMALL), key=str)


def test_byte_bpe(spark, folder):
    encoder = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    wanted = []
    for d, t in brute.rows(folder, "documents", "doc_id", "text"):
        ids = encoder.encode_ordinary(t or "")
        wanted.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")))
    assert sorted(result(spark, "op6_byte_bpe", folder), key=str) == sorted(wanted, key=str)


def test_lm_base(spark, folder):
    docs = brute.rows(folder, "documents", "doc_id", "text")
    training = [t for d, t in docs if brute.remainder(d, 7) != 2]
    wanted = sorted(
        ((d, brute.remainder(d, 7) == 2, *w) for (d, _), w in zip(docs, brute.word_scores([t for _, t in docs], training), strict=True)),
        key=str,
    )
    got = sorted((r[:6] for r in result(spark, "op7_lm_scoring", folder)), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(got, wanted, strict=True))


def test_lm_gains_on_words(spark):
    rows = [r for r in result(spark, "op7_lm_scoring", "/root/testdata/sf0.1") if r[1]]
    assert sum(r[6] for r in rows) > sum(r[5] for r in rows)


def test_personal_data(spark, folder):
    got = sorted(result(spark, "op8_personal_data", folder), key=str)
    wanted = []
    for d, t in brute.rows(folder, "documents", "doc_id", "text"):
        spans = brute.base_spans(t)
        counts = Counter(k for _, k, _ in spans)
        wanted.append((d, *(counts[k] for k in range(4)), brute.sha(brute.digest(spans)), brute.digest(spans)))
    wanted.sort(key=str)
    assert [r[:6] for r in got] == [r[:6] for r in wanted]
    for r, w in zip(got, wanted, strict=True):
        assert set(filter(None, w[6].split(","))) <= set(filter(None, r[6].split(",")))


def test_simhash(spark, folder):
    docs = brute.rows(folder, "documents", "doc_id", "text")
    made = [(d, brute.simhash(t)) for d, t in docs]
    roots = brute.components({f for _, f in made})
    least = {}
    for d, f in made:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    wanted = sorted(((d, f"{f:016x}", least.get(roots[f])) for d, f in made), key=str)
    assert sorted(result(spark, "op9_simhash", folder), key=str) == wanted


def test_token_counts(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = []
    for d, t in brute.rows(folder, "documents", "doc_id", "text"):
        n = len(model.encode(t or ""))
        wanted.append((d, len((t or "").encode()), n, n > 4096))
    assert sorted(result(spark, "op10_token_counts", folder), key=str) == sorted(wanted, key=str)


def test_queries_read_whole_tables(spark):
    n = len(brute.rows(SMALL, "documents", "doc_id"))
    for name in ("op2_quality_rules", "op9_simhash"):
        assert queries.QUERIES[name](spark, SMALL).count() == n
