"""Operators on small made cases: what the queries on sample tables do not show."""

import random
from collections import Counter
import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import bpe, gbt, imatch, packing, pii, ppm, rules, simhash, urls
from freshet.session import stage


def test_nnls_matches_a_known_solution():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, x = rng.random((12, 8)), rng.random(8) * (rng.random(8) < 0.6)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    # The unconstrained solution has a negative part here.
    assert np.allclose(packing.nnls(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, -1.0])), [1.0, 0.0])


def test_counts_never_exceed_the_histogram():
    rng = np.random.default_rng(2)
    patterns = packing.combinations()
    for _ in range(5):
        histogram = np.bincount(rng.integers(1, 128, 500), minlength=128)
        used = np.zeros(128, int)
        for pattern, n in packing.solve_counts(histogram, patterns):
            for c in pattern:
                used[c] += n
        assert (used <= histogram).all() and used.sum() > 0.5 * histogram.sum()


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_plan_covers_each_token_once(spark, block_rows):
    rng = np.random.default_rng(3)
    sizes = [1, 4095, 4096, 4097, 31, 32, 20_000, *map(int, rng.integers(1, 6000, 300)), *[700] * 200]
    lengths, _ = stage(spark.createDataFrame(list(enumerate(sizes)), "uid long, n long"))
    pieces = packing.plan_pieces(lengths, block_rows=block_rows).collect()
    cover = [np.zeros(n, int) for n in sizes]
    windows = {}
    for uid, start, length, sequence, offset in pieces:
        cover[uid][start : start + length] += 1
        windows.setdefault(sequence, []).append((offset, length))
    assert all((c == 1).all() for c in cover)
    for parts in windows.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0


def test_rules_find_planted_conditions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = ["word%d" % x for x in rng.integers(0, 500, 80)]
        if bad:
            words = [w + ("###" if i % 8 else "!!!") for w in words]
        rows.append((i, " ".join(words), int(not bad)))
    made = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = made.select("doc_id", "text"), made.select("doc_id", "quality")
    learned = rules.fit_rules(docs, labels)
    kept = {r["doc_id"] for r in rules.quality_rules(docs, labels).collect()}
    assert 1 <= len(learned) <= 3
    assert kept == {i for i, _, good in rows if good}


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40)], "doc_id long, text string")
    assert rules.fit_rules(docs, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_trees_learn_and_walk():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = gbt.fit_trees(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        raw = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(trees.scores(x[2000:2050]), [walk(r) for r in x[2000:2050]])
    assert gbt.fit_trees(np.empty((0, 4)), np.empty(0)).scores(x[:2]).tolist() == [0.5, 0.5]


def test_nested_rules_and_many_hosts(spark):
    rng = np.random.default_rng(6)
    labels = ["a", "b", "c", "com", "x-y"]
    given = {}
    for _ in range(60):
        host = ".".join(rng.choice(labels, rng.integers(1, 4)))
        given[host, str(rng.choice(["/", "/p/", "/p/q"]))] = str(rng.choice(["allow", "block"]))
    listed = [urls.UrlRule(h, p, v) for (h, p), v in given.items()]
    pages = [
        (i, "http://" + ".".join(rng.choice(labels, rng.integers(1, 6))) + str(rng.choice(["/", "/p/", "/p/q/r", "", "?x"])))
        for i in range(800)
    ]
    judged = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), listed)
    size = lambda r: (len(r.host + r.path), len(r.host))
    for page_id, url, host, path, rule, verdict in judged.select("page_id", "url", "judged.*").collect():
        fits = [r for r in listed if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(map(size, fits), default=None)
        among = {(r.host + r.path, r.verdict) for r in fits if size(r) == best}
        assert (rule, verdict) in among if fits else (rule, verdict) == (None, "allow"), url
    assert urls.filter_urls(spark.createDataFrame(pages[:1], "page_id long, url string"), []).first()["judged"]["rule"] is None


def test_chunks_meet_at_true_boundaries():
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = np.random.default_rng(7)
    encoder = bpe.encoding(path, pattern)
    for alphabet in ("ab \n", "a'sl1 \t.", "x", " \n", "é中 '"):
        text = "".join(rng.choice(list(alphabet), 2000))
        pieces = bpe.stitched(text, pattern, chunk=40, overlap=12)
        assert "".join(pieces) == text
        assert bpe.encode_text(text, path, pattern, 40, 12).tolist() == encoder.encode_ordinary(text)


@pytest.mark.parametrize("order,nodes", [(2, 1 << 30), (3, 40), (2, 12)])
def test_ppm_matches_plain_counting(spark, order, nodes):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abAB c"), n)) for n in rng.integers(0, 30, 40)]
    training = spark.createDataFrame([(t,) for t in texts[:30]] + [(None,)], "text string")
    model = ppm.train(training, order, nodes)
    every = [*texts, "zé!", "", None]
    rows = spark.createDataFrame(list(enumerate(every)), "i long, text string")
    got = {r["i"]: r["score"] for r in ppm.score(rows, model, "score").collect()}
    assert np.allclose([got[i] for i in range(len(every))], brute.ppm(every, [*texts[:30], None], order, nodes))


@pytest.mark.parametrize("order,nodes,step", [(2, 4, 1 << 20), (5, 12, 1 << 20), (4, 1 << 20, 1 << 20), (5, 1, 40)])
def test_ppm_keeps_all_windows(spark, monkeypatch, order, nodes, step):
    monkeypatch.setattr(ppm, "TASK_WINDOWS", step)
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("abAB c"), n)) for n in rng.integers(0, 30, 40)]
    training = spark.createDataFrame([(t,) for t in texts[:30]] + [(None,)], "text string")
    corpus = ppm.learn(training, order, nodes)
    every = [*texts, "zé!", "", None, *["xyzzy"] * 200]
    rows = spark.createDataFrame(list(enumerate(every)), "i long, text string")
    scored = ppm.settle(ppm.meet(rows, corpus, "score", "rare"), corpus, "score", "rare")
    assert scored.columns == ["i", "text", "score"]
    got = {r["i"]: r["score"] for r in scored.collect()}
    # No window is left out, however few are at hand.
    assert np.allclose([got[i] for i in range(len(every))], brute.ppm(every, [*texts[:30], None], order, 1 << 60))


def test_ppm_scores_do_not_lose_rare_windows_to_size(spark):
    passage = "qzx wvk jqy"
    common = spark.createDataFrame([("the same plain words again " * 40,)] * 200, "text string")
    training = common.union(spark.createDataFrame([(passage,)] * 3, "text string"))
    rows = spark.createDataFrame([(passage,)], "text string")
    corpus = ppm.learn(training, nodes=1 << 12)
    score = ppm.settle(ppm.meet(rows, corpus, "score", "rare"), corpus, "score", "rare").first()["score"]
    pruned = ppm.score(rows, ppm.train(training, nodes=1 << 12), "score").first()["score"]
    # The words come three times in the corpus: after their start each next symbol is known.
    assert score > pruned / 2 and score > -6


def test_ppm_probabilities_add_up():
    texts = pa.array(["abab", "aba", "bcab"])
    symbols, ends = ppm.framed(texts, 2)
    codes = ppm.windows(symbols, 2)
    codes = codes[ppm._starts_inside(codes, ends, 2)]
    levels = [np.unique(codes & ((1 << 9 * (k + 1)) - 1), return_counts=True) for k in range(3)]
    model = ppm.build(levels)
    for context in ((256, 256), (97, 98), (256, 97), (99, 97), (120, 121), (98, 98)):
        windows = np.array([(context[0] << 18) + (context[1] << 9) + s for s in range(257)])
        assert np.isclose((10 ** model.log10(windows)).sum(), 1)


@pytest.mark.parametrize("near", [False, True])
def test_large_groups_of_copies_keep_graded_fingerprints(spark, near):
    rng = np.random.default_rng(11)
    base = [f"base{x}" for x in range(150)]
    rows = []
    for i in range(300):
        words = list(base) if i % 3 == 0 else [f"w{x}" for x in rng.integers(0, 3000, 150)]
        if near and i % 3 == 0:
            words[int(rng.integers(0, 75))] = f"w{i}"
        rows.append((i, " ".join(words)))
    made = imatch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    grouped = [r for r in made if r["doc_id"] % 3 == 0]
    # Half of each text is replaced.
    assert sum(r["near_edited"] > 0 for r in grouped) >= 0.9 * len(grouped)


def test_only_near_copies_count_as_one_document(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(3000)]
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"))
    in_order = [r["w"] for r in hashes.orderBy("h").collect()]
    low, others = in_order[:4], in_order[4:]
    # Ten texts that share their four least hashes and little else, and a hundred near copies of one more.
    apart = [[*low, *others[i * 100 : i * 100 + 80]] for i in range(10)]
    base = others[2000:2100]
    near = [[*low, *(w for j, w in enumerate(base) if j != i)] for i in rng.integers(0, 100, 100)]
    docs = spark.createDataFrame([(" ".join(t),) for t in [*apart, *near, apart[0]]], "text string")
    assert {r["text"].split()[4] for r in imatch._without_near_copies(docs).collect()} >= {t[4] for t in apart}
    assert imatch._without_near_copies(docs).count() <= 12
    terms, n = imatch.lexicon(docs, 0.05, 0.5)
    got = {r["term"] for r in terms.collect()}
    assert n == len(got) and got >= {w for t in apart for w in t[4:]} and not got & set(low)


def test_texts_without_band_terms_are_graded(spark):
    text = [f"only{x}" for x in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:99], "else"])), (3, "..."), (4, "???")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "term string, id long, member long")
    got = imatch.fingerprints(docs.repartition("doc_id"), "doc_id", {"text": "fp"}, none, 0)
    fp = {r["doc_id"]: r["fp"] for r in got.collect()}
    a, b = (F.array(*map(F.lit, fp[i])) for i in (1, 2))
    alike = spark.range(1).select(imatch.likeness(a, b).alias("x")).first()["x"]
    assert 0.5 < alike < 1 and fp[3] != fp[4]


def test_contexts_give_identifiers_away(spark):
    rows = [(i, f"word{i} my phone number is +1 (452) 555-{1000 + i} thanks a lot word{i}") for i in range(20)]
    rows += [(100, "so my phone number is 0452-5551234 thanks a lot again"), (101, "there were 0452-5559999 cells in it")]
    rows += [(102, "it said my phone number is v2x thanks a lot again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(docs)).collect()}
    at = rows[20][1].index("0452")
    assert found[100] == f"phone:{at}:{at + 12}" and found[101] == "" and found[102] == ""
    assert all(found[i] == brute.digest(brute.base_spans(t)) for i, t in rows[:20])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[100] == "so my phone number is [PHONE] thanks a lot again" and clean[101] == rows[21][1]
    assert clean[0] == "word0 my phone number is [PHONE] thanks a lot word0"


def test_contexts_see_other_numbers_and_runs_of_digits(spark):
    rows = [(i, f"word{i} in room 12 phone +1 (452) 555-{1000 + i} thanks a lot") for i in range(20)]
    rows += [(100, "in room 12 phone 0452-5551234 thanks a lot"), (101, "in room 12 phone 0452 555 7777 thanks a lot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(docs)).collect()}
    at = rows[20][1].index("0452")
    assert f"phone:{at}:{at + 12}" in found[100].split(",") and f"phone:{at}:{at + 13}" in found[101].split(",")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[100].endswith("phone [PHONE] thanks a lot") and clean[101].endswith("phone [PHONE] thanks a lot")


def test_found_identifiers_give_new_patterns(spark):
    rows = [(i, f"word{i} my phone number is +1 (452) 555-{1000 + i} thanks a lot word{i}") for i in range(20)]
    new = [f"0452-555{2000 + i}" for i in range(20)]
    # Their own context makes them known, and the other one with them; no seed has that.
    rows += [(100 + i, f"so my phone number is {x} thanks a lot again") for i, x in enumerate(new)]
    rows += [(200 + i, f"please ring the desk {x} before noon today word{i}") for i, x in enumerate(new)]
    rows += [(300, "please ring the desk 0452-5559999 before noon today alone"), (301, "there were 0452-5558888 cells in it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(docs)).collect()}
    at = rows[-2][1].index("0452")
    assert found[300] == f"phone:{at}:{at + 12}" and found[301] == ""
    assert all(found[i] for i in [*range(100, 120), *range(200, 220)])


def test_copies_beside_a_context_count_once(spark):
    rows = [(i, f"word{i} my phone number is +1 (452) 555-{1000 + i} thanks a lot word{i}") for i in range(20)]
    rows += [(100, "so my phone number is 0452-5551234 thanks a lot again")]
    rows += [(200 + i, "then my phone number is v2x thanks a lot again") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(docs)).collect()}
    at = rows[20][1].index("0452")
    assert found[100] == f"phone:{at}:{at + 12}" and not any(found[200 + i] for i in range(60))


def test_dates_versions_and_amounts_are_no_phones(spark):
    rows = [(i, f"word{i} call us on +1 (452) 555-{1000 + i} before the evening word{i}") for i in range(30)]
    clean = ["2024-01-15", "12.05.2024", "1/15/2024", "20240115", "20240115-123456", "2010-2015", "2024-01-15 12", "1234567.89"]
    clean += ["1.234.567", "10.15.7.2021", "123 456 789"]
    rows += [(100 + i, f"please call us on {x} before the evening") for i, x in enumerate(clean)]
    phones = ["0452-5551234", "0452 555 1235", "(452) 555-1236", "452.555.1237", "4525551238"]
    rows += [(200 + i, f"please call us on {x} before the evening") for i, x in enumerate(phones)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(docs)).collect()}
    assert not any("phone" in found[100 + i] for i in range(len(clean)))
    assert all("phone" in found[200 + i] for i in range(len(phones)))


def test_contexts_are_whole_words_however_long(spark):
    long, gap = "x" * 500, " " * 300
    rows = [(i, f"word{i} my {long}{gap}+1 (452) 555-{1000 + i}{gap}thanks {long}") for i in range(20)]
    rows += [(100, f"so my {long}{gap}0452-5551234{gap}thanks {long}"), (101, f"so my {long}y 0452-5551235 thanks {long}y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(docs)).collect()}
    at = rows[20][1].index("0452")
    assert found[100] == f"phone:{at}:{at + 12}" and found[101] == ""


def test_hot_contexts_and_identifiers_are_parted(spark, monkeypatch):
    rows = [(i, f"word{i} my phone number is +1 (452) 555-{1000 + i} thanks a lot word{i}") for i in range(20)]
    rows += [(100 + i, f"said{i} my phone number is 0452-5551234 thanks a lot") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, pii.report(pii.personal_data(docs)).collect()))
    monkeypatch.setattr("freshet.operators.skew.ROWS_PER_TASK", 3)
    assert plain == sorted(map(tuple, pii.report(pii.personal_data(docs)).collect()))
    assert all(r[-1] for r in plain)


def test_redaction_merges_overlaps_and_keeps_rows(spark):
    rows = [(1, "a@b.cc 1.2.3.4 x", 16, 7), (1, "a@b.cc 1.2.3.4 x", 16, 7), (2, None, 0, 8), (None, "1.2.3.4@x.yy", 12, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, uid long")
    got = sorted((tuple(r) for r in pii.redact(docs).collect()), key=str)
    wanted = [(1, "[EMAIL] [IP] x", 14, 7)] * 2 + [(2, None, 0, 8), (None, "[EMAIL]", 7, 9)]
    assert got == sorted(wanted, key=str)


def test_links_join_what_is_near(spark):
    rng = np.random.default_rng(9)
    values = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    for v in values[:40]:
        for _ in range(6):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted({v & (1 << 64) - 1 for v in values})
    assert {frozenset(x) for x in simhash.spanning_links(np.array(values, np.uint64), 2)} <= {
        frozenset((a, b)) for a in values for b in values if (a ^ b).bit_count() <= 2
    }
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    wanted, got = {}, {}
    for v, s in zip(values, signed, strict=True):
        got.setdefault(roots.get(s, s), set()).add(v)
    for v, r in brute.components(values).items():
        wanted.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[1001] == roots[1000] == 1000


def test_deduplicate_keeps_one_row_of_each_group(spark):
    text = "the quick brown fox jumps over the lazy dog " * 5
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (None, text, "c"), (9, "", "d"), (8, None, "e"), (7, "other words here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("_uid", F.lit(1))
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["fp"]) for r in got.collect()) == [(2, "b"), (7, "f"), (8, "e")]


def test_counting_windows_holds_little(spark, monkeypatch):
    """A worker's memory while it counts: 8 MB of text in one batch, most windows distinct."""
    import tracemalloc

    kept = []
    with monkeypatch.context() as patched:
        patched.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, _: kept.append(run) or self.selectExpr("0L AS window", "0L AS n"))
        ppm.count_windows(spark.createDataFrame([("a",)], "text string"))
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefghijklmnop ", k=200_000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        counted = sum(made.column(1).to_numpy().sum() for made in kept[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counted == sum(len(t) + 1 for t in texts)
    assert peak < 70e6, peak


@pytest.mark.parametrize("held,ranges", [(1 << 19, 128), (300, 3), (300, 300)])
def test_windows_added_up_by_ranges(spark, monkeypatch, held, ranges):
    monkeypatch.setattr(ppm, "HELD", held)
    monkeypatch.setattr(ppm, "LEAST_RANGES", ranges)
    monkeypatch.setattr(ppm, "partitions", lambda _: 1)
    draw = random.Random(11)
    texts = [None, "", *("".join(draw.choices("abcdé ", k=draw.randrange(400))) for _ in range(60))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    wanted = {(r["window"], r["n"]) for r in ppm.count_windows(rows, 4).collect()}
    got = [(r["window"], r["n"]) for r in ppm.add_windows(rows, 4).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert sum(n for _, n in got) == sum(len((t or "").encode()) + 1 for t in texts)


def test_a_window_leaves_a_task_once(spark, monkeypatch):
    """Lists that a worker has to give up while it counts are added up before they are sent."""
    kept = []
    monkeypatch.setattr(ppm, "HELD", 2000)
    with monkeypatch.context() as patched:
        empty = ("0 AS dealt", "0 AS size", "binary('') AS windows", "binary('') AS counts")
        patched.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, _: kept.append(run) or self.selectExpr(*empty))
        ppm.add_windows(spark.createDataFrame([("a",)], "text string"))
    draw = random.Random(12)
    texts = ["".join(draw.choices("abcdefgh ", k=2000)) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts]
    sent = sum(made.column("size").to_numpy().sum() for made in kept[0](iter(batches)))
    symbols = [[256] * 5 + list(t.encode()) + [256] for t in texts]
    assert sent == len({tuple(s[i : i + 6]) for s in symbols for i in range(len(s) - 5)})


@pytest.mark.parametrize("bits,texts", [(54, 900), (54, 3000), (62, 7)])
def test_entries_of_windows_and_texts(bits, texts):
    rng = np.random.default_rng(13)
    codes = rng.integers(0, 40, 5000) << (bits - 6)
    at = np.sort(rng.integers(5, texts, 5000))
    wanted = sorted((c, t, n) for (c, t), n in Counter(zip(codes.tolist(), at.tolist(), strict=True)).items())
    assert list(zip(*(x.tolist() for x in ppm.entries(codes, at, bits)), strict=True)) == wanted
    assert [len(x) for x in ppm.entries(codes[:0], at[:0], bits)] == [0, 0, 0]


def test_words_at_hand_go_up_to_their_bound(spark):
    """Few words are all at hand, however rare; then no row for a text and a word is joined."""
    texts = ["a " * 5000 + "b c", "b d e", None]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    words = ppm.train_words(training, 8)
    assert sorted(words.frequent) == ["a", "b", "c", "d", "e"]
    assert not any(r["rare"] for r in ppm.cut_words(training, words).collect())
    assert sorted(ppm.train_words(training, 3).frequent) == ["a", "b"]
    assert ppm.train_words(training.where("text = ''"), 8).frequent == {}


@pytest.mark.parametrize("frequent", [0, 3, 1 << 18])
def test_words_of_odd_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "HELD_BYTES", 64)
    texts = ["a\x0bB\x0cc\rd\ne\tf", " lead trail ", "\x1cx y\x1d", "n\u0085m \u00a0", "ÀÉ àé À", "\n \t", "", None, "a A a b"]
    every = [*texts, "a new word", "À  à"]
    rows = spark.createDataFrame(list(enumerate(every)), "i long, text string")
    words = ppm.train_words(rows.where(F.col("i") < len(texts)).select("text"), frequent)
    got = {r["i"]: (r["n_tokens"], r["n_known"], words.n_tokens, r["base_score"]) for r in ppm.base_scores(rows, words).collect()}
    for i, wanted in enumerate(brute.word_scores(every, texts)):
        assert got[i][:3] == tuple(wanted[:3]) and np.isclose(got[i][3], wanted[3], rtol=1e-12)


def test_texts_come_back_from_scoring_as_they_were(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Aé", None)], "i long, text string, other string")
    corpus = ppm.learn(rows.select("text"))
    met = ppm.meet(rows, corpus, "score", "rare")
    assert met.columns == ["i", "text", "other", "score", "rare"]
    assert sorted(met.select("i", "text", "other").collect()) == sorted(rows.collect())
