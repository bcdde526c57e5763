"""Tables that the operators must get through: odd rows, and none at all."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
# Names that operators use for columns of their own.
CLASHING = "n_words uid row key judged fp n found ids kind s term word score _t _w _text n_tokens block".split()

ODD_TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "one",
    "two words",
    "same words same words same words same words same words",
    "A b\u0301 \u00c9COLE \u4e2d\u6587 caf\u00e9\u00a0x\u3000y \U0001f600 \x00 \ufb01 \u03a3\u03a3 \u0130",
    "<|endoftext|> <s> </s> <unk> <|startoftext|>x <0x0A> \u2581a\u2581\u2581b  c",
    "mail a.b+c@d-e.example.com,x@y.zz@q.org.. a@b a@b.c_d@e.f 1.2.3.4.5 256.1.1.1 0001.02.3.004 1.2.3",
    "+1 (452) 555-7764 +1 ( +1234567890123456 4111 1111 1111 1111 4111-1111-1111-1112 1 2 3 12345678901234567890",
    "x" * 3000 + " " + "9" * 3000 + " " + "a.b" * 2000 + "@",
    "line\nline\n\n \nline\nother line\nother line\r\n",
    "The end. " * 9000,
    "'s don't we'll ''s !!\n\n\nx   y\n z \t\t " * 20,
]


def _write(folder, docs, labels, pages, items=(), turns=()):
    os.makedirs(folder)
    items, turns = list(zip(*items, strict=True)) or [[], []], list(zip(*turns, strict=True)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    item_columns = {"item_id": pa.array(items[0], pa.int64()), "text": pa.array(items[1], pa.string())}
    pq.write_table(pa.table(item_columns), f"{folder}/benchmark.parquet")
    turn_columns = [pa.array(c, k) for c, k in zip(turns, kinds, strict=True)]
    pq.write_table(pa.table(turn_columns, ["conv_id", "turn", "role", "text"]), f"{folder}/conversations.parquet")
    pq.write_table(docs, f"{folder}/documents.parquet")
    pq.write_table(labels, f"{folder}/labels.parquet")
    pq.write_table(pages, f"{folder}/pages.parquet")
    return folder


def _documents(ids, texts):
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "text": pa.array(texts, pa.string()),
        "lang": pa.array([None] * len(ids), pa.string()),
        "source": pa.array(["s"] * len(ids), pa.string()),
        "n_chars": pa.array([len(x or "") for x in texts], pa.int64()),
    }
    return pa.table(columns | {c: pa.array(range(len(ids)), pa.int64()) for c in CLASHING})


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Odd texts among ordinary ones; ids and rows that repeat, ids that are null."""
    plain = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    ids = [*range(1000, 1000 + len(ODD_TEXTS)), 1003, 1003, None, None, *plain["doc_id"][:150], 5]
    texts = [*ODD_TEXTS, "one", "one", "no id", None, *plain["text"][:150], plain["text"][7]]
    known = pq.read_table(f"{SMALL}/labels.parquet").to_pydict()
    labels = pa.table(
        {
            "doc_id": pa.array([*known["doc_id"], known["doc_id"][0], None, 1003], pa.int64()),
            "quality": pa.array([*known["quality"], 1, 1, None], pa.int32()),
            "toxic": pa.array([*known["toxic"], None, 0, 0], pa.int32()),
        }
    )
    urls = [
        None, "", "no host", "://", "http://", "https://COM/", "http://com", "http://example.com/en/x?q#f",
        "http://www.example.com/en/", "http://a.www.example.com/en/z", "http://xexample.com/en/", "ftp://example.com./en/",
        "http://example.com/de/", "http://a.b.net/es/1", "http://net/fr/", "http://net:80/fr/", "http://u@net/es/",
        "http://example.com#/en/", "http://example.com?/en/", "x://y://example.com/en/", "http://.com/", "http://EXAMPLE.com/EN/",
        "http://example.com/en/\nb", "http://\u00c9.net/es/", "http://com-a.net/es", "http://example.com/en/", "http://example.com/en/",
    ]
    pages = pa.table(
        {
            "page_id": pa.array([*range(len(urls) - 1), 0], pa.int64()),
            "url": pa.array(urls, pa.string()),
            **{c: pa.array(range(len(urls)), pa.int64()) for c in ("host", "path", "rule", "verdict", "row", "key", "stack")},
        }
    )
    return _write(str(tmp_path_factory.mktemp("odd") / "tables"), _documents(ids, texts), labels, pages, [(1, "one two"), (None, None)], [(1, None, None, "x"), (None, 1, "a", "b")])


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    labels = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]).empty_table()
    pages = pa.schema([("page_id", pa.int64()), ("url", pa.string())]).empty_table()
    return _write(str(tmp_path_factory.mktemp("empty") / "tables"), _documents([], []), labels, pages)
