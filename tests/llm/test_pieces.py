"""The piece agenda against the library it has to equal, and its odd inputs."""

import hashlib
import random

import pytest

from deskweave.llm import pieces

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", " a", "a  b\n\tc", "▁a▁ b", "\x00x", "<s>hi</s><unk>", "<0x41>", "é é ﬁ Ａ", "a​b", " " * 40 + "x", "﻿a", "\U0001f999" * 50,
       "日本語" * 100, " " * 1000, "ab" * 5000, "x" * 3000, " \n " * 100, "▁" * 77, "the " * 300, "http://www.example.com/abc?d=efghijklmnopqrstuvwxyz0123456789" * 5]


@pytest.fixture(scope="module")
def coder():
    pytest.importorskip("sentencepiece")
    with open(pieces.model_path(), "rb") as file:
        return pieces.Pieces.of(file.read())


def mixed_texts(n):
    random.seed(3)
    parts = ["a", "e", "t", "h", " ", "  ", "in", "the", "▁", "é", "日", "\n", "1", "23", "<s>", "\U0001f999", "ing", "tion"]
    return ["".join(random.choices(parts, k=random.randrange(60))) for _ in range(n)]


def test_agenda_equals_library(coder, monkeypatch):
    texts = ODD + mixed_texts(800)
    expected = coder.library.encode(texts)
    assert [i.tolist() for i in coder.encode(texts)] == expected
    assert [coder.decode(i) for i in coder.encode(texts)] == coder.library.decode(expected)
    monkeypatch.setattr(pieces, "WIDTHS", (2, 3))  # nearly all words by heap
    assert [i.tolist() for i in coder.encode(texts)] == expected
    monkeypatch.setattr(pieces, "STEP", 16)  # nearly all texts in several spans
    monkeypatch.setattr(coder, "spans", lambda data: pieces.cut_spans(data, 16))
    assert [i.tolist() for i in coder.encode(texts)] == expected


def test_long_words_and_texts(coder):
    texts = ["ab" * 100_000, " " * 300_000, "word and word " * 300_000, "日" * 100_000]
    assert [i.tolist() for i in coder.encode(texts)] == coder.library.encode(texts)


def test_one_pair_at_a_time(coder):
    """A plain agenda: look for the best pair of the whole text again after every merge."""
    ids = {coder.library.id_to_piece(i): i for i in range(coder.size) if not (coder.library.is_byte(i) or coder.library.is_control(i) or coder.library.is_unknown(i))}

    def plain(text):
        symbols = list(f" {text}".replace(" ", pieces.SPACE)) if text else []
        while True:
            joined = [(-coder.library.get_score(ids[a + b]), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ids]
            if not joined:
                break
            _, k = min(joined)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        out = []
        for s in symbols:
            out += [ids[s]] if s in ids else [int(coder.byte_id[b]) for b in s.encode()]
        return out

    texts = [*mixed_texts(100), "      a    b", "the thing in there"]
    assert [i.tolist() for i in coder.encode(texts)] == [plain(t) for t in texts]


def test_query_shape_and_odd_rows(spark, coder, with_clashes):
    rows = [(1, None), (2, ""), (3, "one text twice"), (3, "one text twice"), (None, "no key"), (4, "long text " * 200_000), (5, " ")]
    got = pieces.digests(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows) and all(r["agrees"] for r in got)

    def expected(text):
        ids = coder.library.encode(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()

    want = sorted((str(k), *expected(t)) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert pieces.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_agree(spark, coder):
    got = pieces.op12_piece_agenda(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r["agrees"] for r in got)
    assert all(r["n_tokens"] == len(coder.library.encode(texts[r["doc_id"]] or "")) for r in got)
