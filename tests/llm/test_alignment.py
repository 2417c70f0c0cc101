"""Fragments against a plain alignment from the two named libraries, and the algebra they have to obey."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from deskweave.llm import alignment, bpe, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    pytest.importorskip("public_tokenizers")
    with open(bpe.vocabulary_path(), "rb") as ranks, open(pieces.model_path(), "rb") as model:
        return ranks.read(), model.read()


@pytest.fixture(scope="module")
def aligner(files):
    return alignment.Aligner(*files)


@pytest.fixture(scope="module")
def plain(files):
    """Groups and links of one text, token by token."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers
    import sentencepiece
    from tokenizers import pre_tokenizers

    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    assert set(of_char) == set(pre_tokenizers.ByteLevel.alphabet())

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def result(text):
        if not text:
            return [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        pieces_a = [bytes(of_char[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces_b = [bytes_b(i) for i in ids_b]
        if not b"".join(pieces_a) == b"".join(pieces_b) == (" " + text).encode():
            return [], []
        ranges = []
        for ids, parts in ((ids_a, pieces_a), (ids_b, pieces_b)):
            at = 0
            ranges.append([])
            for i, part in zip(ids, parts):
                ranges[-1].append((i, at, at + len(part)))
                at += len(part)
        common = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, at = [], [0, 0]
        for c in common:
            group = ([], [])
            for n, side in enumerate(ranges):
                while at[n] < len(side) and side[at[n]][2] <= c:
                    group[n].append(side[at[n]][0])
                    at[n] += 1
            groups.append(group)
        links, j = [], 0
        for i, s, e in ranges[0]:
            while j and ranges[1][j][1] >= s:
                j -= 1
            while ranges[1][j][2] <= s:
                j += 1
            k = j
            while k < len(ranges[1]) and ranges[1][k][1] < e:
                links.append((i, ranges[1][k][0]))
                k += 1
        return groups, links

    return result


def expected(rows, plain):
    found = [(key, *plain(text)) for key, text in rows]
    counts = Counter(p for _, _, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for key, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((str(key), sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_digests_equal_plain(spark, plain, monkeypatch, with_clashes):
    random.seed(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1001, None), (1002, ""), (1003, " "), (1004, "a▁b"), (1005, "<s>x</s> <|endoftext|> <0x41>"), (1006, "\U0001f999 日本語 é" * 20),
             (1007, "\n\n  x \t y" * 30), (None, "no key"), (1008, rows[0][1]), (1008, rows[0][1]), (1009, " \n " * 500)]
    rows += [(2000 + i, "".join(random.choices(["in", "the", " ", "  ", "é", "日", "ing", "\n", "7", "'s"], k=50))) for i in range(40)]
    want = expected(rows, plain)
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(alignment.digests(df)) == want
    # Nearly all texts as trees of spans, fragments of a few bytes, and nearly all counts by the join.
    monkeypatch.setattr(alignment, "SPAN", 40)
    monkeypatch.setattr(alignment, "CHUNK", 7)
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment.with_counts, "__defaults__", (50,))
    assert got(alignment.digests(df)) == want


def test_composition_is_associative(aligner):
    random.seed(9)
    for _ in range(40):
        data = (" " + "".join(random.choices(["in", "the", " ", "é", "日", "ing", "\n", "7", "tion"], k=60))).encode()
        (a,), (b,) = aligner.encoded([data])
        ends_a, ends_b = aligner.ends(a, b)
        borders = sorted(random.sample(range(1, len(data)), 9)) + [len(data)]
        parts, low_a, low_b = [], 0, 0
        for border in borders:
            to_a, to_b = int(np.searchsorted(ends_a, border, "right")), int(np.searchsorted(ends_b, border, "right"))
            parts.append(aligner.fragment(a[low_a:to_a], b[low_b:to_b], ends_a[low_a:to_a], ends_b[low_b:to_b]))
            low_a, low_b = to_a, to_b

        def any_order(some):
            if len(some) < 2:
                return some[0]
            k = random.randrange(1, len(some))
            return aligner.compose(any_order(some[:k]), any_order(some[k:]))

        def shown(f):
            return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(f).items()}

        one = shown(aligner.of_texts([data])[0])
        assert all(shown(aligner.whole(any_order(parts))) == one for _ in range(5))
        neutral = alignment.Fragment()
        assert shown(aligner.compose(neutral, parts[3])) == shown(parts[3]) == shown(aligner.compose(parts[3], neutral))


def test_long_texts(spark, plain):
    rows = [(1, "a long text of words, 1234 of them " * 12_000), (2, "日本語" * 60_000), (3, "x" * 70_000 + " " + "y" * 70_000), (4, " " * 120_000 + "end")]
    assert got(alignment.digests(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows, plain)


def test_empty_table(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_times_and_pairs_pack():
    pairs, times = np.array([0, 3, 70_000, 1_600_000_000]), np.array([1, 255, 254, 1_000_000])
    a, b = alignment.pairs_of(alignment._packed_pairs(pairs), alignment._packed_times(times))
    assert a.tolist() == pairs.tolist() and b.tolist() == times.tolist()
