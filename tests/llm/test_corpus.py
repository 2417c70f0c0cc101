"""Each corpus operator against a plain version, and its odd inputs: nulls, empties, long texts, ties, repeats."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskweave.llm import bpe, ctw, hilbert, jaccard, language, mixing, near_vectors, toxicity, url_rules, wrappers
from deskweave.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a long text of words " * 40_000
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", None, 3), (4, "12 34 !!", "en", "s", 8), (None, "no key here at all", "en", "s", 1),
       (5, LONG, "en", "s", len(LONG)), (6, "the same text once more", "en", "s", 9), (6, "the same text once more", "en", "s", 9), (7, "the same text once more", "en", "t", 9)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, with_clashes):
    return with_clashes(spark.createDataFrame(ODD, SCHEMA))


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def test_language(spark, documents, odd):
    filters = language.fit_filters(language.training_rows(documents))
    judged = language.identify(documents, filters).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged)
    rows = {r["doc_id"]: r for r in language.identify(odd, filters).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and rows[1]["score"] == 0
    assert len(language.identify(odd, filters).collect()) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.identify(empty(spark), filters).count() == 0
    assert language.identify(odd, language.fit_filters(empty(spark))).where("lang_pred = 'und'").count() == len(ODD)
    assert language.in_known_language(odd, filters).columns == odd.columns


def test_bpe(spark, documents, odd):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))

    def expected(text):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        return len(ids), sha, hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    base = " ".join(f"word{i % 37} isn't {i}" for i in range(900))
    texts = [None, "", base, base + " tail", "head " + base, "x" * 3000, "é ü " * 500 + base, base.replace(" ", "<|endoftext|>"), base.replace(" ", "  "), "日本 語" * 400]
    texts += [r["text"] for r in documents.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(df).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != expected(t)] == []
    assert bpe.encode(odd).count() == len(ODD) and bpe.digests(empty(spark)).count() == 0


def test_toxicity(spark, odd):
    random.seed(1)
    insults, calm = ["worthless", "idiot", "scum"], ["river", "garden", "window", "music", "letter"]
    rows = []
    for i in range(600):
        words = random.choices(calm, k=30)
        toxic = i % 4 == 0
        if toxic:
            words[random.randrange(30)] = random.choice(insults)
            words[random.randrange(30)] = random.choice(["muslim", "women", "gay"])  # the group is named, the insult is what is toxic
        elif i % 13 == 0:
            words[3] = "muslim"
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, toxicity.training_labels(labels))
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) >= 0.97 * len(scored)
    # Swapping an identity term moves the score less with the penalty than without.
    loose = toxicity.fit_toxicity(docs, labels, penalty=0.0)
    pair = spark.createDataFrame([(0, "the women in the garden"), (1, "the men in the garden")], "doc_id long, text string")

    def gap(m):
        s = [math.log(r["score"] / (1 - r["score"])) for r in toxicity.score_toxicity(pair, m).orderBy("doc_id").collect()]
        return abs(s[0] - s[1])

    assert gap(model) < gap(loose)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6


def plain_components(texts):
    sets = {}
    for i, text in texts:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard(spark, documents, odd):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(12):
        base = random.choices(vocabulary, k=random.choice([1, 3, 5, 8, 50, 90]))
        for _ in range(random.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(random.randint(0, 5)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            texts.append((len(texts), " ".join(words).upper() if random.random() < 0.2 else " ".join(words)))
    texts += [(len(texts), None), (len(texts) + 1, ""), (len(texts) + 2, " \n")]
    got = jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == plain_components(texts)
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    kept = jaccard.one_per_component(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (6, 7)").count() == 1 and kept.count() == 7
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (None, 5), (200, 201)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and roots[200] == roots[201] != roots[0] and 100 not in roots


def test_mixing(spark, documents, odd):
    mixed = mixing.mix_sources(documents).collect()
    size = lambda text: len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    assert {r["doc_id"]: r["size"] for r in mixed} == {r["doc_id"]: size(r["text"]) for r in documents.collect()}
    taken, target = Counter(), {}
    for r in mixed:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    largest = max(r["size"] for r in mixed)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in mixed))
    rows = mixing.mix_sources(odd)
    assert rows.count() == len(ODD) and mixing.mix_sources(empty(spark)).count() == 0
    copies = mixing.repeated_documents(documents)
    assert copies.columns == documents.columns and copies.count() == sum(r["copies"] for r in mixed)


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.com/en/x?q", "https://www.example.com/en/", "http://example.com", "http://xexample.com/en/", "ftp://b.net/es/1#f", None, "nothing", "http://net/fr/", "http://com/a", "http://com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    rules = spark.createDataFrame([*url_rules.RULES, ("com", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")

    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_near_vectors(spark):
    random = np.random.default_rng(2)
    base = random.standard_normal((6, 12))
    vectors = np.concatenate([b + 0.08 * random.standard_normal((25, 12)) for b in base] + [random.standard_normal((60, 12))])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 12, 1), (903, [float("nan")] * 12, 1), (904, [None] * 12, 1), (905, vectors[0].tolist(), None), (906, [1.0, 2.0], 1), (None, vectors[1].tolist(), 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(table.where("vec_id is not null"), tile=16).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.arange(len(vectors))[:, None] % 2 == np.arange(len(vectors)) % 2)
    np.fill_diagonal(linked, False)
    least = np.arange(len(vectors))
    for _ in range(len(vectors)):
        least = np.minimum(least, np.where(linked, least[None, :], len(vectors)).min(1))
    assert all(got[i] == (linked[i].sum(), least[i], least[i] == i) for i in range(len(vectors)))
    assert all(got[b[0]] == (0, b[0], True) for b in bad[:-1])
    assert near_vectors.near_duplicates(table).count() == len(rows) + len(bad)
    assert near_vectors.near_duplicates(table.where("false")).count() == 0


def test_hilbert_keys_are_a_curve():
    cells = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest(spark):
    random = np.random.default_rng(3)
    vectors = random.standard_normal((3000, 24)) * random.uniform(0.5, 2, (3000, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist()), (5000, None), (5001, [0.0] * 24)], "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0")
    found = hilbert.nearest(queries, table).collect()
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    hits = 0
    for q in range(0, 3000, 20):
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in [r["vec_id"] for r in mine]
        assert all(abs(r["score"] - scores[q, r["vec_id"]]) < 1e-9 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-scores[q])[:20].tolist()))
    assert hits >= 0.9 * len(range(0, 3000, 20)) * 20
    few = table.where("vec_id < 5")
    assert hilbert.nearest(few, few).count() == 20 and hilbert.nearest(few.where("false"), few.where("false")).count() == 0


def page(i, article=True):
    body = f"<h1>Title {i}</h1><p>First &amp; <b>bo</b>ld {i}.<p>Second&nbsp;{i}<br>line"
    body = f"<article>{body}</article>" if article else f"<div class=x>{body}</div>"
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href='/'>Menu {i}</a></nav><div>Welcome to us</div><!-- {i} --><div class='ad-box'>Buy {i}</div>{body}<div id=comments><p>Nice {i}</div><aside>More {i}</aside><form>Mail</form><footer>Foot {i}</footer>"


@pytest.mark.parametrize("article", [True, False])
def test_wrappers(spark, article):
    rows = [(i, f"http://h.test/{i}", page(i, article)) for i in range(60)] + [(90, None, None), (91, "http://h.test/x", ""), (92, "x", "<p>only <i>this"), (92, "x", "<p>only <i>this"), (93, "http://o.test/", "<div>" * 2000 + "deep")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(table).collect()}
    assert all(got[i] == f"Title {i}\n\nFirst & bold {i}.\n\nSecond {i} line" for i in range(60))
    assert (got[90], got[91], got[92], got[93]) == ("", "", "only this", "deep")
    assert wrappers.extract(table).count() == len(rows) and wrappers.extract(table.where("false")).count() == 0


def test_context_tree(spark, documents, odd):
    got = {r["doc_id"]: r for r in ctw.score_documents(documents, documents).collect()}
    counts, texts = Counter(), {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for text in texts.values():
        counts.update([*text.encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, text in texts.items():
        tokens = [*text.encode().lower().split(), "end"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_known"] == got[i]["n_tokens"] == len(tokens) and got[i]["train_tokens"] == n
        assert got[i]["score"] < 0
    rows = {r["doc_id"]: r for r in ctw.score_documents(odd, documents).collect()}
    assert (rows[1]["n_tokens"], rows[1]["score"]) == (1, 0.0) and ctw.score_documents(odd, documents).count() == len(ODD)
    untrained = {r["doc_id"]: r for r in ctw.score_documents(odd, empty(spark)).collect()}
    assert untrained[6]["score"] == pytest.approx(23 * math.log10(1 / 256)) and untrained[6]["n_known"] == 0
    assert ctw.score_documents(empty(spark), documents).count() == 0


def test_context_tree_is_a_distribution():
    shape = ctw.tree_shape(np.array([1, 1, 2]), np.array([97, 98, 97 << 8 | 98], np.uint64))
    tree = ctw.build_tree(shape, np.random.default_rng(0).integers(0, 30, (4, 256)).astype(float))
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(1), 1, atol=1e-4)


def test_pipeline(spark, documents, odd):
    import corpus_pipeline as pipeline

    docs = odd.unionByName(documents, allowMissingColumns=True).select(*odd.columns)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == odd.columns
            docs = out.persist()
    assert out.count() == docs.count() > 0
    assert pipeline.run(spark, SF).count() > 0


def test_list_entries_do_not_depend_on_batches():
    rng = np.random.default_rng(5)
    rows = sorted({(int(t), int(n), int(sig)) for t, n, sig in zip(rng.integers(0, 6, 80), rng.integers(5, 60, 80), rng.integers(0, 10**6, 80))})
    rows = sorted(rows + rows[::3])  # repeated sets
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    whole = pa.table({"token": columns[0], "sig": columns[2], "size": columns[1], "place": np.zeros(len(rows), np.int64)})
    results = []
    for size in (1, 3, 7, len(rows)):
        results.append([r for b in jaccard._lists(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()])
    assert all(r == results[0] for r in results)
    # Whoever has a partner near in size is kept, once; nobody else is.
    sets = sorted(set(rows))
    near = [r for r in sets if any(o != r and o[0] == r[0] and 100 * min(o[1], r[1]) >= jaccard.PERCENT * max(o[1], r[1]) for o in sets)]
    assert [(r["token"], r["size"], r["sig"]) for r in results[0]] == near


def test_sets_that_share_too_few_prefix_members_are_not_read(spark, monkeypatch):
    def text(start: int, n: int = 300) -> str:
        return " ".join(f"w{i}" for i in range(start, start + n))

    words = [f"w{i}" for i in range(5000, 5300)]
    near = words[:150] + ["x"] + words[151:]
    texts = [text(0), text(295), text(1000, 297) + " a b c", text(2000), " ".join(words), " ".join(near)]
    read = []

    def listed(documents, sigs):
        read.append(sigs.count())
        return whole(documents, sigs)

    whole = jaccard.listed_sets
    monkeypatch.setattr(jaccard, "listed_sets", listed)
    # Each text but the near copies shares six words, two shingles, with the one before or with a fifth text.
    texts[3] = texts[3] + " " + " ".join(f"w{i}" for i in range(1000, 1006))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows) and got[5][1] == 4
    assert read == [2]


def test_least_prefix_and_lists_of_the_same_sets(spark):
    rng = np.random.default_rng(1)
    for a, b in rng.integers(1, 400, (300, 2)).tolist():
        low, high = min(a, b), max(a, b)
        if 100 * low >= 80 * high:
            # Whichever prefix ends first, fewer common prefix members leave too few common members.
            assert jaccard.least_prefix(a, b) - 1 + high - (high - -(-80 * high // 100) + 1) < jaccard.shared_least(a, b)
            assert jaccard.least_prefix(np.array([a]), np.array([b]))[0] == plain_least(a, b)
    rows = [(t, s, 10, t, 1, 10, False) for t in (7, 8, 9) for s in (1, 2)] + [(t, s, 10, 0, 1, 10, False) for t in (3, 4) for s in (1, 2, 3)]
    lists = spark.createDataFrame(rows, "token long, sig long, size int, place int, lead long, lead_size int, possible boolean")
    got = {(r["token"], r["sig"], r["place"], r["weight"]) for r in jaccard.linkable_entries(lists).collect()}
    assert got == {(7, 1, 7, 3), (7, 2, 7, 3), (3, 1, 0, 2), (3, 2, 0, 2), (3, 3, 0, 2)}


def test_packed_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 800, 5000):
        members = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        members = np.unique(np.concatenate([members, np.array([0, (1 << 64) - 1], np.uint64)])) if n == 800 else members
        body = jaccard.packed(members)
        assert (jaccard.unpacked(pa.scalar(body, pa.binary())) == members >> np.uint64(16)).all() and jaccard.members_of(len(body)) == len(members)
        assert n < 800 or len(body) < 5.4 * len(members)


def plain_least(a: int, b: int) -> int:
    return -(-80 * (a + b) // 180) - -(-80 * max(a, b) // 100) + 1


def test_common_counts():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 25)).astype(np.uint64)) for _ in range(30)]
    counts = jaccard._common_counts(rows)
    assert all(counts[a, b] == len(np.intersect1d(rows[a], rows[b])) for a in range(30) for b in range(30) if a != b)


@pytest.mark.parametrize("head", [1 << 21, 50])
def test_every_context_is_a_node(spark, monkeypatch, head):
    """Against the dense tree of all contexts of the training texts, most of them seen once, with few pairs sent and with all."""
    monkeypatch.setattr(ctw, "HEAD_PAIRS", head)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=25)) for _ in range(8)] + ["the common words " * 2000, "é 日本", ""]
    learned, every = [x.encode() for x in texts], [x.encode() for x in [*texts, "xyz the abc unseen", words[0]]]
    seen = {(d, t[max(i - d, 0) : i].rjust(d, b"\0")) for t in learned for i in range(len(t)) for d in range(ctw.DEPTH + 1)}
    depth, context = zip(*[(d, int.from_bytes(c, "big")) for d, c in seen])
    shape = ctw.tree_shape(np.array(depth), np.array(context, np.uint64))
    at = lambda ts: np.cumsum([0, *map(len, ts)])
    raw = lambda ts: np.frombuffer(b"".join(ts), np.uint8)
    stream, place = ctw._stream(at(learned), raw(learned))
    ended = np.zeros((len(shape.depth), 256))
    np.add.at(ended, (shape.walker().ends(stream, place), stream[place]), 1)
    plain = ctw.build_tree(shape, ended).text_scores(at(every), raw(every))
    table = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(every)], "doc_id long, text string")
    known = F.col("doc_id") < len(texts)
    for learned in (None, known):
        got = {r["doc_id"]: r["score"] for r in ctw.score_documents(table, table.where(known), learned=learned).collect()}
        assert [got[i] for i in range(len(every))] == pytest.approx(plain.tolist(), rel=1e-5)


def test_context_tree_sees_seven_bytes(spark):
    """The byte after seven is told by the seventh before it only."""
    learned = ["x234567a" * 50 + "\n", "y234567b" * 50 + "\n"]
    table = spark.createDataFrame([*enumerate(learned), (2, "x234567a"), (3, "x234567b")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score_documents(table, table.where("doc_id < 2")).collect()}
    assert ctw.DEPTH == 7 and got[2] > got[3] + 1


@pytest.mark.parametrize("chunk", [1 << 24, 50_000])
def test_pair_counts_are_packed(monkeypatch, chunk):
    """Counts of pairs go to the shuffle in few bytes a pair (24 before), and whole subtrees come out of it with all of them."""
    monkeypatch.setattr(ctw, "CHUNK", chunk)
    monkeypatch.setattr(ctw, "RUN_PAIRS", 2000)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(150)] + ["", None, "é 日本", "A", "zz" * 3000]
    kinds = [(rng.random() < 0.8, rng.random() < 0.8) for _ in texts]
    columns = [pa.array(texts), *(pa.array(flags) for flags in zip(*kinds))]
    batch = pa.RecordBatch.from_arrays(columns, names=["text", "learned", "scored"])
    plain = {"learned": Counter(), "scored": Counter()}
    for text, kind in zip(texts, kinds):
        padded = bytes(ctw.DEPTH) + (text or "").encode().lower()
        seen = Counter(padded[i - ctw.DEPTH : i][::-1] + padded[i : i + 1] for i in range(ctw.DEPTH, len(padded)))
        for counts, flag in zip(plain.values(), kind):
            counts.update(seen if flag else {})
    packs = list(ctw._pair_counts(iter([batch])))
    assert sum(b.nbytes for b in packs) < 6 * sum(sum(b["rows"].to_pylist()) for b in packs)
    table = pa.Table.from_batches(packs).sort_by("bucket")
    runs = list(ctw._runs(iter(table.to_batches(max_chunksize=7))))
    got = {int(v).to_bytes(8, "big"): (n, seen) for run in runs for v, n, seen in zip(*(c.tolist() for c in run))}
    assert got == {v: (plain["learned"][v], plain["scored"][v]) for v in plain["learned"] | plain["scored"]}
    trees = [set((run[0] >> np.uint64(40)).tolist()) for run in runs]
    assert sum(map(len, trees)) == len(set().union(*trees)) and sum(len(r[0]) for r in runs) == len(got) and len(runs) > 20


def test_runs_hold_distinct_pairs(monkeypatch):
    """Packs of the same pairs from many chunks are merged as they come, so a frequent subtree takes no more memory than its pairs."""
    monkeypatch.setattr(ctw, "RUN_PAIRS", 100)
    value = np.arange(1 << 41, (1 << 41) + 300, dtype=np.uint64)
    packs = ctw._by_bucket(value, np.ones(300, np.uint32))
    rows = [{"bucket": b, "learned": True, "scored": k % 2 == 0, "rows": n, "pack": p} for k in range(200) for b, n, p in zip(*packs)]
    longest, sums = [], ctw._sums
    monkeypatch.setattr(ctw, "_sums", lambda *columns: longest.append(len(columns[0])) or sums(*columns))
    runs = list(ctw._runs(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(rows) == 200 and max(longest) < 2000
    assert [r.tolist() for r in runs[0]] == [value.tolist(), [200] * 300, [100] * 300] and len(runs) == 1


def test_pair_table():
    rng = np.random.default_rng(2)
    value = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    value[:2] = 0, 1
    log = rng.random(len(value)).astype(np.float32)
    table = ctw.PairTable(len(value) - 1000)
    for some in np.array_split(np.arange(len(value) - 1000), 7):
        table.add(value[some], log[some])
    logs, found = table.find(value)
    assert found[:-1000].all() and not found[-1000:].any() and (logs == np.where(found, log, 0)).all()
    assert not ctw.PairTable(0).find(value)[1].any()


def test_rare_pairs_are_answered(spark, monkeypatch):
    """The same scores if no pair is sent and packs are small, for repeated rows and keys too."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(2000)]
    rows = [(i % 90, " ".join(rng.choices(words, k=60))) for i in range(100)] + [(None, "no key"), (7, None), (8, ""), (9, "\0\0x"), (10, "A" * 5000)]
    table = spark.createDataFrame([*rows, rows[3]], "doc_id int, text string").repartition(3)
    scores = lambda: sorted((str(r["doc_id"]), r["n_bytes"], r["score"]) for r in ctw.score_documents(table, table.where("doc_id < 50")).collect())
    sent = scores()
    for name, most in (("HEAD_PAIRS", 0), ("FAR", 700), ("TEXTS", 2)):
        monkeypatch.setattr(ctw, name, most)
    got = scores()
    assert [g[:2] for g in got] == [s[:2] for s in sent] and len(got) == len(rows) + 1
    assert [g[2] for g in got] == pytest.approx([s[2] for s in sent], rel=1e-9)


def extracted(spark, htmls):
    rows = [(i, f"http://h.test/{i}", h) for i, h in enumerate(htmls)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_template_of_every_layout(spark):
    """Two layouts a host, three different pages each, most rows copies: constants of both go on all hosts."""
    one = lambda i: f"<body><div>Welcome to our site, have a look around</div><div class=x><h1>Title {i}</h1><p>Text {i}</p></div>"
    two = lambda i: f"<body><section>Another greeting that all pages repeat</section><section class=y><p>Story {i}</p></section>"
    picks = [0, 1, 2, 2, 2, 2, 2, 2]
    rows = [(h, f"http://h{h}.test/{k}", page(i)) for h in range(5) for page in (one, two) for k, i in enumerate(picks)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(r["text"] for r in wrappers.extract(table).collect())
    assert got == Counter({f(i): 5 * n for i, n in Counter(picks).items() for f in (lambda i: f"Title {i}\n\nText {i}", lambda i: f"Story {i}")})


def test_template_inside_articles(spark):
    """A constant line goes, a varying part under a listed word and a copied article stay."""
    body = lambda i, k: f"<body><nav>N {k}</nav><article><h1>T {i}</h1><p>Text {i}</p><p>Read our letter</p><div class=alert>Storm {i}</div></article>"
    # Half of the pages are copies of one article in different frames.
    got = extracted(spark, [body(0, k) for k in range(12)] + [body(i, i) for i in range(1, 12)])
    assert got == ["T 0\n\nText 0\n\nStorm 0"] * 12 + [f"T {i}\n\nText {i}\n\nStorm {i}" for i in range(1, 12)]


def test_words_take_nothing_where_nothing_was_learned(spark):
    related = "<article><p>One</p><div class='related'>A related study found this</div></article>"
    got = extracted(spark, [related, "<div class='search results'><p>Only this</p></div>"])
    assert got == ["One\n\nA related study found this", "Only this"]


def test_constants_below_many_levels(spark):
    nested = lambda i: "<section>" * 60 + f"<p>Greeting of all pages</p><div><p>Text {i}</p></div>"
    assert extracted(spark, [nested(i) for i in range(20)]) == [f"Text {i}" for i in range(20)]


def test_matching_is_the_best_of_all():
    """Simple tree matching against trying every order-keeping choice of pairs."""
    def plain(a, b):
        if a[0] != b[0]:
            return 0

        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + plain(x[0], y[0]))

        return 1 + best(a[1], b[1])

    def grown(depth):
        return [random.choice("ab"), [grown(depth - 1) for _ in range(random.randrange(4))] if depth else []]

    random.seed(6)
    for _ in range(200):
        a, b = grown(3), grown(3)
        a[0] = b[0]
        pairs = wrappers.aligned(a, b)
        assert wrappers.matching(a, b, {}) == plain(a, b) == len(pairs) and all(x[0] == y[0] for x, y in pairs)


def test_summaries_equal_blocks():
    """One pass from the leaves up finds the same texts at every node as reading each node by itself."""
    random.seed(7)
    tags = ["div", "p", "b", "span class=ad", "div class=menu", "br", "article", "section", "a", "nav", "i hidden"]
    for _ in range(60):
        text = "".join(random.choice([f"<{random.choice(tags)}>", f"</{random.choice(tags).split()[0]}>", f" w{random.randrange(9)} ", "&amp;x", "  "]) for _ in range(80))
        root = wrappers.parse(text)
        wrappers.summarise(root)
        todo, seen = [root], {}
        while todo:
            node = todo.pop()
            todo += [c for c in node.children() if c.tag not in wrappers.INLINE]
            found = wrappers.blocks(node, set())
            assert (node.texts, node.chars) == (len(found), sum(map(len, found)))
            assert seen.setdefault(node.digest, found) == found
