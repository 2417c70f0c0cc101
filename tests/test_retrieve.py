import math
import re
from collections import Counter

from pyspark.sql import functions as F

from deskweave.functions.text import STOP_WORDS
from deskweave.operators import documents as D
from deskweave.operators import retrieve as T

INCIDENTS = [
    ("INC-DEMO-001", "VPN disconnects after five minutes", "Remote users lose the VPN session shortly after connecting following a client upgrade."),
    ("INC-DEMO-002", "User account locked after failed sign-ins", "A single user cannot sign in and the directory reports that the account is locked."),
    ("INC-DEMO-003", "Shared mailbox missing in desktop client", "An approved shared mailbox is available in webmail but is not displayed."),
]


def incidents(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(INCIDENTS)], "doc_id long, number string, short_description string, description string")
    return D.record_documents(rows, "records", position="doc_id")


def words(text):
    return [t for t in re.findall(r"[a-z0-9][a-z0-9_.-]+", text.lower()) if t not in STOP_WORDS]


def ranked_by_hand(docs, query, k):
    q, tokenized = words(query), {i: words(t) for i, t in docs.items()}
    mean = max(sum(map(len, tokenized.values())) / len(docs), 1)
    df = Counter(t for ts in tokenized.values() for t in set(ts))
    scores = {}
    for i, ts in tokenized.items():
        counts, s = Counter(ts), 0.0
        for t, w in Counter(q).items():
            if counts[t]:
                idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                s += w * idf * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * len(ts) / mean))
        if " ".join(q) and " ".join(q) in docs[i].lower():
            s += 2.0
        if s > 0:
            scores[i] = round(s, 4)
    return sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k]


def test_vpn_question_cites_the_vpn_incident(spark):
    asked = spark.createDataFrame([(1, "VPN disconnects five minutes after connecting")], "item_id long, text string")
    docs = incidents(spark)
    sources = T.cited_sources(T.top_k(T.scored_pairs(docs, asked), 2).join(docs, "doc_id"))
    first = T.retrieved_sources(sources).where("citation = 'S1'").first()
    assert first["title"] == "INC-DEMO-001" and first["content"].startswith("short_description: VPN disconnects")
    assert first.asDict().keys() == {"item_id", "citation", "title", "source", "kind", "score", "url", "content"}


def test_scores_and_phrases_against_plain_python(spark):
    texts = {0: "router reset, cable modem", 1: "The xabc defy line", 2: "abc def ghi jkl", 3: "abc def  ghi", 4: "prefix-router", 5: "", 6: "ghi jkl abc def", 7: "abc def ghi abc def ghi"}
    queries = {1: "abc def", 2: "router", 3: "abc def ghi", 4: "the of", 5: "router reset cable modem nothing", 6: "oute"}
    docs = spark.createDataFrame([(i, "", t) for i, t in texts.items()], "doc_id long, title string, content string")
    asked = spark.createDataFrame(list(queries.items()), "item_id long, text string")
    got = {}
    for r in T.top_k(T.scored_pairs(docs, asked), 20).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    want = {q: ranked_by_hand({i: " " + t for i, t in texts.items()}, text, 20) for q, text in queries.items()}
    assert got == {q: rows for q, rows in want.items() if rows}


def test_groups_of_questions_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "", f"word{i % 7} word{i % 5} shared") for i in range(50)], "doc_id long, title string, content string")
    asked = spark.createDataFrame([(i, f"shared word{i} word{i + 1}") for i in range(8)], "item_id long, text string")
    whole = {tuple(r) for r in T.scored_pairs(docs, asked).collect()}
    monkeypatch.setattr(T, "BROADCAST_ROWS", 6)
    assert {tuple(r) for r in T.scored_pairs(docs, asked).collect()} == whole


def test_evidence_budget_cuts_only_the_last(spark):
    rows = [(1, i, f"t{i}", "x" * 900, "records", "", float(9 - i)) for i in range(5)]
    docs = spark.createDataFrame(rows, "item_id long, doc_id long, title string, content string, source string, url string, score double")
    fitted = T.evidence_budget(T.cited_sources(docs), 2000).orderBy("place").collect()
    used, blocks = 0, []
    for n, r in enumerate(rows, 1):
        heading = f"[S{n}] {r[2]} | source=records"
        room = 2000 - used - len(heading) - 2
        if room <= 0:
            break
        blocks.append(f"{heading}\n{r[3][:room]}")
        used += len(blocks[-1])
    assert [f"{r['heading']}\n{r['evidence']}" for r in fitted] == blocks
    assert T.evidence_block(T.evidence_budget(T.cited_sources(docs), 2000)).first()["evidence"] == "\n\n".join(blocks)


def test_second_source_follows_unscored(spark):
    local = spark.createDataFrame([(1, 5, "a", 2.0), (1, 4, "b", 1.0)], "item_id long, doc_id long, title string, score double")
    second = spark.createDataFrame([(1, 0, "page")], "item_id long, doc_id long, title string")
    got = [(r["citation"], r["title"]) for r in T.cited_sources(local, second).orderBy("place").collect()]
    assert got == [("S1", "a"), ("S2", "b"), ("S3", "page")]


def test_documents_drop_empty_values_and_name_untitled(spark):
    rows = spark.sql("SELECT CAST(0 AS bigint) AS pos, '' AS number, 'x' AS extra, 'text' AS description, CAST('NaN' AS double) AS price, array() AS tags, array('a') AS skills")
    got = D.record_documents(rows, "records", position="pos").first()
    assert got["title"] == "record 1" and got["content"] == 'description: text\nextra: x\nskills: ["a"]'


def test_history_keeps_the_end_and_drops_blanks(spark):
    turns = spark.createDataFrame([("s", i, "AI" if i % 2 else "human", " " if i == 9 else f"m  {i}") for i in range(10)], "conv_id string, turn int, role string, text string")
    got = [(r["turn"], r["role"], r["content"]) for r in T.recent_history(turns, 3).orderBy("turn").collect()]
    assert got == [(7, "assistant", "m 7"), (8, "user", "m 8")] and T.recent_history(turns, 0).count() == 0


def test_explicit_phrases_without_words(spark):
    texts = {0: "It is of the kind", 1: "Привет, мир", 2: "of a kind", 3: "router reset", 4: None}
    queries = {1: "of the", 2: "Мир", 3: "router", 4: "the of", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(queries.items()), "item_id long, text string")
    expected = sorted((q, d) for q, p in queries.items() for d, t in texts.items() if p and t and p.lower() in t.lower())
    for some in (asked, asked.where("item_id <> 3")):
        got = T.phrase_hits(docs, "doc_id", F.col("text"), some, "item_id", "text", phrase=F.lower("text")).collect()
        assert sorted(map(tuple, got)) == [e for e in expected if some is asked or e[0] != 3]


def _corpus(spark, hidden=()):
    """Documents of five scopes; a question's asker reads two of them and what is open to all."""
    import random

    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, f"t{i}", " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(1, 60))), [f"g{i % 5}"] if i % 7 else ["all"]) for i in range(900)]
    docs = spark.createDataFrame(rows + list(hidden), "doc_id long, title string, content string, scope array<string>")
    asked = [(q, " ".join(rng.choices(words, k=6)), [f"g{q % 5}", f"g{(q + 1) % 5}", "all"]) for q in range(12)]
    return docs, spark.createDataFrame([*asked, (50, "word1 word2", ["nobody"]), (51, "", ["g1"]), (52, "word3", [])], "item_id long, text string, groups array<string>")


def test_best_is_the_top_of_all_pairs_with_fewer_scored(spark, monkeypatch):
    docs, asked = _corpus(spark)
    monkeypatch.setattr(T, "BLOCK", 4)
    ranking = T.Ranking(docs, asked, "doc_id", "item_id", T.document_text(), "text", None, None)
    every = ranking.all_pairs()
    want = sorted(tuple(r) for r in T.top_k(every, 2).select("item_id", "doc_id", "score", "rank").collect())
    scored = ranking.best(2).persist()
    assert sorted(tuple(r) for r in T.top_k(scored, 2).select("item_id", "doc_id", "score", "rank").collect()) == want
    assert scored.count() < 0.7 * every.count()


def test_hidden_documents_change_no_score(spark):
    docs, asked = _corpus(spark)
    secret = [(5000 + i, "secret", "word1 word2 word50 " * 40, ["nobody-else"]) for i in range(50)] + [(6000, "x", "word1", None), (6001, "x", "word1", [])]
    more, _ = _corpus(spark, secret)

    def ranked(d):
        return sorted(tuple(r) for r in T.best(d, asked, 5, scope="scope", groups="groups").select("item_id", "doc_id", "score", "rank").collect())

    got = ranked(docs)
    assert got and got == ranked(more) and not [r for r in got if r[0] in (50, 52)]
    # The scores are those of the visible documents taken as a corpus of their own.
    for q in asked.collect()[:1]:
        own = docs.where(F.arrays_overlap("scope", F.array(*map(F.lit, q["groups"]))))
        alone = T.best(own, asked.where(F.col("item_id") == q["item_id"]), 5)
        assert sorted(tuple(r) for r in alone.select("item_id", "doc_id", "score", "rank").collect()) == [r for r in got if r[0] == q["item_id"]]
