"""BM25 retrieval for many questions at once, and the evidence block built from its results.

The documents are tokenised once. In that pass each word is looked up in the questions' vocabulary
(a broadcast of checked size) and only matched words leave the task. What is written is a small
inverted index: one row per document and matched word. Corpus statistics, document frequencies,
phrase candidates and scores all come from it.

The best k need no score for every (question, document) pair. Documents lie in blocks; per block and
word the index keeps the highest frequency and the shortest document, from which an upper bound of any
score in the block follows. Scores in the blocks of the greatest bounds give a lower bound of a question's
k-th score. Blocks whose bound is below it are skipped; the result is exact.

Where documents have an access scope, a question sees a corpus of its own: number and length of documents
and frequencies of words are summed over the scopes that its asker may read, before anything is scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deskweave.functions import text as X
from deskweave.functions.words import vocabulary_counts
from deskweave.operators.joins import broadcast_if_small
from deskweave.operators.staging import stage

# Fixed values of the ranking formula.
K1, B, PHRASE_BONUS = 1.2, 0.75, 2.0
# Largest number of question terms that is broadcast; more questions are worked off in groups.
BROADCAST_ROWS = 200_000
# Mark in the term column that no token can equal.
DOCUMENT_MARK = "\u0001"
# Documents of a block; blocks besides k that a question's first bound is drawn from; what rounding may add.
BLOCK, SEED_BLOCKS, MARGIN = 64, 4, 0.001
# Inner words of a phrase that its candidates are found by; each candidate is searched for the whole phrase.
RAREST = 4


def document_text(title: str = "title", content: str = "content") -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit("")))


def _each(words: Column, name: str = "term") -> Column:
    """Explode a computed array. The outer form keeps the optimizer from computing the array a second
    time for a non-empty test; the caller drops the null row of an empty array."""
    return F.explode_outer(words).alias(name)


def document_frequency(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    words = docs.select(doc_id, _each(F.array_distinct(X.tokens(text)))).where(F.col("term").isNotNull())
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def term_frequency(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    words = docs.select(doc_id, _each(X.tokens(text))).where(F.col("term").isNotNull())
    return words.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("frequency"))


def corpus_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """Documents, total tokens and mean length; empty documents count."""
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size(X.tokens(text))).alias("tokens"),
        F.avg(F.size(X.tokens(text))).alias("mean_length"),
    )


def question_terms(questions: DataFrame, question_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(question, columns to keep, term, weight)."""
    words = questions.select(question_id, *keep, _each(X.tokens(text))).where(F.col("term").isNotNull())
    return words.groupBy(question_id, *keep, "term").agg(F.count(F.lit(1)).alias("weight"))


def question_profile(questions: DataFrame, question: str) -> tuple[int, bool]:
    """(number of question terms, whether some question has fewer than three words): one small job."""
    n = F.size(X.tokens(question))
    row = questions.agg(F.sum(n).alias("terms"), F.count_if((n > 0) & (n < 3)).alias("short")).first()
    return int(row["terms"] or 0), bool(row["short"])


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _longest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]


def matched_index(
    docs: DataFrame, doc_id: str, text: Column, questions: DataFrame, question_id: str, question: str, small: bool, keep: Sequence[str] = ()
) -> DataFrame:
    """(document, columns to keep, length, term, frequency) for words that occur in some question, written once.

    Each document also has one row with the document mark; null texts have no rows. Text and token list stay behind when
    the words are spread into rows: a row that kept them would copy a long text once per word. A vocabulary of more than
    BROADCAST_ROWS words is not sent to the tasks but joined.
    """
    spark = docs.sparkSession
    vocabulary = question_terms(questions, question_id, question).select("term").distinct()
    if small:
        # Words are counted within each text first, so only matched ones become rows.
        terms = spark.sparkContext.broadcast(vocabulary.toArrow()["term"].to_pylist())
        columns = [doc_id, *keep]
        read = docs.where(text.isNotNull()).select(*columns, F.lower(text).alias("_text"))
        schema = StructType([*(read.schema[c] for c in columns), *StructType.fromDDL("length int, term string, frequency long").fields])
        found = read.mapInArrow(lambda batches: vocabulary_counts(batches, "_text", columns, terms.value, DOCUMENT_MARK), schema)
        return stage(found.groupBy(*columns, "length", "term").agg(F.sum("frequency").alias("frequency")), "index")
    marks = spark.createDataFrame([(DOCUMENT_MARK,)], "term string")
    read = docs.select(doc_id, *keep, X.tokens(text).alias("_tokens"))
    sized = read.select(doc_id, *keep, F.size("_tokens").alias("length"), F.concat(F.array(F.lit(DOCUMENT_MARK)), "_tokens").alias("_tokens"))
    words = sized.select(doc_id, *keep, "length", _each(F.col("_tokens")))
    found = words.join(vocabulary.unionByName(marks), "term")
    return stage(found.groupBy(doc_id, *keep, "length", "term").agg(F.count(F.lit(1)).alias("frequency")), "index")


def _tasks(df: DataFrame) -> int:
    """For shuffles whose rows multiply afterwards: their size says little about the work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _long_candidates(index: DataFrame, doc_id: str, asked: DataFrame, question_id: str, small: bool, frequencies: DataFrame) -> DataFrame:
    """(question, document) with the rarest inner words of a phrase of three or more words; all of them, if it has few."""
    inner = F.array_distinct(F.slice("_q", F.lit(2), F.size("_q") - 2))
    every = asked.where(F.size("_q") >= 3).select(question_id, F.least(F.size(inner), F.lit(RAREST)).alias("_need"), F.explode(inner).alias("term"))
    # A word that no document holds is the rarest one, and leaves no candidate.
    order = Window.partitionBy(question_id).orderBy(F.coalesce("_df", F.lit(0)), "term")
    rare = every.join(frequencies, "term", "left").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= RAREST)
    wanted = stage(rare.select(question_id, "_need", "term"), "phrase-words")
    held = index.repartition(_tasks(index), doc_id).join(_hint(wanted, small), "term")
    counted = held.groupBy(doc_id, question_id, "_need").agg(F.count(F.lit(1)).alias("_have"))
    # A document id with several texts may have a word more than once.
    return counted.where(F.col("_have") >= F.col("_need")).select(question_id, doc_id)


def _short_candidates(docs: DataFrame, doc_id: str, text: Column, short: DataFrame, question_id: str, small: bool) -> DataFrame:
    """(question, document) with some word that contains the longest word of a shorter phrase."""
    anchors = short.select(question_id, _longest(F.col("_q")).alias("_anchor"))
    lengths = anchors.agg(F.collect_set(F.length("_anchor"))).scalar()
    words = docs.select(doc_id, _each(F.array_distinct(X.tokens(text)), "_word")).where(F.col("_word").isNotNull())
    sized = words.select(doc_id, "_word", F.explode(lengths).alias("_n")).where(F.length("_word") >= F.col("_n"))
    pieces = sized.select(doc_id, F.explode(F.transform(
        F.sequence(F.lit(1), F.length("_word") - F.col("_n") + 1), lambda i: F.substring(F.col("_word"), i, F.col("_n"))
    )).alias("_anchor"))
    return pieces.join(_hint(anchors, small), "_anchor").select(question_id, doc_id).distinct()


def _anchored(docs: DataFrame, doc_id: str, text: Column, asked: DataFrame, question_id: str, small: bool) -> DataFrame:
    """(question, document, phrase) where some three characters of a phrase without words occur in the text."""
    n = F.least(F.length(F.trim("_phrase")), F.lit(3))
    anchors = asked.select(question_id, "_phrase", F.substring(F.trim("_phrase"), F.lit(1), n).alias("_anchor"))
    lengths = anchors.agg(F.collect_set(F.length("_anchor"))).scalar()
    sized = docs.select(doc_id, F.lower(text).alias("_text")).withColumn("_n", F.explode(lengths)).where(F.length("_text") >= F.col("_n"))
    pieces = sized.select(doc_id, _each(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1), lambda i: F.substring(F.col("_text"), i, F.col("_n")))), "_anchor"))
    return pieces.join(_hint(anchors, small), "_anchor").select(question_id, doc_id, "_phrase")


def phrase_hits(
    docs: DataFrame,
    doc_id: str,
    text: Column,
    questions: DataFrame,
    question_id: str,
    question: str,
    phrase: Column | None = None,
    index: DataFrame | None = None,
    profile: tuple[int, bool] | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """(question, document) where the question's words, joined by blanks, occur literally in the text.

    ``phrase`` may name another lower-case text that holds the same words in order. In a phrase of
    three or more words the inner ones have a non-word character on both sides, hence are words of
    the document too: documents that lack one of the rarest are out, by the index alone. Shorter phrases may begin
    or end inside a longer word, so for them the document's words are cut into pieces of the lengths
    in question. Only candidates are searched, and the texts are read again only if there are any.
    A ``phrase`` whose question has no words (stop words only, other alphabets) is looked for where its first three
    characters occur; a blank one is found nowhere.
    """
    terms, has_short = profile or question_profile(questions, question)
    small = terms <= BROADCAST_ROWS
    if index is None:
        index = matched_index(docs, doc_id, text, questions, question_id, question, small)
    words = X.tokens(question)
    needle = F.array_join(words, " ") if phrase is None else phrase
    asked = questions.select(question_id, words.alias("_q"), needle.alias("_phrase")).where(F.size("_q") > 0)
    if frequencies is None:
        frequencies = index.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    candidates = _long_candidates(index, doc_id, asked, question_id, small, frequencies)
    if has_short:
        short = asked.where(F.size("_q") < 3)
        candidates = candidates.unionByName(_short_candidates(docs, doc_id, text, short, question_id, small))
    candidates = candidates.join(_hint(asked.select(question_id, "_phrase"), small), question_id)
    if phrase is not None:
        wordless = questions.where(F.size(words) == 0).select(question_id, needle.alias("_phrase")).where(F.trim("_phrase") != "")
        some = wordless.limit(BROADCAST_ROWS + 1).count()
        if some:
            candidates = candidates.unionByName(_anchored(docs, doc_id, text, wordless, question_id, some <= BROADCAST_ROWS).select(*candidates.columns))
    candidates = stage(candidates, "candidates")
    number = candidates.limit(BROADCAST_ROWS + 1).count()
    if number == 0:
        return candidates.drop("_phrase")
    few = number <= BROADCAST_ROWS // 10
    texts = docs.select(doc_id, F.lower(text).alias("_text"))
    return texts.join(_hint(candidates, few), doc_id).where(F.contains("_text", "_phrase")).select(question_id, doc_id)


def _saturation(frequency: Column, length: Column, mean: Column) -> Column:
    return frequency * F.lit(K1 + 1) / (frequency + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))


def _set_key(values: Column) -> Column:
    """One text for equal sets of names."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "\u0001")


class Ranking:
    """What scoring a group of questions reads: the index, the weights of the questions' words, phrase hits.

    ``scope`` names the documents' array of groups that may read them, ``groups`` the questions' array of groups of the
    asker; without them there is one corpus for all. Columns ``_scope`` and ``_audience`` stand for equal sets of each.
    """

    def __init__(self, docs: DataFrame, questions: DataFrame, doc_id: str, question_id: str, text: Column, question: str, scope: str | None, groups: str | None) -> None:
        self.doc_id, self.question_id = doc_id, question_id
        scoped = docs.withColumn("_scope", _set_key(F.col(scope)) if scope else F.lit(""))
        asked = questions.withColumn("_audience", _set_key(F.col(groups)) if groups else F.lit(""))
        profile = question_profile(questions, question)
        small = profile[0] <= BROADCAST_ROWS
        self.index = matched_index(scoped, doc_id, text, asked, question_id, question, small, ["_scope"])
        marks = self.index.where(F.col("term") == DOCUMENT_MARK)
        scopes = stage(marks.groupBy("_scope").agg(F.count(F.lit(1)).alias("_documents"), F.sum("length").alias("_tokens")), "scopes")

        def members(rows: DataFrame, key: str) -> DataFrame:
            # Nobody may read what names no group; without scopes all have the same empty name.
            named = rows.where(F.col(key) != "") if scope else rows
            return named.select(key, F.explode(F.split(key, "\u0001")).alias("_group")).distinct()

        audiences = asked.select("_audience").distinct()
        visible = members(scopes, "_scope").join(members(audiences, "_audience"), "_group").select("_audience", "_scope").distinct()
        self.visible = stage(visible, "visible")
        corpus = self.visible.join(scopes, "_scope").groupBy("_audience").agg(
            F.sum("_documents").alias("_total"), F.greatest(F.sum("_tokens") / F.sum("_documents"), F.lit(1.0)).alias("_mean"))
        parts = scopes.select("_scope", F.ceil(F.col("_documents") / BLOCK).alias("_parts"))
        block = F.pmod(F.xxhash64(doc_id), F.col("_parts")).alias("_block")
        words = self.index.where(F.col("term") != DOCUMENT_MARK).join(broadcast_if_small(parts), "_scope")
        self.postings = words.select(doc_id, "_scope", block, "term", "length", "frequency")
        self.blocks = stage(
            self.postings.groupBy("_scope", "_block", "term").agg(F.count(F.lit(1)).alias("_df"), F.max("frequency").alias("_most"), F.min("length").alias("_least")), "blocks")
        found = self.blocks.groupBy("_scope", "term").agg(F.sum("_df").alias("_df")).join(broadcast_if_small(self.visible), "_scope")
        frequencies = found.groupBy("_audience", "term").agg(F.sum("_df").alias("_df"))
        terms = question_terms(asked, question_id, question, ["_audience"])
        idf = F.log(F.lit(1.0) + (F.col("_total") - F.col("_df") + F.lit(0.5)) / (F.col("_df") + F.lit(0.5)))
        weighted = terms.join(frequencies, ["_audience", "term"]).join(broadcast_if_small(corpus), "_audience")
        weighted = weighted.select(question_id, "_audience", "term", (F.col("weight") * idf).alias("_w"), "_df", "_mean")
        # One row per question, word and scope that the question may see: a join with it is all the authorisation there is.
        self.asked = stage(weighted.join(broadcast_if_small(self.visible), "_audience").drop("_audience"), "asked")
        self.small = self.asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        held = self.blocks.groupBy("term").agg(F.sum("_df").alias("_df"))
        hits = phrase_hits(docs, doc_id, text, questions, question_id, question, index=self.index, profile=profile, frequencies=held)
        seen = asked.select(question_id, "_audience").join(broadcast_if_small(self.visible), "_audience").select(question_id, "_scope")
        placed = hits.join(marks.select(doc_id, "_scope"), doc_id).join(seen, [question_id, "_scope"]).join(broadcast_if_small(parts), "_scope")
        self.hits = stage(placed.select(question_id, doc_id, "_scope", block).distinct(), "hits")

    def parts(self, asked: DataFrame, postings: DataFrame, on: Sequence[str]) -> DataFrame:
        """(question, document, part of its score) of every posting that a question asks for."""
        part = F.col("_w") * _saturation(F.col("frequency"), F.col("length"), F.col("_mean"))
        return postings.join(asked, list(on)).select(self.question_id, self.doc_id, part.alias("_part"))

    def summed(self, parts: DataFrame) -> DataFrame:
        bonus = self.hits.select(self.question_id, self.doc_id, F.lit(PHRASE_BONUS).alias("_part"))
        sums = parts.unionByName(bonus).groupBy(self.doc_id, self.question_id).agg(F.sum("_part").alias("_sum"))
        return sums.where(F.col("_sum") > 0).select(self.question_id, self.doc_id, F.round("_sum", 4).alias("score"))

    def all_pairs(self) -> DataFrame:
        postings = self.postings.repartition(_tasks(self.postings), self.doc_id)
        return self.summed(self.parts(_hint(self.asked, self.small), postings, ["_scope", "term"]))

    def least_scores(self, bounds: DataFrame, k: int) -> DataFrame:
        """(question, lower bound of its k-th score): the k-th best full score among the documents of the blocks of the greatest
        bounds, each of which holds one at least. Phrases count nothing here, so it is a lower bound whatever they add."""
        first = Window.partitionBy(self.question_id).orderBy(F.desc("_bound"), "_scope", "_block")
        seeds = bounds.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k + SEED_BLOCKS).select(self.question_id, "_scope", "_block")
        wanted = stage(seeds, "seeds").join(_hint(self.asked, self.small), [self.question_id, "_scope"])
        sums = self.parts(broadcast_if_small(wanted), self.postings, ["_scope", "_block", "term"]).groupBy(self.question_id, self.doc_id).agg(F.sum("_part").alias("_sum"))
        order = Window.partitionBy(self.question_id).orderBy(F.desc("_sum"), self.doc_id)
        found = sums.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
        return found.groupBy(self.question_id).agg(F.when(F.count(F.lit(1)) >= k, F.min("_sum")).otherwise(0.0).alias("_least_score"))

    def open_blocks(self, k: int) -> DataFrame:
        """(question, scope, block) that may hold one of the question's best k."""
        most = F.sum(F.col("_w") * _saturation(F.col("_most"), F.col("_least"), F.col("_mean")))
        bounds = self.blocks.join(_hint(self.asked, self.small), ["_scope", "term"]).groupBy(self.question_id, "_scope", "_block").agg(most.alias("_bound"))
        bounds = stage(bounds, "bounds")
        least = stage(self.least_scores(bounds, k), "least-scores")
        kept = bounds.join(broadcast_if_small(least), self.question_id, "left").where(F.col("_bound") + MARGIN >= F.coalesce("_least_score", F.lit(0.0)))
        # A phrase's bonus is not in the bounds; its documents are few and scored anyway.
        return kept.select(self.question_id, "_scope", "_block").unionByName(self.hits.select(self.question_id, "_scope", "_block")).distinct()

    def best(self, k: int) -> DataFrame:
        open_ = self.open_blocks(k).join(_hint(self.asked, self.small), [self.question_id, "_scope"])
        return self.summed(self.parts(open_, self.postings, ["_scope", "_block", "term"]))


def _in_groups(questions: DataFrame, question_id: str, question: str) -> list[DataFrame]:
    """Questions with more terms than may be broadcast are worked off in groups, one text pass each."""
    groups = question_profile(questions, question)[0] // BROADCAST_ROWS + 1
    return [questions] if groups == 1 else [questions.where(F.pmod(F.xxhash64(question_id), F.lit(groups)) == i) for i in range(groups)]


def scored_pairs(
    docs: DataFrame,
    questions: DataFrame,
    doc_id: str = "doc_id",
    question_id: str = "item_id",
    text: Column | None = None,
    question: str = "text",
    scope: str | None = None,
    groups: str | None = None,
) -> DataFrame:
    """(question, document, score) for every visible document with a positive score, rounded to four digits."""
    text = document_text() if text is None else text
    return reduce(DataFrame.unionByName, [
        Ranking(docs, part, doc_id, question_id, text, question, scope, groups).all_pairs() for part in _in_groups(questions, question_id, question)
    ])


def rankings(
    docs: DataFrame,
    questions: DataFrame,
    doc_id: str = "doc_id",
    question_id: str = "item_id",
    text: Column | None = None,
    question: str = "text",
    scope: str | None = None,
    groups: str | None = None,
) -> list[tuple[DataFrame, Ranking]]:
    """(questions, what their ranking reads) of each group of questions; ``best_of`` ranks them, and ``phrase_hits`` on texts that
    the ranked ones hold may use the same index."""
    text = document_text() if text is None else text
    return [(part, Ranking(docs, part, doc_id, question_id, text, question, scope, groups)) for part in _in_groups(questions, question_id, question)]


def best_of(ranked: Sequence[tuple[DataFrame, Ranking]], k: int) -> DataFrame:
    k = max(1, min(k, 20))
    first = ranked[0][1]
    return top_k(reduce(DataFrame.unionByName, [ranking.best(k) for _, ranking in ranked]), k, first.question_id, first.doc_id)


def best(
    docs: DataFrame,
    questions: DataFrame,
    k: int,
    doc_id: str = "doc_id",
    question_id: str = "item_id",
    text: Column | None = None,
    question: str = "text",
    scope: str | None = None,
    groups: str | None = None,
) -> DataFrame:
    """``top_k`` of ``scored_pairs``, the same rows, without scoring blocks of documents that cannot be among them."""
    return best_of(rankings(docs, questions, doc_id, question_id, text, question, scope, groups), k)


def top_k(pairs: DataFrame, k: int, question_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Best ``k`` documents per question (1..20); ties in document order. Adds ``rank``."""
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), doc_id)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= X.clamp(k, 1, 20))


def with_documents(ranked: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Title, text and source of ranked documents.

    The ranking (k rows per question) is written first, so its true size is known: it is broadcast to
    the texts while it is small, and the texts are not shuffled.
    """
    ranked = stage(ranked, "ranked")
    few = ranked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(_hint(ranked, few), doc_id)


def cited_sources(
    ranked: DataFrame, second: DataFrame | None = None, question_id: str = "item_id", position: str = "doc_id"
) -> DataFrame:
    """Ranked local documents, then unscored second-source ones, numbered S1, S2 … per question."""
    local = ranked.withColumn("source_priority", F.lit(0))
    rows = local if second is None else local.unionByName(
        second.withColumn("source_priority", F.lit(1)), allowMissingColumns=True
    )
    order = Window.partitionBy(question_id).orderBy("source_priority", F.col("score").desc_nulls_last(), position)
    return rows.withColumn("place", F.row_number().over(order)).withColumn(
        "citation", F.concat(F.lit("S"), F.col("place").cast("string"))
    )


def source_heading() -> Column:
    return F.concat(
        F.lit("["), F.col("citation"), F.lit("] "), F.col("title"), F.lit(" | source="), F.col("source"),
        F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.concat(F.lit(" | url="), F.col("url"))).otherwise(""),
    )


def evidence_budget(sources: DataFrame, maximum: int = 18000, question_id: str = "item_id") -> DataFrame:
    """The cited texts that fit the character budget; the last one may be cut.

    A question has at most 30 sources (20 ranked, 10 from the second source), so its window is small.
    """
    maximum = X.clamp(maximum, 2000, 60000)
    before = Window.partitionBy(question_id).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = sources.withColumn("heading", source_heading())
    full = F.length("heading") + 1 + F.length("content")
    room = F.lit(maximum) - F.coalesce(F.sum(full).over(before), F.lit(0)) - F.length("heading") - 2
    fitted = sized.withColumn("room", room).where(F.col("room") > 0)
    return fitted.withColumn("evidence", F.col("content").substr(F.lit(1), F.col("room").cast("int")))


def evidence_block(fitted: DataFrame, question_id: str = "item_id") -> DataFrame:
    """One text per question, sources in citation order."""
    part = F.struct("place", F.concat(F.col("heading"), F.lit("\n"), F.col("evidence")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"])
    return fitted.groupBy(question_id).agg(F.array_join(ordered, "\n\n").alias("evidence"))


def retrieved_sources(sources: DataFrame, question_id: str = "item_id") -> DataFrame:
    return sources.select(question_id, "citation", "title", "source", "kind", "score", "url", "content")


def recent_history(turns: DataFrame, n: int = 6, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` (0..20) messages of each session in time order, blank ones left out.

    The rank filter lets each task keep ``n`` rows per session before the shuffle.
    """
    n = X.clamp(n, 0, 20)
    recent = Window.partitionBy(session).orderBy(F.desc(order))
    cut = turns.withColumn("_back", F.row_number().over(recent)).where(F.col("_back") <= n)
    return cut.select(
        session, order, X.chat_role("role").alias("role"), X.clean_text("text", 3000).alias("content")
    ).where(F.col("content") != "")
