"""Exact n-gram Jaccard join: prefix lists skipped by size and position, answers derived from a similar set's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.llm.common import SpanHasher, bit_filter, by_filter, giving_back, in_filter, keyed_schema, lowered, mixed, read, signed, texts_of, utf8_steps, word_spans
from deskweave.llm.components import components
from deskweave.operators.staging import stage, stage_bucketed

WORDS = 5
PERCENT = 80
BUCKETS = 1 << 21  # counters of shingle frequency, whatever the corpus' size
SAMPLE = 1 << 22  # shingles that are counted together within a task
FILTER_BITS = 1 << 27  # bound of the filter of sets to be read again
FAMILY_BLOCK = 512  # sets
FAMILY_BYTES = 1 << 22  # of their differences
COLUMNS = 2048  # members that are multiplied out together
PAIRS = 1 << 18  # handed on together
FOLLOWED = 4  # leaders of leaders
LENIENT = 4  # a leader that is met in this part of the lists that a link needs is compared at once
BLOCK = 1 << 16  # pairs looked at together within a list
MEMBER_BYTES = 6  # of a member's hash in a set that is written or shuffled
TOKEN_BYTES = 5  # of a prefix member's hash where repeated ones are looked for
CHUNK = 1 << 18  # prefix members that a task hands on together
SLICES = 4  # of a shuffle partition, each looked through at once


class Shingler:
    def __init__(self, words: int = WORDS) -> None:
        self.words, self.hasher = words, SpanHasher()
        self.turn = mixed(np.arange(1, words + 1, dtype=np.uint64))  # tells a word's place in its shingle

    def sets(self, at: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """For each text the sorted distinct 64-bit hashes of its shingles."""
        raw = lowered(raw)
        starts, ends, text = word_spans(at, raw)
        words = self.hasher(raw, starts, ends)
        first = np.searchsorted(text, np.arange(len(at)))
        n = max(len(words) - self.words + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(self.words):
            rolled += mixed(words[k : k + n] + self.turn[k])
        rolled = mixed(rolled)
        out = []
        for i in range(len(at) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= self.words:
                out.append(np.unique(rolled[a : b - self.words + 1]))
            elif b > a:
                whole = mixed(words[a:b] + self.turn[: b - a]).sum(dtype=np.uint64, keepdims=True)
                out.append(mixed(whole + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def signature(members: np.ndarray) -> int:
    """64 bits of a set; equal sets have equal ones."""
    total = mixed(members + np.uint64(1)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(members))
    return int(signed(mixed(total))[0])


def packed(members: np.ndarray) -> bytes:
    """A sorted set by the leading bytes of its hashes. Two sets of a thousand members take a wrong member for a
    common one once in 280 million pairs; place, size and signature are from the whole hashes.

    The first byte does not fall from member to member, so it takes a bit or two: a one for each member, a zero for each step.
    """
    lead, n = members >> np.uint64(64 - 8 * MEMBER_BYTES), len(members)
    steps = np.zeros(n + 256, bool)
    steps[(members >> np.uint64(56)).astype(np.int64) + np.arange(n)] = True
    body = lead.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : MEMBER_BYTES - 1]
    return body.tobytes() + np.packbits(steps).tobytes()


def members_of(size: int) -> int:
    """Members of a packed set of so many bytes."""
    return (8 * size - 256) // (8 * MEMBER_BYTES - 7)


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), np.uint8)
    n = members_of(len(raw))
    out = np.zeros((n, 8), np.uint8)
    out[:, : MEMBER_BYTES - 1] = raw[: n * (MEMBER_BYTES - 1)].reshape(n, MEMBER_BYTES - 1)
    out[:, MEMBER_BYTES - 1] = np.flatnonzero(np.unpackbits(raw[n * (MEMBER_BYTES - 1) :])) - np.arange(n)
    return out.view("<u8").ravel()


def shared_least(a, b, percent: int = PERCENT):
    """Least number of common members of linked sets of sizes a and b: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def least_prefix(a, b, percent: int = PERCENT):
    """Least number of common prefix members of linked sets of sizes a and b.

    Prefixes follow one order of all members. Take the set whose prefix ends first: its prefix members that the other set
    holds are in the other's prefix too, so what is common is at most the common prefix members and what follows
    this prefix. The larger set has more behind its prefix, and is taken here whichever ends first.
    """
    larger = (a + b + abs(a - b)) // 2
    return shared_least(a, b, percent) + 1 + -percent * larger // 100


def _signed_sets(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    make = Shingler()
    for batch in batches:
        for first, at, raw in utf8_steps(texts_of(batch)):
            sets = make.sets(at, raw)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            marks = pa.array([signature(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, len(sets)), sizes, marks], names=[key, "n_shingles", "sig"])


def _bucket(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of the shingles that several different sets of a run of texts hold."""
    make = Shingler()
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        members = np.concatenate(held)
        held.clear()
        members.sort()
        again = members[1:] == members[:-1]
        members = members[np.append(again, False) | np.append(False, again)]
        buckets, total = np.unique(_bucket(members), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(total)], names=["bucket", "n"])

    for batch in batches:
        for _, at, raw in utf8_steps(batch.column("text")):
            for members in make.sets(at, raw):
                sig = signature(members) if len(members) else None
                if sig is not None and sig not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(sig)
                    held.append(members)
                    size += len(members)
            if size >= SAMPLE:
                yield counted()
                size = 0
    if held:
        yield counted()


def frequency_counters(documents: DataFrame) -> np.ndarray:
    """Frequencies of shingles by hash bucket, from all texts.

    A shingle counts where several sets of one run of texts hold it, so the many rare ones leave the counters
    empty and what is frequent in the corpus stands out, whatever its size. Only the order of members
    depends on them: any order gives the same links, this one keeps common passages out of the prefixes.
    """
    rows = documents.select("text").mapInArrow(lambda b: giving_back(_bucket_counts(b)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(column: pa.Array, counters: np.ndarray, seen: set[int], make: Shingler) -> Iterator[tuple[np.ndarray, int, int]]:
    """(prefix, signature, size) of each set that the task has not seen; rarest members first."""
    for _, at, raw in utf8_steps(column):
        for members in make.sets(at, raw):
            n = len(members)
            sig = signature(members) if n else None
            if sig is None or sig in seen:
                continue
            if len(seen) < 1 << 20:
                seen.add(sig)
            order = np.argsort(counters[_bucket(members)], kind="stable")
            yield members[order[: n - -(-PERCENT * n // 100) + 1]], sig, n


def _short(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - 8 * TOKEN_BYTES)


def _prefix_tokens(batches: Iterator[pa.RecordBatch], counters, slices: int) -> Iterator[pa.RecordBatch]:
    """(slice, tokens): leading bytes of the sets' prefix members, by range; what a task meets again comes twice."""
    make, seen, held, size = Shingler(), set(), [], 0

    def packed_slices() -> pa.RecordBatch:
        values, n = np.unique(_short(np.concatenate(held)), return_counts=True)
        values = np.repeat(values, np.minimum(n, 2))
        own = values * np.uint64(slices) >> np.uint64(8 * TOKEN_BYTES)
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        body = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
        parts = [body[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(own[cuts[:-1]].astype(np.int32)), pa.array(parts, pa.binary())], names=["slice", "tokens"])

    for batch in batches:
        for prefix, _, _ in _prefixes(batch.column("text"), counters.value, seen, make):
            held.append(prefix)
            size += len(prefix)
            if size >= CHUNK:
                yield packed_slices()
                held, size = [], 0
    if held:
        yield packed_slices()


def _repeated_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mixed leading bytes of the members that come more than once; slices arrive whole and in order."""
    last, held = None, []

    def again() -> pa.RecordBatch:
        body = np.frombuffer(b"".join(held), np.uint8).reshape(-1, TOKEN_BYTES)
        values = np.zeros((len(body), 8), np.uint8)
        values[:, :TOKEN_BYTES] = body
        values, n = np.unique(values.view("<u8").ravel(), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(mixed(values[n > 1])))], names=["token"])

    for batch in batches:
        for own, tokens in zip(batch.column("slice").to_pylist(), batch.column("tokens").to_pylist()):
            if own != last and held:
                yield again()
                held = []
            last = own
            held.append(tokens)
    if held:
        yield again()


def repeated_filter(documents: DataFrame, counters) -> np.ndarray:
    """Filter of the prefix members that more than one set may hold; a member of one set only makes no list.

    Only leading bytes are shuffled for it. Members that agree in them, and copies of a set in several tasks, let more
    members through; none that two sets hold is left out.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = documents.select("text").mapInArrow(lambda b: giving_back(_prefix_tokens(b, counters, parts * SLICES)), "slice int, tokens binary")
    repeated = tokens.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(lambda b: giving_back(_repeated_tokens(b)), "token long")
    return bit_filter(stage(repeated, "repeated"), "token", FILTER_BITS)


def _postings(batches: Iterator[pa.RecordBatch], counters, repeated) -> Iterator[pa.RecordBatch]:
    """(token, sig, size, place) of the members of each set's prefix that may be repeated; a set once per task."""
    make, seen = Shingler(), set()
    for batch in batches:
        tokens, sigs, sizes, places = [], [], [], []
        for prefix, sig, n in _prefixes(batch.column("text"), counters.value, seen, make):
            place = np.flatnonzero(in_filter(mixed(_short(prefix)), repeated.value))
            tokens.append(prefix[place])
            sigs.append(np.full(len(place), sig))
            sizes.append(np.full(len(place), n))
            places.append(place)
        if tokens:
            columns = [signed(np.concatenate(tokens)), np.concatenate(sigs), np.concatenate(sizes).astype(np.int32), np.concatenate(places).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "sig", "size", "place"])


def _possible(size_a, place_a, size_b, place_b):
    """Whether two sets that share a prefix member at these places can be linked, as far as sizes and places tell."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    rest = np.minimum(size_a - place_a, size_b - place_b)
    # The common members before a shared one are at most the smaller place.
    return (100 * low >= PERCENT * high) & (np.minimum(place_a, place_b) + rest >= shared_least(size_a, size_b))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], flush: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first column, in pieces that never part equal values of it."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        rows += batch.num_rows
        if rows >= flush:
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            if cut:
                yield [c[:cut] for c in whole]
            held, rows = [[c[cut:] for c in whole]], len(whole[0]) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def _size_class(size: np.ndarray) -> np.ndarray:
    """Sets of one class are not too different in size to be linked."""
    return np.floor(np.log(size) / np.log(100 / PERCENT)).astype(np.int32)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by token, size and signature to list entries with their leader.

    A list falls into classes of size; the first set of a class leads it. Only the last entry and its leader are
    carried from batch to batch, so a list of any length needs no memory. Repeated sets (equal token and
    sig) are left out, and so are sets whose neighbours by size in the list are both too
    small or large to be linked with them: then all are.
    """
    names = ["token", "sig", "size", "place"]
    carried: list[np.ndarray] = []  # the last entry, not handed on yet
    lead: list[np.ndarray] = []  # its leader's sig, size and place
    before = False  # whether the entry before it is near in size

    def entries(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carried, lead, before
        token, sig, size, place = columns
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig, size, place = (c[new] for c in columns)
        kind = _size_class(size)
        begins = np.ones(len(token), bool)
        begins[1:] = (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
        leads = [c[at] for c in (sig, size, place)]
        if lead:
            own = at == 0
            leads = [np.where(own, x, c) for x, c in zip(lead, leads)]
        near = (token[1:] == token[:-1]) & (100 * size[:-1] >= PERCENT * size[1:])
        keep = np.concatenate([[before], near]) | np.concatenate([near, [False]])
        if not last:
            keep[-1] = False
            carried, lead, before = [c[-1:] for c in (token, sig, size, place)], [c[-1:] for c in leads], bool(near[-1]) if len(near) else before
        possible = _possible(size, place, leads[1], leads[2]) & (sig != leads[0])
        out = [token, sig, size.astype(np.int32), place.astype(np.int32), leads[0], leads[1].astype(np.int32), possible]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], names=[*names, "lead", "lead_size", "possible"])

    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            yield from entries([np.concatenate(c) for c in zip(carried, columns)] if carried else columns, False)
    if carried:
        yield from entries(carried, True)


def _wanted_sets(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """(sig, members) of the sets in the filter, each once per task."""
    make, seen = Shingler(), set()
    for batch in batches:
        for _, at, raw in utf8_steps(batch.column("text")):
            sets = [s for s in make.sets(at, raw) if len(s)]
            sigs = np.array([signature(s) for s in sets], np.int64)
            rows = []
            for i in np.flatnonzero(in_filter(sigs.view(np.uint64), bits.value)):
                sig = int(sigs[i])
                if sig not in seen:
                    rows.append((sig, packed(sets[i])))
                    if len(seen) < 1 << 20:
                        seen.add(sig)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["sig", "members"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for a, b in zip(batch.column("x"), batch.column("y")):
            n.append(len(np.intersect1d(unpacked(a), unpacked(b), assume_unique=True)))
        sizes = [pa.array([members_of(len(v.as_buffer())) for v in batch.column(c)], pa.int64()) for c in ("x", "y")]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes, pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "common"])


def listed_sets(documents: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sig, members) of the sets with one of the distinct ``sigs(sig)``, written once in buckets of ``sig``.

    A filter of bounded size tells the tasks which sets are wanted, so texts are read again but only wanted
    sets are shuffled; a fuller filter lets more through, the join decides. Later joins move no set to find it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(sigs, "sig", FILTER_BITS))
    sets = documents.select("text").mapInArrow(lambda b: giving_back(_wanted_sets(b, shared)), "sig long, members binary")
    return stage_bucketed(sets.join(sigs, "sig", "left_semi").groupBy("sig").agg(F.first("members").alias("members")), "sets", "sig")


def measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, common) for distinct ``pairs(a, b)`` of signatures, from the sets themselves."""
    return stage(_with_members(sets, pairs).mapInArrow(lambda b: giving_back(_common(b)), "a long, b long, na long, nb long, common long"), "measured")


def _with_members(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs with the members of both sets. The sets lie in buckets of their signature, so of them only those
    of side b move, to the bucket of their a."""
    x = sets.select(F.col("sig").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("sig").alias("b"), F.col("members").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("common") * 100 >= F.lit(PERCENT) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each list, pairs of sets of different components that sizes, places and the leader leave open, with the number
    of lists that hold them and the least number that linked sets are in together. A list may drop a pair that cannot be linked.

    If both sets' distances to a common leader were measured, by the triangle inequality
    of the Jaccard distance a pair whose distances differ by more than the limit cannot be linked.
    """
    limit = 1 - PERCENT / 100 + 1e-9
    columns = ["token", "root", "sig", "size", "place", "weight", "lead", "family", "distance"]

    def pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, n, need = np.concatenate(found, 1)
        order = np.lexsort((b, a))
        a, b, n, need = a[order], b[order], n[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], np.add.reduceat(n, first), need[first])], names=["a", "b", "n", "need"])

    for token, root, sig, size, place, weight, lead, family, distance in _runs(batches, columns, BLOCK):
        size = size.astype(np.int64)
        measured_lead = ~np.isnan(distance)
        border = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        found: list[np.ndarray] = []
        n = 0
        for a, b in zip(border[:-1], border[1:]):
            groups = np.flatnonzero(np.concatenate([[True], root[a + 1 : b] != root[a : b - 1], [True]])) + a
            for start, end in zip(groups[:-2], groups[1:-1]):  # against all later components
                for i in range(start, end):
                    later = slice(end, b)
                    far = (lead[later] == lead[i]) & (np.abs(distance[i] - distance[later]) > limit)
                    told = far | (family[later] == family[i]) | (lead[later] == sig[i]) & measured_lead[later] | (sig[later] == lead[i]) & measured_lead[i]
                    open_ = _possible(size[i], place[i], size[later], place[later]) & ~told
                    other = sig[later][open_]
                    if len(other):
                        need = least_prefix(size[later][open_], size[i])
                        found.append(np.stack([np.minimum(other, sig[i]), np.maximum(other, sig[i]), np.full(len(other), weight[i]), need]))
                        n += len(other)
                        if n >= PAIRS:
                            yield pair_batch(found)
                            found, n = [], 0
        if found:
            yield pair_batch(found)


def link_sets(documents: DataFrame) -> DataFrame:
    """(sig, root) of all different sets that are linked with another, directly or through others.

    Sets are linked from ``PERCENT`` of their union on. Members are ordered by the frequency counters, rarest
    first; linked sets share a member of their prefixes. Per member that several sets hold a list of its sets is made:

    Lists of the same sets are one list that counts as many, and sets that are in too few lists to be linked go (``linkable_entries``).

    1. In each list the leader of a class of size is compared with the other sets of the class that it often leads. Sizes and places in
       the prefixes skip pairs without reading a set; the others are measured exactly, each pair once.
    2. Sets that are often listed with the same central set are its family. Each is compared with it once and kept
       as what it drops and adds; all answers within the family follow from these differences, without
       the sets and without listing pairs.
    3. Only pairs of different components and families are still open; by the distances to the first leader and by the number of
       lists that hold both (``least_prefix``) many are answered without a comparison, the rest is measured exactly.

    So the pairs of a large group of copies, near or not so near, are never listed.
    """
    counters = documents.sparkSession.sparkContext.broadcast(frequency_counters(documents))
    repeated = documents.sparkSession.sparkContext.broadcast(repeated_filter(documents, counters))
    postings = documents.select("text").mapInArrow(lambda b: giving_back(_postings(b, counters, repeated)), "token long, sig long, size int, place int")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.repartition(parts, "token").sortWithinPartitions("token", "size", "sig")
    every = "token long, sig long, size int, place int, lead long, lead_size int, possible boolean"
    lists = linkable_entries(stage_bucketed(ordered.mapInArrow(lambda b: giving_back(_lists(b)), every), "all-lists", "token"))
    sets = listed_sets(documents, lists.select("sig").distinct())
    # A leader that is met in few lists is left to the open pairs, where all lists count.
    met = lists.where("possible").groupBy(F.col("lead").alias("a"), F.col("sig").alias("b")).agg(F.sum("weight").alias("n"), F.min(_least_prefix("lead_size", "size")).alias("need"))
    done = stage(met.where(F.col("n") * LENIENT >= F.col("need")).select("a", "b"), "pairs")
    first = measured(sets, done)
    links = _linked(first)
    families = stage(family_differences(sets, _open_entries(lists, components(links))), "families")
    links = stage(links.union(family_links(families)), "links")
    kin = families.select("sig", F.col("lead").alias("family"))
    known = first.select(F.col("a").alias("lead"), F.col("b").alias("sig"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("distance"))
    entries = _open_entries(lists, components(links)).join(known, ["lead", "sig"], "left").join(kin, "sig", "left")
    # No number stands for a distance that was not measured; it closes nothing.
    distance = F.when(F.col("sig") == F.col("lead"), 0.0).otherwise(F.coalesce("distance", F.lit(float("nan"))))
    entries = entries.select("token", "root", "sig", "size", "place", "weight", "lead", F.coalesce("family", "sig").alias("family"), distance.alias("distance"))
    open_pairs = entries.repartition(parts, "token").sortWithinPartitions("token", "root", "sig").mapInArrow(lambda b: giving_back(_other_pairs(b)), "a long, b long, n long, need long")
    open_pairs = open_pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    open_pairs = stage(open_pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    return components(links.union(_linked(measured(sets, open_pairs))))


def _least_prefix(a: str, b: str) -> Column:
    """``least_prefix`` of two columns of sizes."""
    larger = F.greatest(a, b).cast("long")
    least = F.ceil((F.col(a).cast("long") + F.col(b)) * PERCENT / F.lit(float(100 + PERCENT)))
    return least + 1 - F.ceil(larger * PERCENT / F.lit(100.0))


def linkable_entries(lists: DataFrame) -> DataFrame:
    """Entries of ``lists``, in buckets of their token, that may link two sets, with the ``weight`` of their list.

    Neighbouring shingles are mostly held by the same sets. Of lists of the same sets that with the smallest token stays, and
    weighs as many as they are: its places hold for all its pairs. Linked sets share ``least_prefix`` lists at least, so a set
    that is in fewer lists than its linked sets of the sizes met there would need, can be linked with none and goes.
    """
    marks = [F.bit_xor(F.xxhash64("sig", F.lit(k))).alias(f"h{k}") for k in range(2)]
    content = lists.groupBy("token").agg(*marks, F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    chosen = content.groupBy("h0", "h1", "n").agg(F.min("token").alias("token"), F.count("*").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    entries = stage(lists.join(chosen.drop("h0", "h1", "n"), "token"), "lists")
    # What is needed is least for the sizes that differ most, but for what rounding adds, 1 at most.
    low = F.greatest("low", F.ceil(F.col("size") * PERCENT / F.lit(100.0)).cast("int")).alias("low")
    high = F.least("high", F.floor(F.col("size") * 100 / F.lit(float(PERCENT))).cast("int")).alias("high")
    needed = entries.select("sig", "weight", "size", low, high).select("sig", "weight", (F.least(_least_prefix("size", "low"), _least_prefix("size", "high")) - 1).alias("need"))
    some = needed.groupBy("sig").agg(F.sum("weight").alias("n"), F.min("need").alias("need")).where("n >= need").select("sig")
    return stage(entries.drop("low", "high").join(some, "sig"), "linkable")


def family_differences(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """(lead, sig, size, dropped, added): each set of a family as its difference from the family's central set.

    In each list the most central set leads: the original of many near copies has no rare members of its own, so it is in
    long lists all along its prefix. A set belongs to the leader that it meets in most lists, if it keeps
    half of it. The central set is one of its family, without differences.
    """
    lengths = entries.groupBy("token").agg(F.count("*").alias("length"))
    central = entries.join(lengths, "token").groupBy("sig").agg((F.sum(F.col("length") * F.col("weight")) / F.max("size")).alias("central"))
    rank = F.struct(-F.col("central"), F.col("sig").alias("lead"))
    entries = entries.select("token", "sig", "weight").join(central, "sig")
    chosen = entries.groupBy("token").agg(F.min(rank)["lead"].alias("lead"))
    votes = entries.join(chosen, "token").where("sig <> lead").groupBy("sig", "lead").agg(F.sum("weight").alias("n"))
    pairs = votes.groupBy("sig").agg(F.max(F.struct("n", "lead"))["lead"].alias("lead"))
    pairs = stage(pairs, "kin")
    # A leader may follow a more central one; its family goes with it.
    up = pairs.select(F.col("sig").alias("lead"), F.col("lead").alias("next"))
    for _ in range(FOLLOWED):
        pairs = pairs.join(up, "lead", "left").select("sig", F.coalesce("next", "lead").alias("lead"))
    pairs = stage(pairs, "kin")
    leads = pairs.select("lead").distinct()
    pairs = pairs.join(leads.withColumnRenamed("lead", "sig"), "sig", "left_anti").select(F.col("lead").alias("a"), F.col("sig").alias("b"))
    both = _with_members(sets, pairs)
    return both.mapInArrow(lambda b: giving_back(_differences(b)), "lead long, sig long, size long, dropped binary, added binary")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = np.empty(0, np.uint64).tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for lead, sig, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y"))):
            x, y = unpacked(x), unpacked(y)
            dropped = np.setdiff1d(x, y, assume_unique=True)
            if 2 * len(dropped) <= len(x):
                rows.append((lead.as_py(), sig.as_py(), len(x), dropped.tobytes(), np.setdiff1d(y, x, assume_unique=True).tobytes()))
                rows.append((lead.as_py(), lead.as_py(), len(x), empty, empty))
        if rows:
            rows = list(dict.fromkeys(rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lead", "sig", "size", "dropped", "added"])


def family_links(families: DataFrame) -> DataFrame:
    """(a, b): links within families that connect as much as all of them.

    Members linked with the central set are one part by that, which their differences tell without another comparison.
    Only members outside this part are compared, with each other and with it, in blocks of bounded size: pairs of blocks
    within the part are never formed, so a family of copies costs a row a member.
    """
    families = families.dropDuplicates(["lead", "sig"])
    dropped, added = F.length("dropped") / 8, F.length("added") / 8
    inside = 100 * (F.col("size") - dropped) >= PERCENT * (F.col("size") + added)
    families = stage(families.withColumn("inside", inside), "family-parts")
    told = families.where("inside AND sig <> lead").select(F.least("lead", "sig").alias("a"), F.greatest("lead", "sig").alias("b"))
    weight = F.length("dropped") + F.length("added")

    def blocks(side: Column) -> Column:
        n = F.greatest(F.count_if(side) / FAMILY_BLOCK, F.sum(F.when(side, weight).otherwise(0)) / FAMILY_BYTES)
        return F.when(F.count_if(side) > 0, F.greatest(F.ceil(n), F.lit(1))).otherwise(0).cast("int")

    counts = families.groupBy("lead").agg(blocks(F.col("inside")).alias("linked"), blocks(~F.col("inside")).alias("apart")).where("apart > 0")
    members = families.join(counts, "lead")
    n = F.when(F.col("inside"), F.col("linked")).otherwise(F.col("apart"))
    members = members.withColumn("own", F.pmod(F.xxhash64("sig"), n).cast("int"))

    def numbers(upto: str) -> Column:
        return F.when(F.col(upto) > 0, F.sequence(F.lit(0), F.col(upto) - 1)).otherwise(F.array().cast("array<int>"))

    cross_inside = F.transform(numbers("apart"), lambda o: F.xxhash64("lead", F.lit(0), F.col("own"), o))
    cross_apart = F.transform(numbers("linked"), lambda o: F.xxhash64("lead", F.lit(0), o, F.col("own")))
    among = F.transform(numbers("apart"), lambda o: F.xxhash64("lead", F.lit(1), F.least(F.col("own"), o), F.greatest(F.col("own"), o)))
    pair = F.explode(F.when(F.col("inside"), cross_inside).otherwise(F.concat(cross_apart, among))).alias("pair")
    dealt = members.select(pair, "lead", "sig", "size", "dropped", "added", "inside")
    parts = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return told.union(dealt.repartition(parts, "pair").sortWithinPartitions("pair", "lead", "sig").mapInArrow(lambda b: giving_back(_family_links(b)), "a long, b long"))


def _common_counts(rows: list[np.ndarray]) -> np.ndarray:
    """For each two rows the number of common members, from a bounded number of members at a time."""
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    _, inverse, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    keep = n[inverse] > 1
    column, owner = (np.cumsum(n > 1) - 1)[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(rows), len(rows)))
    for first in range(0, int((n > 1).sum()), COLUMNS):
        here = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        part = np.zeros((len(rows), COLUMNS), np.float32)
        part[owner[here], column[here] - first] = 1
        out += part @ part.T
    return out


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets x and y with differences from c: |x & y| = |c| - |dropped by x or y| + |added by both|."""
    columns = ["pair", "lead", "sig", "size", "dropped", "added", "inside"]
    for pair, lead, sig, size, dropped, added, inside in _runs(batches, columns, FAMILY_BLOCK):
        edges = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (lead[1:] != lead[:-1]), [True]]))
        found: list[np.ndarray] = []
        for a, b in zip(edges[:-1], edges[1:]):
            less = [np.frombuffer(x, np.uint64) for x in dropped[a:b]]
            more = [np.frombuffer(x, np.uint64) for x in added[a:b]]
            n_less, n_more = np.array([len(x) for x in less]), np.array([len(x) for x in more])
            own = size[a:b] - n_less + n_more
            both = _common_counts(less) + _common_counts(more)
            up = np.arange(b - a)
            part = np.flatnonzero(inside[a:b].astype(bool))
            up[part] = part[:1] if len(part) else part
            for i in range(b - a):
                common = size[a] - n_less[i] - n_less[i + 1 :] + both[i, i + 1 :]
                hits = np.flatnonzero(100 * common >= PERCENT * (own[i] + own[i + 1 :] - common)) + i + 1
                # One link into every part that is not connected to this set yet.
                hits = hits[up[hits] != up[i]]
                tops, first = np.unique(up[hits], return_index=True)
                if len(tops):
                    found.append(np.stack([np.full(len(tops), sig[a + i]), sig[a + hits[first]]]))
                    up[np.isin(up, tops)] = up[i]
        if found:
            pairs = np.concatenate(found, 1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], names=["a", "b"])


def _open_entries(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries with their component, of the lists that have more than one."""
    entries = entries.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    several = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return entries.join(several, "token")


def jaccard_components(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row: the smallest key reachable by links, its own included.

    Rows of equal sets are linked. Texts of fewer words than a shingle are one shingle; null texts and texts
    without words have an empty set and link with nothing. A row with a null key takes part; a component
    of null keys only has a null id. Repeated rows come out as often as they are. An empty table gives
    no rows; other columns are not read. Equal sets are one set for the join, so copies are never paired.
    """
    documents = documents.select(key, "text")
    schema = keyed_schema(documents, key, "n_shingles long, sig long")
    rows = stage(documents.mapInArrow(lambda b: _signed_sets(b, key), schema), "signed")
    roots = link_sets(documents)
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min(key).alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("sig", "root").join(least, "root").select("sig", "component_id")
    some = rows.where("sig is not null").join(named, "sig").select(key, "n_shingles", "component_id")
    none = rows.where("sig is null").select(key, "n_shingles", F.col(key).alias("component_id"))
    return some.union(none)


def one_per_component(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows, with all columns, that stay: of each component the one with the smallest key (null last).

    Rows without words all stay; of rows that repeat a key and text one stays. Nearly all rows stay: only rows whose key is
    in a filter of the keys that lose or repeat a row are shuffled, and the exact join decides on these.
    """
    narrow = documents.select(key, "text").mapInArrow(lambda b: _signed_sets(b, key), keyed_schema(documents, key, "n_shingles long, sig long"))
    pairs = stage(narrow, "signed").where("sig is not null").groupBy("sig", key).agg(F.count("*").alias("n"))
    pairs = stage(pairs, "pairs-of-key")
    roots = link_sets(documents).withColumnRenamed("node", "sig")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "sig")).alias("first")
    classes = pairs.groupBy("sig").agg(first).join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    winners = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.sig").alias("_sig"), F.col("first.key").alias("_first"))
    winners = stage(winners, "winners")
    stays = (F.col("sig") == F.col("_sig")) & F.col(key).eqNullSafe(F.col("_first"))
    doubtful = pairs.where("n > 1").select("sig", key).union(pairs.select("sig", key).join(winners, stays, "left_anti"))
    hashed = F.xxhash64(F.col(key)).alias("_h")
    bits = bit_filter(stage(doubtful.select(hashed).distinct(), "doubtful"), "_h", FILTER_BITS)
    # Most texts are only read and written here: that takes no memory of a Python worker.
    sure, rest = (rows.select("_row") for rows in by_filter(documents.select(F.struct(*documents.columns).alias("_row"), hashed), "_h", bits))
    signed_rows = rest.mapInArrow(lambda b: _signed_sets(b, "_row"), keyed_schema(rest, "_row", "n_shingles long, sig long"))
    signed_rows = signed_rows.withColumn("_key", F.col(f"_row.{key}"))
    kept = signed_rows.join(winners, (F.col("sig") == F.col("_sig")) & F.col("_key").eqNullSafe(F.col("_first"))).dropDuplicates(["sig", "_key"])
    return sure.select("_row.*").union(kept.select("_row.*")).union(signed_rows.where("sig is null").select("_row.*"))


def op10_set_relation_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
