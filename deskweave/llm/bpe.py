"""Byte-level BPE with content-defined chunks: what documents share is encoded once, joins are repaired."""

from __future__ import annotations

import hashlib
import importlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from deskweave.llm.common import SpanHasher, bit_filter, giving_back, in_filter, read, signed, utf8_steps
from deskweave.operators.staging import stage

WINDOW = 32  # bytes that decide whether a chunk ends
CHUNK_BITS = 9  # a chunk ends after every 2**9th byte on average
LEAST_CHUNK = 64
MOST_FILTER_BITS = 1 << 27  # bound of the filter of shared chunks: 16 MB in each task
SEEN = 1 << 17  # digests that a task remembers
SPECIAL = ("<|endoftext|>", 50256)
LONG_BLANK = 100_000  # characters of white space that the pattern is not asked to match
# Characters of the Unicode property White_Space, which the pattern's \\s means.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)


def vocabulary_path() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.tiktoken")


class Codec:
    """The tokenizer of one ranks file (base64 token and rank per line); made once per Python worker."""

    def __init__(self, ranks: bytes) -> None:
        import base64

        import tiktoken

        # The pre-tokenizer's pattern, a fixed value of this kind of vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ids, special_tokens=dict([SPECIAL]))
        self.bytes = [b""] * (max(max(ids.values()), SPECIAL[1]) + 1)
        for token, i in [*ids.items(), (SPECIAL[0].encode(), SPECIAL[1])]:
            self.bytes[i] = token
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    @classmethod
    def of(cls, ranks: bytes) -> Codec:
        # Functions come to a worker by value, so what should outlive a task is kept in an imported module.
        import tiktoken

        held = tiktoken.__dict__.setdefault("_codecs_by_ranks", {})
        name = hashlib.sha256(ranks).digest()
        if name not in held:
            held[name] = cls(ranks)
        return held[name]

    def encode(self, text: str) -> np.ndarray:
        return self._encoded(text, "all")

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which the special token's string is ordinary text."""
        return self._encoded(text, set())

    def _encoded(self, text: str, special) -> np.ndarray:
        """White space before its last character is a token stretch of its own; very long ones are taken out before the
        pattern, which would try them character by character on a stack."""
        out, done = [np.empty(0, "<u4")], 0

        def add(part: str) -> None:
            if part:
                out.append(self.encoding.encode_to_numpy(part, allowed_special=special, disallowed_special=()).astype("<u4"))

        for run in LONG_BLANKS.finditer(text) if len(text) >= LONG_BLANK else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            add(text[done : run.start()])
            out.append(np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u4"))
            done = end
        add(text[done:])
        return np.concatenate(out) if len(out) > 2 else out[-1]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Chunker:
    """Ends of content-defined chunks: where the hash of the last bytes has zeros at its end."""

    def __init__(self) -> None:
        self.hasher = SpanHasher()

    def cuts(self, at: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """For each text its chunk borders, from 0 to its length; no border is inside a character."""
        ends = np.arange(WINDOW, len(raw) + 1)
        hashes = self.hasher(raw, ends - WINDOW, ends) if len(ends) else np.empty(0, np.uint64)
        ends = ends[(hashes & np.uint64((1 << CHUNK_BITS) - 1)) == 0]
        owner = np.searchsorted(at, ends, "left") - 1
        ends, owner = ends[ends - at[owner] >= WINDOW], owner[ends - at[owner] >= WINDOW]
        first = np.searchsorted(owner, np.arange(len(at)))
        out = []
        for i in range(len(at) - 1):
            size = int(at[i + 1] - at[i])
            borders = [0]
            for end in (ends[first[i] : first[i + 1]] - at[i]).tolist():
                while end < size and raw[at[i] + end] & 0xC0 == 0x80:
                    end += 1
                if end - borders[-1] >= LEAST_CHUNK and size > end:
                    borders.append(end)
            out.append(np.array([*borders, size]))
        return out

    def keyed(self, at: np.ndarray, raw: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Borders, hashes of all chunks, and how many chunks the texts before each text have."""
        cuts = self.cuts(at, raw)
        starts = np.concatenate([c[:-1] + at[i] for i, c in enumerate(cuts)])
        ends = np.concatenate([c[1:] + at[i] for i, c in enumerate(cuts)])
        return cuts, self.hasher(raw, starts, ends), np.concatenate([[0], np.cumsum([len(c) - 1 for c in cuts])])


def _chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunker = Chunker()
    for batch in batches:
        for _, at, raw in utf8_steps(batch.column("text")):
            hashes, n = np.unique(chunker.keyed(at, raw)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(n.astype(np.int64))], names=["hash", "n"])


def shared_filter(documents: DataFrame, before=iter) -> np.ndarray:
    """A filter of the hashes of all chunks that occur more than once in all texts that ``before`` makes of the batches.

    A fuller filter marks more chunks as shared: these are encoded once and joined for nothing, the
    result stays the same.
    """
    counts = documents.mapInArrow(lambda b: giving_back(_chunk_hashes(before(b))), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return bit_filter(stage(counts.where("n > 1").select("hash"), "chunks"), "hash", MOST_FILTER_BITS)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _alone(batches: Iterator[pa.RecordBatch], bits, key: str) -> Iterator[pa.RecordBatch]:
    """The rows without a chunk in the filter."""
    chunker = Chunker()
    for batch in batches:
        for first, at, raw in utf8_steps(batch.column("text")):
            _, hashes, before = chunker.keyed(at, raw)
            marked = np.add.reduceat(in_filter(hashes, bits.value).astype(np.int64), before[:-1]) > 0
            index = pa.array(np.flatnonzero(~marked) + first)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(index) for c in (key, "text")], names=[key, "text"])


def _sharing(batches: Iterator[pa.RecordBatch], bits, key: str) -> Iterator[pa.RecordBatch]:
    """The other rows: digest of the text, and the text compressed, as it is to be shuffled."""
    chunker = Chunker()
    for batch in batches:
        for first, at, raw in utf8_steps(batch.column("text")):
            _, hashes, before = chunker.keyed(at, raw)
            marked = np.add.reduceat(in_filter(hashes, bits.value).astype(np.int64), before[:-1]) > 0
            texts = [raw[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(marked)]
            columns = [pa.array([_digest(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.flatnonzero(marked) + first)), *columns], names=[key, "digest", "size", "body"])


def _pieces(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """(digest, place, chunk, body) of all shared chunks of a text; a text, and the body of a chunk, once per task
    as far as a bounded memory of what was seen goes."""
    chunker = Chunker()
    texts: set[bytes] = set()
    chunks: set[bytes] = set()
    for batch in batches:
        for _, at, raw in utf8_steps(batch.column("text")):
            cuts, hashes, before = chunker.keyed(at, raw)
            hit = in_filter(hashes, bits.value)
            rows: list[tuple] = []
            for i in range(len(at) - 1):
                places = np.flatnonzero(hit[before[i] : before[i + 1]]).tolist()
                if not places:
                    continue
                digest = _digest(raw[at[i] : at[i + 1]].tobytes())
                if digest in texts:
                    continue
                if len(texts) < SEEN:
                    texts.add(digest)
                for place in places:
                    body = raw[at[i] + cuts[i][place] : at[i] + cuts[i][place + 1]].tobytes()
                    chunk = _digest(body)
                    rows.append((digest, place, chunk, None if chunk in chunks else body))
                    if len(chunks) < SEEN:
                        chunks.add(chunk)
            if rows:
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["digest", "place", "chunk", "body"])


def _encoded(batches: Iterator[pa.RecordBatch], ranks, key: str, text: str) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(ranks.value)
    for batch in batches:
        keys = batch.column(key)
        # A chunk's border is never inside a character, so its bytes are valid UTF-8.
        texts = batch.column(text).cast(pa.large_binary()).cast(pa.large_string())
        for first, at, raw in utf8_steps(texts):
            body = raw.tobytes()
            ids = [codec.encode(body[at[i] : at[i + 1]].decode()).tobytes() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), pa.array(ids, pa.binary())], names=[key, "ids"])


def _safe(data: bytes) -> np.ndarray:
    """Offsets of spaces between two visible ASCII characters: a token begins there whatever surrounds it."""
    raw = np.frombuffer(data, np.uint8)
    visible = (raw > 0x20) & (raw < 0x7F)
    return np.flatnonzero((raw[1:-1] == 0x20) & visible[:-2] & visible[2:]) + 1 if len(raw) > 2 else np.empty(0, np.int64)


def joined_ids(codec: Codec, data: bytes, borders: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Ids of the whole text from the ids of some of its chunks (``known``, by chunk number).

    Of a known chunk the tokens between its first and last point of agreement stay: a safe offset at which the
    chunk's own tokens have a border too. Text between two such runs, with the joins in it, is encoded
    again from agreement to agreement. A chunk without two points of agreement is encoded with its neighbours.
    """
    out: list[np.ndarray] = []
    done = 0
    for place in sorted(known):
        start, end = int(borders[place]), int(borders[place + 1])
        ids = known[place]
        ends = np.concatenate([[0], np.cumsum(codec.length[ids])])
        if ends[-1] != end - start:
            continue
        agreed = np.intersect1d(_safe(data[start:end]), ends, assume_unique=False)
        if len(agreed) < 2 or start + agreed[0] < done:
            continue
        low, high = int(agreed[0]), int(agreed[-1])
        out.append(codec.encode(data[done : start + low].decode()))
        out.append(ids[np.searchsorted(ends, low) : np.searchsorted(ends, high)])
        done = start + high
    out.append(codec.encode(data[done:].decode()))
    return np.concatenate(out).astype("<u4")


def _joined(batches: Iterator[pa.RecordBatch], ranks, key: str) -> Iterator[pa.RecordBatch]:
    codec, chunker = Codec.of(ranks.value), Chunker()
    for batch in batches:
        bodies, sizes, parts = batch.column("body"), batch.column("size"), batch.column("parts")
        for first in range(0, batch.num_rows, 64):
            rows = range(first, min(first + 64, batch.num_rows))
            texts = [pa.decompress(bodies[i].as_buffer(), sizes[i].as_py(), "zstd", asbytes=True) for i in rows]
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            cuts = chunker.cuts(at, np.frombuffer(b"".join(texts), np.uint8))
            ids = []
            for i, text, borders in zip(rows, texts, cuts):
                known = {p["place"]: np.frombuffer(p["ids"], "<u4") for p in parts[i].as_py() or ()}
                ids.append(joined_ids(codec, text, borders, known).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, len(ids)), pa.array(ids, pa.binary())], names=[key, "ids"])


def encode(documents: DataFrame, ranks_path: str | None = None, key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids) for every row of ``documents(key, text)``: ids as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded in the same task, as ``decode`` does, into a column of that name.

    The same ids as one pass of the tokenizer over the whole text gives, the special token's string included.

    1. Chunks of all texts are counted by hash (8 bytes a chunk are shuffled); those that occur twice or more
       form a filter of bounded size.
    2. A text without such a chunk is encoded where it is read; it is never shuffled.
    3. The shared chunks are made distinct and encoded once. Each of the other texts gets the ids of its
       shared chunks, by digest, and re-encodes what is between them until both sides agree (``joined_ids``).

    Hot chunks and hot texts are folded map-side before they move. Null and empty texts have no ids. A null
    key stays null; repeated rows are encoded each; an empty table gives no rows; other columns are not read.
    ``ranks_path`` (driver's file, under a megabyte) is sent to the tasks by value.
    """
    return _encode(documents.select(key, "text"), documents.select("text"), key, documents.schema[key].dataType, ranks_path, decoded)


def _encode(documents: DataFrame, texts: DataFrame, key: str, kind: DataType, ranks_path: str | None, decoded: bool = False, before=iter) -> DataFrame:
    """``encode`` for the rows (key of type ``kind``, text) that ``before`` makes of the batches of ``documents``, and of ``texts``
    where the key is not needed. Steps that follow each other share one Python worker instead of one each."""
    spark = documents.sparkSession
    with open(ranks_path or vocabulary_path(), "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    bits = spark.sparkContext.broadcast(shared_filter(texts, before))
    keyed = lambda rest: StructType([StructField(key, kind), *StructType.fromDDL(rest).fields])
    ids = keyed("ids binary, decoded string" if decoded else "ids binary")

    def finished(encoded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return giving_back(_decoded(encoded, ranks) if decoded else encoded)

    alone = documents.mapInArrow(lambda b: finished(_encoded(_alone(before(b), bits, key), ranks, key, "text")), ids)
    pieces = texts.mapInArrow(lambda b: giving_back(_pieces(before(b), bits)), "digest binary, place int, chunk binary, body binary")
    pieces = stage(pieces, "pieces")
    bodies = pieces.where("body is not null").groupBy("chunk").agg(F.first("body").alias("body"))
    chunks = stage(bodies.mapInArrow(lambda b: giving_back(_encoded(b, ranks, "chunk", "body")), "chunk binary, ids binary"), "chunk-ids")
    places = pieces.select("digest", "place", "chunk").dropDuplicates(["digest", "place"])
    parts = places.join(chunks, "chunk").groupBy("digest").agg(F.collect_list(F.struct("place", "ids")).alias("parts"))
    sharing = documents.mapInArrow(lambda b: giving_back(_sharing(before(b), bits, key)), keyed("digest binary, size long, body binary"))
    return alone.union(sharing.join(parts, "digest", "left").mapInArrow(lambda b: finished(_joined(b, ranks, key)), ids))


def _folded(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows that repeat the one before them are counted instead."""
    for batch in batches:
        keys, texts = batch.column(key), batch.column("text")
        same = np.zeros(batch.num_rows, bool)
        if batch.num_rows > 1:
            for column in (keys, texts):
                null = column.is_null().to_numpy(zero_copy_only=False)
                equal = pa.compute.equal(column.slice(1), column.slice(0, batch.num_rows - 1)).fill_null(False).to_numpy(zero_copy_only=False)
                equal |= null[1:] & null[:-1]
                same[1:] = equal if column is keys else same[1:] & equal
        first = np.flatnonzero(~same)
        times = np.diff(np.append(first, batch.num_rows))
        index = pa.array(first)
        row = pa.StructArray.from_arrays([keys.take(index), pa.array(times, pa.int64())], names=["key", "times"])
        yield pa.RecordBatch.from_arrays([row, texts.take(index)], names=["_key", "text"])


def encode_repeated(documents: DataFrame, ranks_path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``encode`` for tables in which a row is followed by its copies, as a mix writes them: the copies are encoded once, do
    not count as shared chunks, and come back as often as they were."""
    rows = documents.select(key, "text")
    struct = StructType([StructField("key", rows.schema[key].dataType), StructField("times", LongType())])
    out = _encode(rows, rows, "_key", struct, ranks_path, before=lambda b: _folded(b, key))
    return out.select(F.col("_key.key").alias(key), "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_key.times")))).drop("col")


def _decoded(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(ranks.value)
    for batch in batches:
        ids = batch.column("ids")
        for first in range(0, batch.num_rows, 256):
            some = batch.slice(first, 256)
            texts = [codec.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in ids.slice(first, 256)]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, "decoded"])


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ``ids``; null ids give an empty text."""
    with open(ranks_path or vocabulary_path(), "rb") as file:
        ranks = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(lambda b: _decoded(b, ranks), schema)


def digests(documents: DataFrame) -> DataFrame:
    both = encode(documents, decoded=True)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
