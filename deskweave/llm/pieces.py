"""SentencePiece merge vocabularies: a score-ordered agenda of adjacent symbol pairs, checked against the library.

Symbols begin as characters. The agenda always takes the adjacent pair whose joined string is the piece with the
highest score, the leftmost one on ties. No piece has a space after another character, so a text falls apart
into words (spaces and what follows them) that cannot influence each other. Equal words of a step are worked
off once, all distinct ones side by side: each round pops the top of every word's agenda. Words too long for that
have a heap of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import importlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.llm.common import SpanHasher, keyed_schema, read

SPACE = "▁"  # how pieces write a space
STEP = 1 << 21  # bytes of text worked on at once; a longer text is cut between words
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32)  # symbols of a word in one matrix; longer words use a heap
NONE = np.int32(2**31 - 1)


def model_path() -> str:
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Table:
    """Byte strings one after the other, to be gathered by number."""

    def __init__(self, items: list[bytes]) -> None:
        self.length = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[ragged(self.start[ids], self.length[ids])]


class Pieces:
    """The tokenizer of one model file; made once per Python worker."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, n = self.library, self.library.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        merging = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in range(n)) or any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in merging):
            raise ValueError("Models with unused pieces, or with a space inside a piece, are not supported.")
        if sp.normalize(f" a  {SPACE}Ａﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}{SPACE}Ａﬁ{SPACE}":
            raise ValueError("Only models that add a leading space and change no other character are supported.")
        bytes_of = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(bytes_of) != 256:
            raise ValueError("Only models with a piece for every byte are supported.")
        self.byte_id = np.array([bytes_of[b] for b in range(256)], np.int32)
        self.size = n
        # Symbols: ids of pieces; a character without a piece is its code point above all ids.
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        ids = {pieces[i]: i for i in merging}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_char[0x20] = self.of_char[ord(SPACE)]

        def symbol(s: str) -> int | None:
            return ids.get(s, int(self.of_char[ord(s)]) if len(s) == 1 else None)

        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in merging}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([*(pairs[k][0] for k in self.keys.tolist()), NONE], np.int32)
        self.merged = np.array([*(pairs[k][1] for k in self.keys.tolist()), -1], np.int32)
        of_rank: dict[int, set[int]] = {}
        for rank, i in pairs.values():
            of_rank.setdefault(rank, set()).add(i)
        # -1 where pieces share a score.
        self.piece_of_rank = np.array([min(of_rank[k]) if len(of_rank.get(k, ())) == 1 else -1 for k in range(len(order))], np.int32)
        surface = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b, i in bytes_of.items():
            surface[i] = bytes([b])
        self.surface = Table(surface)
        self.decimal = Table([b"%d," % i for i in range(n)])
        self.hasher = SpanHasher()

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        # Functions come to a worker by value, so what should outlive a task is kept in an imported module.
        import sentencepiece

        held = sentencepiece.__dict__.setdefault("_pieces_by_model", {})
        name = hashlib.sha256(model).digest()
        if name not in held:
            held[name] = cls(model)
        return held[name]

    # --- The agenda -----------------------------------------------------------------------------

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where pairs of symbols stand in the table of pairs; its last entry stands for no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def by_heap(self, symbols: list[int]) -> list[int]:
        """The agenda of one word as a heap of (rank, place); stale entries are passed over."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (hit := self.pairs.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(agenda, (hit[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.pairs[left << 32 | right][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            propose(before[i])
            propose(i)
        return [s for s in symbols if s >= 0]

    def by_matrix(self, rows: np.ndarray) -> np.ndarray:
        """The agendas of many words side by side, in place; ``rows`` holds -1 after a word's last symbol.

        Every round merges one pair in each word that still has one, so the matrix gets a column narrower.
        """
        ranks = self.rank[self._found(rows[:, :-1], rows[:, 1:])]
        ranks[rows[:, 1:] < 0] = NONE
        live, work = np.arange(len(rows)), rows
        while True:
            width = work.shape[1]
            every = np.arange(len(live))
            top = ranks.argmin(axis=1) if width > 1 else np.zeros(len(live), np.int64)
            best = ranks[every, top] if width > 1 else np.full(len(live), NONE)
            open_ = best < NONE
            if not open_.all():
                rows[live[~open_], :width] = work[~open_]
                rows[live[~open_], width:] = -1
                live, work, ranks, top, best = live[open_], work[open_], ranks[open_], top[open_], best[open_]
                every = np.arange(len(live))
            if not len(live):
                return rows
            joined = self.piece_of_rank[best]
            several = np.flatnonzero(joined < 0)
            joined[several] = self.merged[self._found(work[several, top[several]], work[several, top[several] + 1])]
            work = work[np.arange(width) != top[:, None] + 1].reshape(len(live), width - 1)
            ranks = ranks[np.arange(width - 1) != top[:, None]].reshape(len(live), width - 2)
            work[every, top] = joined
            prior, next_ = np.flatnonzero(top > 0), np.flatnonzero(top < width - 2)
            ranks[prior, top[prior] - 1] = self.rank[self._found(work[prior, top[prior] - 1], joined[prior])]
            right = work[next_, top[next_] + 1]
            ranks[next_, top[next_]] = np.where(right < 0, NONE, self.rank[self._found(joined[next_], right)])

    def words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their symbols one after the other, as (ids, ids of each word)."""
        starts = np.cumsum(lengths) - lengths
        out: list[np.ndarray] = [np.empty(0, np.int32)]
        numbers: list[np.ndarray] = [np.empty(0, np.int64)]
        least = 0
        for width in WIDTHS:
            some = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if len(some):
                inside = np.arange(width) < lengths[some, None]
                rows = np.full((len(some), width), -1, np.int32)
                rows[inside] = symbols[ragged(starts[some], lengths[some])]
                rows = self.by_matrix(rows)
                kept = rows >= 0
                out.append(rows[kept])
                numbers.append(np.repeat(some, kept.sum(axis=1)))
        for i in np.flatnonzero(lengths > least).tolist():
            ids = self.by_heap(symbols[starts[i] : starts[i] + lengths[i]].tolist())
            out.append(np.array(ids, np.int32))
            numbers.append(np.full(len(ids), i))
        ids, of_word = np.concatenate(out), np.concatenate(numbers)
        turn = np.argsort(of_word, kind="stable")
        ids, of_word = ids[turn], of_word[turn]
        lost = np.flatnonzero(ids >= self.size)  # characters without a piece become their bytes
        if len(lost):
            chars = [chr(c).encode() for c in (ids[lost] - self.size).tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(c) for c in chars]
            places = ragged((np.cumsum(times) - times)[lost], times[lost])
            ids, of_word = np.repeat(ids, times), np.repeat(of_word, times)
            ids[places] = self.byte_id[np.frombuffer(b"".join(chars), np.uint8)]
        return ids, np.bincount(of_word, minlength=len(lengths))

    # --- Texts ----------------------------------------------------------------------------------

    def step(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part: bytes that begin with a space, spaces as blanks."""
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        at = np.concatenate([[0], np.cumsum(sizes)])
        blank = raw == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[at[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        _, first, word = np.unique(self.hasher(raw, starts, ends), return_index=True, return_inverse=True)
        length = ends - starts
        # Equal hashes are words of equal bytes; if ever not, every word is worked off by itself.
        same = length[first[word]] == length
        if not same.all() or not np.array_equal(raw[ragged(starts[first[word]], length)], raw):
            first = word = np.arange(len(starts))
        text = raw[ragged(starts[first], length[first])].tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ids, n = self.words(self.of_char[chars], (lead[ends] - lead[starts])[first])
        before = np.cumsum(n) - n
        flat = ids[ragged(before[word], n[word])]
        through = np.concatenate([[0], np.cumsum(n[word])])
        return np.split(flat, through[np.searchsorted(starts, at[1:-1])])

    def parts(self, parts: Iterable[bytes]) -> list[np.ndarray]:
        """``step`` of any number of parts, in runs of bounded size."""
        out: list[np.ndarray] = []
        run: list[bytes] = []
        size = 0
        for part in parts:
            if run and size + len(part) > STEP:
                out += self.step(run)
                run, size = [], 0
            run.append(part)
            size += len(part)
        return out + self.step(run) if run else out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as the library's ``encode`` gives them; null and empty texts have none."""
        owners: list[int] = []

        def cut() -> Iterator[bytes]:
            for i, text in enumerate(texts):
                if text:
                    for part in self.spans(f" {text}".replace(SPACE, " ").encode()):
                        owners.append(i)
                        yield part

        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, ids in zip(owners, self.parts(cut())):
            out[i].append(ids)
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces one after the other, without the leading space that encoding has added."""
        raw = self.surface.joined(ids).tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    @staticmethod
    def spans(data: bytes, limit: int = STEP) -> Iterator[bytes]:
        return cut_spans(data, limit)


def cut_spans(data: bytes, limit: int) -> Iterator[bytes]:
    """``data`` cut before spaces that follow another character, into spans of about ``limit`` bytes; a word stays whole."""
    begin = 0
    while len(data) - begin > limit:
        found = re.compile(rb"(?<=[^ ]) ").search(data, begin + limit)
        if not found:
            break
        yield data[begin : found.start()]
        begin = found.start()
    yield data[begin:]


def _batches_of(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in runs of bounded size, with the number of the first."""
    texts = texts.cast(pa.large_string())
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(texts):
        last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), 2 * STEP, "right")))
        yield first, texts.slice(first, last - first).to_pylist()
        first = last


def _coded(batches: Iterator[pa.RecordBatch], model, key: str) -> Iterator[pa.RecordBatch]:
    pieces = Pieces.of(model.value)
    for batch in batches:
        for first, texts in _batches_of(batch.column("text")):
            ids = pieces.encode(texts)
            library = pieces.library.encode([t or "" for t in texts], num_threads=1)
            columns = [
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                pa.array([pieces.decode(x) for x in ids], pa.string()),
                pa.array([hashlib.sha256(pieces.decimal.joined(x).tobytes()[:-1]).hexdigest() for x in ids], pa.string()),
                pa.array([x.tolist() == y for x, y in zip(ids, library)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, len(texts)), *columns], names=[key, "ids", "decoded", "ids_sha256", "agrees"])


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded, ids_sha256, agrees) for every row of ``documents(key, text)``.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` is their text, ``ids_sha256`` the digest of
    the decimal ids joined by commas, and ``agrees`` tells whether the library's own ids, taken for the same
    Arrow batch, are the same.

    Rows are worked off where they are read; nothing is shuffled. Null and empty texts have no ids and decode to
    an empty text. Very long texts are cut between words, a single word of any length is one heap. A null key
    stays null, repeated rows are encoded each, an empty table gives no rows, other columns are not read.
    ``path`` (driver's file, half a megabyte) is sent to the tasks by value.
    """
    with open(path or model_path(), "rb") as file:
        model = documents.sparkSession.sparkContext.broadcast(file.read())
    rows = documents.select(key, "text")
    return rows.mapInArrow(lambda b: _coded(b, model, key), keyed_schema(rows, key, "ids binary, decoded string, ids_sha256 string, agrees boolean"))


def digests(documents: DataFrame) -> DataFrame:
    return encode(documents).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids_sha256",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees",
    )


def op12_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
