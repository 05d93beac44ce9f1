"""Byte-level BPE in linear time: longest matches, backtracking, memoised compatibility.

A text is cut by a pattern; each piece becomes a Latin-1 string of its UTF-8 bytes, so that
``pyahocorasick`` (which works on text) finds every vocabulary entry in one pass. The encoder takes
the longest entry at each place; an entry may follow another only if merging by rank would have left
that border standing (``Merges.compatible``, remembered for each pair). Where nothing fits it goes
back to the entry before and takes the next shorter one. A place found dead is never tried again, so
the work is linear in the bytes. The ids equal those of merging by rank, step by step.

Defined results: a null text counts as empty (0 tokens, the digests of nothing); a null ``doc_id`` is
kept; repeated rows give repeated rows; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodelake.session import small_batches

#: Texts of these characters are cut by QUICK; others by the full pattern.
SAFE = re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7eÀ-ɏ–—‘-„…]*\\Z")
#: Pieces and pairs of entries that a task remembers, at most (some 150 MB).
CACHE, PAIRS = 150_000, 400_000
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"


def quick(pattern: str) -> re.Pattern:
    """The same pattern for Python's ``re``: right for texts that match SAFE."""
    return re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file in rank order; ranks must be 0, 1, 2 and so on."""
    ranked = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                entry, rank = line.split()
                ranked[int(rank)] = base64.b64decode(entry)
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks are not consecutive")
    return [ranked[i] for i in range(len(ranked))]


def merge_by_rank(piece: bytes, rank: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging, lowest rank first, with the ranks under ``below``: the definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """For each entry: the two entries it was merged from (itself twice, if a single byte)."""

    def __init__(self, entries: list[bytes]):
        rank = {e: i for i, e in enumerate(entries)}
        self.left, self.right = list(range(len(entries))), list(range(len(entries)))
        self.shorter = [-1] * len(entries)
        self.merged: dict[tuple[int, int], int] = {}
        for i, entry in enumerate(entries):
            for n in range(len(entry) - 1, 0, -1):
                if (p := rank.get(entry[:n], -1)) >= 0:
                    self.shorter[i] = p
                    break
            if len(entry) > 1 and len(parts := merge_by_rank(entry, rank, i)) == 2:
                self.left[i], self.right[i] = rank[parts[0]], rank[parts[1]]
                self.merged[self.left[i], self.right[i]] = i
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together ends with just these two entries.

        The merges are undone latest first; if at some moment the two entries that touch at the
        border could have merged before the next of them was made, the border would not stand.
        """
        if (found := self.known.get((a, b))) is not None:
            return found
        x, y, before, stands = a, b, len(self.left), True
        while True:
            made = self.merged.get((x, y))
            if made is not None and made < before:
                stands = False
                break
            x_open, y_open = self.left[x] != x, self.left[y] != y
            if not x_open and not y_open:
                break
            # At equal ranks the leftmost merge comes first, so the right one is undone first.
            if x_open and (not y_open or x > y):
                before, x = x, self.right[x]
            else:
                before, y = y + 1, self.left[y]
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[a, b] = stands
        return stands


class Encoder:
    """Encodes pieces, and remembers (ids as text, number of ids, decoded bytes) of short ones."""

    def __init__(self, entries: list[bytes], merges: Merges, pattern: str):
        import ahocorasick
        import regex

        self.entries, self.merges = entries, merges
        self.rank = {e: i for i, e in enumerate(entries)}
        self.length = [len(e) for e in entries]
        self.automaton = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            self.automaton.add_word(entry.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.full, self.quick = regex.compile(pattern), quick(pattern)
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n, length, shorter, compatible = len(piece), self.length, self.merges.shorter, self.merges.compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        out, dead, at, token = [], set(), 0, longest[0]
        while True:
            end = at + length[token]
            if end not in dead and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                if token >= 0:
                    continue
                raise ValueError("a byte is missing from the vocabulary")
            while (token := shorter[token]) < 0:
                dead.add(at)
                token = out.pop()
                at -= length[token]

    def pieces(self, text: str) -> list[str]:
        return (self.quick if SAFE.match(text) else self.full).findall(text)

    def digest(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.encode_piece(piece.encode())
        known = " ".join(map(str, ids)), len(ids), b"".join([self.entries[i] for i in ids])
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = known
        return known

    def digests(self, text: str) -> tuple[int, str, str]:
        cache, n, ids, decoded = self.cache, 0, [], []
        for piece in self.pieces(text):
            known = cache.get(piece) or self.digest(piece)
            ids.append(known[0])
            n += known[1]
            decoded.append(known[2])
        return n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()

    def ids(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.encode_piece(piece.encode())]


def _shared(docs: DataFrame, vocabulary: str):
    entries = read_ranks(vocabulary)
    return docs.sparkSession.sparkContext.broadcast((entries, Merges(entries)))


@contextlib.contextmanager
def _encoder(shared, pattern: str) -> Iterator[Encoder]:
    """An encoder for one task. What it remembers goes with the task: its worker lives on and serves other operators."""
    encoder = Encoder(*shared.value, pattern)
    try:
        yield encoder
    finally:
        encoder.cache.clear()
        encoder.merges.known.clear()


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every row's whole text."""
    shared = _shared(docs, vocabulary)

    def run(batches):
        with _encoder(shared, pattern) as encoder:
            for batch in batches:
                ids = [encoder.ids(text.as_py() or "") for text in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _plain(docs, id_col, text_col).mapInArrow(run, IDS)


def decode(encoded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of every row's ids (null ids: no bytes); an unknown id is an error."""
    entries = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        table = entries.value
        for batch in batches:
            out = [b"".join([table[i] for i in ids.as_py() or []]) for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, one space between) and of the decoded bytes."""
    shared = _shared(docs, vocabulary)

    def run(batches):
        with _encoder(shared, pattern) as encoder:
            for batch in batches:
                out = [encoder.digests(text.as_py() or "") for text in batch.column(1)]
                yield pa.record_batch(
                    [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _plain(docs, id_col, text_col).mapInArrow(run, DIGESTS)
