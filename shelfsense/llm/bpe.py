"""Byte-level BPE: encoding by a priority queue over a linked symbol list, decoding, and token counts by the whole-token shortcut."""

from __future__ import annotations

import heapq
import json
import struct
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import REMEMBERED_BYTES, map_texts

# Fixed value: how the vocabulary's byte-level pre-tokenizer splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Entries of a cache's generation; a worker holds at most two generations of pieces and two of words.
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else the next above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """tokens: id to bytes; start: byte to id; merges: pair of ids to (rank, merged id); special: string to id."""

    tokens: dict[int, bytes]
    start: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    whole: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a ``tokenizers`` file of a byte-level BPE model without normaliser."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = data["model"]["vocab"]
        tokens = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens |= {i: s.encode() for s, i in special.items()}
        return cls(tokens, [ids[c] for c in letters], merges, special)

    def prove_whole(self) -> Vocabulary:
        """Fill ``whole`` with every vocabulary string that is one pre-token and that merging turns into exactly its own token."""
        split = regex.compile(SPLIT)
        for i, raw in self.tokens.items():
            try:
                piece = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if piece not in self.special and split.findall(piece) == [piece] and self.encode_piece(piece) == [i]:
                self.whole[piece] = i
        return self

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one pre-token: the best-ranked adjacent pair merges first, ties to the left.

        Symbols form a doubly linked list; the queue holds candidate merges, and an entry is stale when its left symbol is
        gone or its pair no longer makes the same token.
        """
        symbols: list[int | None] = [self.start[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        queue = [(found[0], at, found[1]) for at in range(n - 1) if (found := merges.get((symbols[at], symbols[at + 1])))]
        heapq.heapify(queue)
        while queue:
            _, at, made = heapq.heappop(queue)
            left, right_at = symbols[at], after[at]
            if left is None or right_at >= n:
                continue
            found = merges.get((left, symbols[right_at]))
            if found is None or found[1] != made:
                continue
            symbols[at], symbols[right_at] = made, None
            nxt = after[at] = after[right_at]
            if nxt < n:
                before[nxt] = at
                if found := merges.get((made, symbols[nxt])):
                    heapq.heappush(queue, (found[0], at, found[1]))
            prev = before[at]
            if prev >= 0 and (found := merges.get((symbols[prev], made))):
                heapq.heappush(queue, (found[0], prev, found[1]))
        return [s for s in symbols if s is not None]


class Remembered(dict):
    """Cache over ``make``. When ``REMEMBERED`` entries are new, the older generation goes; entries in use move to the new one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        if len(key) > REMEMBERED_BYTES:
            return self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Reader:
    """Maps a text to one value per part: ``piece`` gives a pre-token's value, ``join`` combines values, ``special`` a special string's.

    A piece never reaches across a single space between two other characters: it starts there. So where white space is single, words
    are looked up with their leading space and only unknown ones are split into pieces.
    """

    def __init__(self, vocabulary: Vocabulary, piece, join, special):
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.names, self.special, self.join = names, special, join
        self.at_names = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.pieces, self.runs = regex.compile(SPLIT).findall, regex.compile(r"\s\s|\s\Z").search
        self.piece = Remembered(piece)
        self.word = Remembered(lambda w: self.plain(" " + w))

    def plain(self, text: str):
        return self.join(map(self.piece.__getitem__, self.pieces(text)))

    def part(self, text: str):
        if self.runs(text):
            return self.plain(text)
        first, *words = text.split(" ")
        return self.join([self.plain(first), *map(self.word.__getitem__, words)])

    def read(self, text: str):
        if not any(s in text for s in self.names):
            return self.part(text)
        return self.join([self.special(p) if at % 2 else self.part(p) for at, p in enumerate(self.at_names(text))])


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(vocabulary: Vocabulary):
    """Function from a text to its packed ids."""
    return Reader(vocabulary, lambda p: pack(vocabulary.encode_piece(p)), b"".join, lambda s: pack([vocabulary.special[s]])).read


def counter(vocabulary: Vocabulary):
    """Function from a text to its number of tokens: a proven whole token counts one, only other pieces are merged."""
    whole = vocabulary.whole
    return Reader(vocabulary, lambda p: 1 if p in whole else len(vocabulary.encode_piece(p)), sum, lambda s: 1).read


def kept_by_worker(vocabulary: Vocabulary, make):
    """One reader per Python worker, so that later tasks find its pieces."""
    readers = vocabulary.__dict__.setdefault("readers", {})
    if make not in readers:
        readers[make] = make(vocabulary)
    return readers[make]


def decode(vocabulary: Vocabulary, packed: bytes) -> str:
    """Concatenated vocabulary strings; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.tokens.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed))).decode("utf-8", "replace")


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows repeat; an empty table gives no
    rows; other columns are ignored. Texts of any length are counted whole. The vocabulary is read on the driver and
    broadcast (a fixed file of a few MB); the proof of whole tokens runs there once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path).prove_whole())

    def make():
        count = kept_by_worker(shared.value, counter)

        def columns(texts: list[bytes]) -> dict:
            tokens = [count(t.decode("utf-8", "replace")) for t in texts]
            return {"n_bytes": [len(t) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return columns

    return map_texts(docs, doc_id, text, "n_bytes long, n_tokens long, over_limit boolean", make)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (packed little-endian unsigned 32-bit integers), decoded (text of the ids).

    A null text is empty and has no ids; a null doc_id stays null; repeated rows repeat; an empty table gives no rows; other
    columns are ignored. Special strings inside a text become their special token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def make():
        vocabulary = shared.value
        encode = kept_by_worker(vocabulary, encoder)

        def columns(texts: list[bytes]) -> dict:
            ids = [encode(t.decode("utf-8", "replace")) for t in texts]
            return {"ids": ids, "decoded": [decode(vocabulary, p) for p in ids]}

        return columns

    return map_texts(docs, doc_id, text, "ids binary, decoded string", make)


def encoding_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_documents``."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
