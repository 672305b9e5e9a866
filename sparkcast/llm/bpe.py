"""Byte-pair encoding without merging: longest token matches, checked pair by pair, with steps back.

The exact result of merging is the one row of tokens in which every neighbouring pair is compatible: no merge across the border
of the two comes before the merges that made them. Tokens are tried longest first; a position that leads nowhere is left once
and for all, so the work is linear in the text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkcast.llm.batches import giving_back

CACHED_WORDS = 300_000
BATCH = 200  # rows encoded before they are handed on
CHUNK = 1 << 16
_LAST = 256  # symbols from here on end a word
_NEVER = 1 << 62
# The white space of Unicode, and the printable characters that stand for themselves among the byte symbols.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_symbols() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PRINTED)]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


class WordBpe:
    """A vocabulary of lower-case words that end in a suffix, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix, symbols = model["end_of_word_suffix"], _byte_symbols()
        self.path = path
        self.library: Tokenizer | None = None
        self.assigned: set[str] = set()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # Runs of letters first: no other alternative begins with a letter, and most pieces are such runs.
        ways = sorted(patterns[0].replace(r"\s", _SPACE).split("|"), key=lambda way: way != r"[\p{L}]+")
        self.pieces = regex.compile("|".join(ways), regex.V0).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split

        def plain(token: str) -> str:
            ends = token.endswith(suffix)
            body = [symbols[c] for c in (token[:-len(suffix)] if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + _LAST * ends)

        names = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        self.ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            names[i] = token
            self.ids[plain(token)] = i
        for token, i in self.special.items():
            names[i] = token
        self.length = [0] * len(names)
        self.shorter: list[int | None] = [None] * len(names)
        self.find = ahocorasick.Automaton()
        for word, i in self.ids.items():
            self.length[i] = len(word)
            self.shorter[i] = next((self.ids[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.ids), None)
            self.find.add_word(word, i)
        self.find.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(model["merges"]):
            pair = model["vocab"][a], model["vocab"][b]
            self.rank[pair] = n
            self.made.setdefault(model["vocab"][a + b], (*pair, n))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        spelled = [n.encode() + b" " for n in names]
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stood at an edge of the token while it was made, each with the rank of the merge that took it up."""
        found, taken = [], _NEVER
        while True:
            found.append((token, taken))
            if token not in self.made:
                return found
            *parts, taken = self.made[token]
            token = parts[side]

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge across the border of the two comes before those that made them; kept in the table."""
        fits = not any(
            m is not None and m < a_taken and m <= b_taken
            for a, a_taken in self._edge(left, 1) for b, b_taken in self._edge(right, 0)
            for m in (self.rank.get((a, b)),))
        if len(self.compatible) >= 5 * CACHED_WORDS:
            self.compatible.clear()
        self.compatible[left, right] = fits
        return fits

    def word(self, symbols: str) -> list[int]:
        """The tokens of one word, given as symbols of which the last ends the word."""
        n, length, shorter, known = len(symbols), self.length, self.shorter, self.compatible
        longest: list[int | None] = [None] * n
        for end, token in self.find.iter(symbols):  # in the order of the ends, so the last match of a start is its longest
            longest[end + 1 - length[token]] = token
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                end = at + length[token]
                if not dead[end]:
                    if not tokens:
                        break
                    fits = known.get((tokens[-1], token))
                    if self.fits(tokens[-1], token) if fits is None else fits:
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                dead[at] = 1
                last = tokens.pop()
                at -= length[last]
                token = shorter[last]
        return tokens

    def _packed(self, piece: str) -> bytes:
        raw = piece.encode()
        symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + _LAST)
        whole = self.ids.get(symbols)
        tokens = self.word(symbols) if whole is None else [whole]
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        packed = self.words[piece] = pack(f"<{len(tokens)}I", *tokens)
        return packed

    def _known(self, text: str) -> bool:
        """Whether this Python knows all characters. On newer letters and digits libraries differ by their age."""
        fresh = set(text) - self.assigned
        self.assigned.update(c for c in fresh if unicodedata.category(c) != "Cn")
        return fresh <= self.assigned

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or self._known(text):
            # Lower case goes character by character: no special form of sigma at the end of a word.
            return self.pieces(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        self.library = self.library or Tokenizer.from_file(self.path)
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        out, get, make = [], self.words.get, self._packed
        for i, part in enumerate(self.split(text or "")):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            out += [get(p) or make(p) for p in self._pieces(part)]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The names of the tokens, one space between them: slices of one table of bytes, taken by offset."""
        ids, parts = np.frombuffer(packed, "<u4"), []
        for at in range(0, len(ids), CHUNK):
            chunk = ids[at:at + CHUNK].astype(np.int64)
            starts, sizes = self.offsets[chunk], self.offsets[chunk + 1] - self.offsets[chunk]
            ends = np.cumsum(sizes)
            parts.append(self.blob[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)[:-1].decode()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row of ``docs``; ``ids`` are packed little-endian unsigned 32-bit integers.

    Whole texts. The strings of special tokens in a text become those tokens. A NULL or empty text has no tokens and empty
    ``ids``. Repeated rows and NULL ids stay as they are, other columns are not read, an empty table gives an empty result.
    ``path`` must be readable by the executors. One narrow stage, no shuffle.
    """
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)  # read in a quarter of a second; a worker keeps none
        for batch in batches:
            found = [bpe.encode(t.as_py()) for t in batch.column(1)]
            sizes = pa.array([len(f) // 4 for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``n_tokens``, ``ids``) with ``decoded``; NULL ids count as none and give an empty text."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)  # read in a quarter of a second; a worker keeps none
        for batch in batches:
            texts = pa.array([bpe.decode(i.as_py() or b"") for i in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``(doc_id, n_tokens, ids, decoded)``."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)  # read in a quarter of a second; a worker keeps none
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                found = [bpe.encode(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(found, pa.binary()),
                     pa.array(map(bpe.decode, found), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")
