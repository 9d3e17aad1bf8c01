"""BPE encoding and decoding of whole texts.

Encoding a word keeps its symbols in a doubly linked list and its mergeable pairs in a priority queue of (merge rank,
place); an entry is stale, and skipped, if the symbols it names have been merged since. Decoding puts the vocabulary's
strings together. Words are encoded once for each distinct spelling that a bounded cache holds.

Normalisation, splitting and special tokens are read from the tokenizer's own file, as far as the file uses what is
built here; other files are refused rather than encoded wrongly.

Defined results: a null or empty text has no tokens; rows that repeat are encoded alike; texts of any length are
encoded whole; an empty table gives an empty table; other columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import in_batches, map_rows, small_batches, without

#: The white space of the Unicode standard, which is what the tokenizer's own pattern takes as \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Python's str.split() also splits at these.
ODD = regex.compile("[\x1c-\x1f]")
CACHED = 400_000
#: The same where other operators work beside this one in a job.
CACHED_BESIDE = 150_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Fixed values, as Unicode gives them. The tokenizer splits by Unicode 16.0 and lowers by 17.0; Python's tables are of 15.1
# and the regex module's are later. First and last of the letters and numbers that 16.0 added:
ADDED_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113B7),
    (0x113D1, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
# Capitals added by 16.0 and 17.0, each with its small letter; of a row of them, first, last and the step to the small one:
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
SMALL_ROWS = [(0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]


def late_letters() -> str:
    """What the regex module takes for a letter or number, but Unicode 16.0 has not assigned."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    return "".join(c for c in new if not any(a <= ord(c) <= b for a, b in ADDED_16))


def late_small() -> dict[int, int]:
    """Of the capitals that Python's own lower() leaves."""
    rows = {c: c + step for a, b, step in SMALL_ROWS for c in range(a, b + 1)}
    return {c: d for c, d in (SMALL | rows).items() if chr(c).lower() == chr(c)}


class Bpe:
    def __init__(self, path: str, cached: int = CACHED):
        self.cached = cached
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        split, level = pre[0], pre[1]
        plain = model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["fuse_unk"] or model["byte_fallback"] or model["ignore_merges"])
        if not (plain and steps == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and spec["decoder"] is None and spec["post_processor"] is None):
            raise ValueError(f"{path}: a kind of tokenizer that isn't built here")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a_id, b_id = self.vocab[a], self.vocab[b]
            self.ranks[a_id, b_id] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.white = regex.compile(f"[{regex.escape(WHITE)}]+")
        pattern = split["pattern"]["Regex"].replace(r"\s", regex.escape(WHITE))
        self.pieces = regex.compile(pattern)
        late = late_letters()
        self.late = frozenset(late)
        late = regex.escape(late)
        for p in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(p, f"[{p}--[{late}]]")
        self.strict = regex.compile(f"(?V1){pattern}") if late else self.pieces
        self.small = late_small()
        self.capitals = frozenset(map(chr, self.small))
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """symbols after all merges, lowest rank first and leftmost among equals."""
        n, ranks = len(symbols), self.ranks
        heap = []
        for i in range(n - 1):
            if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((r[0], i, r[1]))
        if not heap:
            return symbols
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or (r := ranks.get((symbols[i], symbols[j]))) is None or r[0] != rank:
                continue  # stale
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((new, symbols[k]))) is not None:
                    heapq.heappush(heap, (r[0], i, r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], new))) is not None:
                heapq.heappush(heap, (r[0], h, r[1]))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def word(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        if (known := self.words.get(piece)) is not None:
            return known
        letters = self.letters
        spelt = [letters[b] for b in piece.encode()]
        spelt[-1] += self.end
        vocab = self.vocab
        ids = self.merge([vocab[s] for s in spelt if s in vocab])
        if len(self.words) >= self.cached:
            self.words.clear()
        self.words[piece] = out = np.array(ids, "<u4").tobytes()
        return out

    def chunk(self, text: str) -> bytes:
        """The ids of a run of text that holds no white space but perhaps at its inside."""
        low = text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()
        pieces = self.pieces
        if not low.isascii():
            if not self.capitals.isdisjoint(low):
                low = low.translate(self.small)
            if not self.late.isdisjoint(low):
                pieces = self.strict
        out = b"".join([self.word(p) for p in pieces.findall(low)])
        if len(text) <= 64:
            if len(self.chunks) >= self.cached:
                self.chunks.clear()
            self.chunks[text] = out
        return out

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens: white space parts the pieces, so each run between is on its own."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        runs = text.split() if not ODD.search(text) else [x for x in self.white.split(text) if x]
        known, chunk = self.chunks.get, self.chunk
        return b"".join([known(r) or chunk(r) for r in runs])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.specials or "<|" not in text and not self.specials.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, cached: int = CACHED) -> Bpe:
    """One for each Python worker, with its caches."""
    return Bpe(path, cached)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", cached: int = CACHED_BESIDE) -> DataFrame:
    """df with an array of token ids; a worker keeps those of so many spellings."""
    path = path or default_path()
    small_batches(df.sparkSession, 500)
    df = without(df, ids)
    place = df.columns.index(text)

    def run(batches):
        bpe = tokenizer(path, cached)
        for b in batches:
            made = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int32()))], names=[*b.schema.names, ids])

    return in_batches(df, run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """df with the text of an array of token ids; null for a null array."""
    path = path or default_path()
    df = without(df, out)
    place = df.columns.index(ids)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            made = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return in_batches(df, run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def digest(df: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of op2: each text is encoded, and what the ids decode to is hashed; neither leaves the worker."""
    path = path or default_path()

    def run(batches):
        bpe = tokenizer(path)
        for keys, texts in batches:
            out = [keys, [], [], []]
            for t in texts:
                ids = bpe.encode(t)
                out[1].append(len(ids) // 4)
                out[2].append(hashlib.sha256(ids).hexdigest())
                out[3].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield out

    return map_rows(df, [F.col("doc_id"), F.col("text")], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
