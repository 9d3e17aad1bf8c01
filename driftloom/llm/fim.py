"""Fill-in-the-middle texts: a text is cut in three and put together with the middle last.

One automaton over bytes reads every text once. Its table knows the bytes that continue a code point, where a unit (a run
of letters A-Z, or any other code point) begins, and the sentinels; each of its transitions emits what it counts: a code
point, a unit, a sentinel. The counts tell a text's units and whether it holds a sentinel; a second pass over the emitted
marks finds the bytes at which the chosen units end. Texts are laid side by side in lanes, all of which take one step at a
time; a lane begins a few bytes early, since after ``Scanner.warm`` bytes the state no longer depends on where it began.

Defined results: a null text is an empty one, and an empty text stays plain; a null key is hashed as if it were the empty
string; repeated rows get equal results; texts of any length are read whole, in blocks of bounded size; an empty table gives an
empty table; columns of df that have the names of added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import in_batches, sha, small_batches, without

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, those that stay plain, and of a hundred of the others, those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: What a transition counts.
CHAR, UNIT, SENTINEL = 1, 2, 4
#: Bytes of text scanned at a time, and lanes they are laid in.
BLOCK, LANES = 2 << 20, 1024

# States: after a unit that is done; in a run of letters; after "<"; after "<" and the letter of a sentinel; within a code
# point of which 1, 2 or 3 bytes are still to come.
DONE, LETTERS, OPEN, NAMED, MORE = 0, 1, 2, 3, 4
STATES = MORE + 3


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * 256 + byte."""
    after, marks = np.zeros((STATES, 256), np.uint8), np.full((STATES, 256), CHAR | UNIT, np.uint8)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    after[:, letter] = LETTERS
    after[:, ord("<")] = OPEN
    after[OPEN, [x[1] for x in (PREFIX, SUFFIX, MIDDLE)]] = NAMED
    for more, lead in enumerate((slice(0xC0, 0xE0), slice(0xE0, 0xF0), slice(0xF0, 0xF8))):
        after[:, lead] = MORE + more
    for s in (LETTERS, NAMED):
        marks[s, letter] = CHAR
    marks[NAMED, ord(">")] |= SENTINEL
    marks[:, 0x80:0xC0] = 0
    after[MORE + 1 :, 0x80:0xC0] = np.arange(MORE, MORE + 2)[:, None]
    return after.reshape(-1), marks.reshape(-1)


class Scanner:
    def __init__(self):
        self.after, self.marks = tables()
        self.step = self.after.astype(np.uint16) << 8  # next state's row in the table
        self.warm = self.needed()

    def needed(self) -> int:
        """After how many bytes, whatever they are, all states have become one."""
        pairs, n = {(a, b) for a in range(STATES) for b in range(a)}, 0
        while pairs:
            n += 1
            pairs = {(max(p), min(p)) for a, b in pairs for p in zip(self.after[a * 256 : a * 256 + 256].tolist(), self.after[b * 256 : b * 256 + 256].tolist(), strict=True) if p[0] != p[1]}
            if n > STATES * STATES:
                raise ValueError("the automaton never forgets where it began")
        return n

    def scan(self, data: bytes) -> np.ndarray:
        """The marks of each byte's transition; zero bytes of data take the automaton back to its start."""
        n = len(data)
        width = max(-(-n // LANES), 1)
        laid = np.zeros(self.warm + width * LANES, np.uint8)
        laid[self.warm : self.warm + n] = np.frombuffer(data, np.uint8)
        lanes = np.lib.stride_tricks.as_strided(laid, (self.warm + width, LANES), (1, width))
        seen = np.empty((width, LANES), np.uint16)
        state = np.zeros(LANES, np.uint16)
        for i in range(self.warm + width):
            at = state | lanes[i]
            if i >= self.warm:
                seen[i - self.warm] = at
            state = self.step[at]
        return self.marks[seen].T.reshape(-1)[:n]


def numbers(key: object, seed: str) -> tuple[int, int, int, int]:
    """The first four numbers of 32 bits in the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


def pieces(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some at a time: their texts reach BLOCK bytes with the last row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy().astype(np.int64) + 1)
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        after = min(int(np.searchsorted(ends, before + BLOCK)) + 1, batch.num_rows)
        yield batch.slice(first, after - first)
        first = after


Cut = tuple[int, str, int | None, int | None, bytes]


def cut(texts: list[bytes], keys: list, scanner: Scanner, seed: str) -> Iterator[Cut]:
    """(units, form, code points of prefix and middle, output) of each text."""
    marks = scanner.scan(b"\0".join(texts) + b"\0")
    at = 0
    for text, key in zip(texts, keys, strict=True):
        m = marks[at : at + len(text)]
        at += len(text) + 1
        counts = np.bincount(m, minlength=8)  # by what a transition counts
        n, sentinels = int(counts[[2, 3, 6, 7]].sum()), int(counts[4:].sum())
        h1, h2, h3, h4 = numbers(key, seed)
        if not n or sentinels or h3 % 100 >= 100 - PLAIN:
            yield n, "plain", None, None, text
            continue
        starts = np.flatnonzero(m & UNIT)
        a, b = (int(starts[x]) if x < n else len(text) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        chars = [int(np.count_nonzero(x & CHAR)) for x in (m[:a], m[a:b])]
        if h4 % 100 < SUFFIX_FIRST:
            yield n, "spm", *chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        else:
            yield n, "psm", *chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output, by its form alone; parts hold no sentinel, so the first one of each kind is where parts meet."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def over(df: DataFrame, columns: tuple[str, ...], added: str, f: Callable[[list[pa.Array]], Iterator[tuple]]) -> DataFrame:
    """df and the added columns, which f makes of the named ones, the first of them a text, piece by piece."""
    new = T.StructType.fromDDL(added)
    df = without(df, *new.names)
    small_batches(df.sparkSession)
    places = [df.columns.index(c) for c in columns]
    arrow = [{T.LongType(): pa.int64(), T.StringType(): pa.string()}[x.dataType] for x in new.fields]

    def run(batches):
        for b in (p for batch in batches for p in pieces(batch, places[0])):
            made = list(zip(*f([b.column(p) for p in places]), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m, t) for m, t in zip(made, arrow, strict=True))], names=[*b.schema.names, *new.names])

    return in_batches(df, run, T.StructType([*df.schema.fields, *new.fields]))


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", verified: bool = False) -> DataFrame:
    """df with n_units, form, prefix_chars, middle_chars and output; cuts depend on seed and key.

    verified: restored too, which is rebuilt from output and form in the same pass.
    """
    scanner = Scanner()

    def f(columns: list[pa.Array]) -> Iterator[tuple]:
        texts = [x or b"" for x in columns[0].cast(pa.binary()).to_pylist()]
        for row in cut(texts, columns[1].to_pylist(), scanner, seed):
            yield (*row, rebuilt(row[4], row[1])) if verified else row

    return over(df, (text, key), "n_units long, form string, prefix_chars long, middle_chars long, output string" + ", restored string" * verified, f)


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """df with restored, the text that transform() was given (an empty one for null)."""
    return over(df, (output, form), "restored string", lambda c: ((rebuilt(x, k),) for x, k in zip(c[0].cast(pa.binary()).to_pylist(), c[1].to_pylist(), strict=True)))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op13."""
    rows = transform(df.select("doc_id", "text"), verified=True)
    return rows.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(F.col("restored")).alias("restored_sha256"))
