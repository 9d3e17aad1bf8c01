"""Language-model scoring by logistic context mixing, bit by bit.

Each bit of a text (and of its end) is predicted from hashed contexts: the last byte, the last two, three and five,
and the word so far. A context's slot holds how often each half-byte followed it in the training texts; the predictor's input
is the log odds of the next bit there. Inputs are combined by weights that the bit's place in its byte gates; TOGETHER
bytes are predicted by the same weights, which then take a gradient step on the coding cost of all of them. As no two bits
of a byte share weights, these bits and many texts go through numpy together. Weights are carried through the whole text.
A last stage refines the mix: a bias for each bit's place and each range of the mixed log odds, which learns at the same
steps (from the last bit of those that meet in a range). The tables of counts are fitted once and do not change while a
text is scored. The end of a text is a byte that UTF-8 never holds, so the probabilities of all texts add up to one at most.

The word model beside it counts every token of the training texts, with no cap. Tokens seen twice or more, the ``top``
most frequent ones at most (12 bytes each), are broadcast; all others are looked up by an exact join, at every size.

A context has 2**bits slots of 16 bytes, one for each SLOT_BYTES of training text or a little more, however large that
is (bits end with the 32-bit hash, at 1 TB). Tables are not broadcast and never meet the driver: tasks send the slots they
saw, parts of the tables are added up and stored, and each executor lays them out in one file that its workers map.
Broadcast are ``top`` tokens at most.

Defined results: a null text is an empty one, of which the end alone is scored; a null doc_id is of the training rows;
rows that repeat are scored alike; texts of any length are scored whole; without training rows the base score is 0; an empty
table gives an empty table. score returns its own columns alone, so that none of df's can clash.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import laid_out, map_rows, shared_folder, small_batches, stored, stored_rows
from driftloom.llm.wordhash import BASE, IS_WORD, STEP, Powers, blocks

CONTEXTS = 5
LEAST_BITS, HASH_BITS = 12, 32
#: Of the slots of a page, in which a context and what follows its first half-bytes lie together.
GROUP_BITS = 8
#: Training bytes for each slot.
SLOT_BYTES = 1 << 8
#: Entries that a task holds before it sends them.
HELD = 6_000_000
BUFFER = 3 << 19
#: Bytes of text that are sorted by length before they are scored.
GATHER = 16 << 20
RATE, START = 0.02, 0.3
#: Of the refinement: its rate, and ranges of half a nat.
BIAS_RATE, RANGES = 0.02, 24
ONE = np.float32(1)
#: The most that log odds come to: one in 4096.
FAR = np.float32(math.log(4095))
#: Bytes whose slots are worked out at a time.
PIECE = 1 << 15
#: Bytes of a text that are predicted by the same weights, before these learn from all of them.
TOGETHER = 16
_AHEAD = np.arange(TOGETHER)
#: What ends a text: a byte that UTF-8 has no use for.
LAST_BYTE = b"\xff"
#: Hash of the end of a text, as a token.
END = np.uint64(0x5851F42D4C957F2D)
_LETTERS = Powers(BASE)

#: How far to shift a slot's low or high word for the nodes that a half-byte's second to fourth bit meets.
_SECOND, _THIRD, _FOURTH = (np.array([8 * (node(v)) for v in range(16)], np.uint64) for node in (lambda v: 2 | v >> 3, lambda v: 4 | v >> 2, lambda v: v >> 1))
#: 1 where its bit is a one, else -1.
_SIGN = np.array([[1 if v >> b & 1 else -1 for b in (3, 2, 1, 0)] for v in range(16)], np.int8)
#: The same by bytes.
_SIGNS = np.concatenate([np.repeat(_SIGN, 16, 0), np.tile(_SIGN, (16, 1))], 1).astype(np.float32)


def bits_for(size: int) -> int:
    """Of the slots of a context, for training texts of size bytes."""
    return max(LEAST_BITS, min(HASH_BITS, math.ceil(math.log2(size / SLOT_BYTES + 1))))


def part_bits(bits: int) -> int:
    """Of the slots of a part in which tables are added up: at most 1024 parts a context."""
    return max(11, bits - 10)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """In the place of x."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x >>= np.uint32(32 - bits)
    return x


def followed(slot: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The slot in which last half-bytes are counted, after a first one seen in slot: on the same page."""
    low = high + high.dtype.type(1)
    low *= low.dtype.type(0x9E3779B1)
    low += slot * low.dtype.type(0x85EBCA77)
    low &= low.dtype.type(0xFFFFFFFF)
    low >>= low.dtype.type(32 - GROUP_BITS)
    low |= slot >> slot.dtype.type(GROUP_BITS) << slot.dtype.type(GROUP_BITS)
    return low


def slots(data: np.ndarray, starts: np.ndarray, bits: int):
    """(context, place, entries) by pieces of data that stay in cache.

    An entry is a slot's number and the byte seen there; starts: where texts begin in data.
    """
    n = len(data)
    wide = data.astype(np.uint32)

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        out[k:] = wide[:-k] if n > k else 0
        for j in range(k):  # what lies before a text is no context
            at = starts + j
            out[at[at < n]] = 0
        return out

    def words() -> np.ndarray:
        """Of the word so far: the sum of its letters times powers, brought back to power 0."""
        _LETTERS.grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _LETTERS.up[:n], out=total[1:])
        opens = np.ones(n, bool)
        opens[1:] = ~IS_WORD[data[:-1]]
        opens[starts] = True
        first = np.flatnonzero(opens)
        size = np.diff(np.append(first, n))
        out = (total[:-1] - np.repeat(total[first], size)) * np.repeat(_LETTERS.down[first], size)
        out *= np.uint64(STEP)  # or the first letters, which stand in the low bits, are lost
        out >>= np.uint64(32)
        return out.astype(np.uint32)

    b1 = back(1)
    two = b1 | back(2) << np.uint32(8)
    three = two | back(3) << np.uint32(16)
    five = three * np.uint32(0x01000193) ^ (back(4) | back(5) << np.uint32(8)) * np.uint32(0x27D4EB2F)
    for k, context in enumerate((b1, two, three, five, words())):
        for a in range(0, n, PIECE):
            own = slice(a, min(a + PIECE, n))
            h = context[own] + np.uint32(k + 1)
            h *= np.uint32(0x9E3779B1)
            h = scramble(h, bits)
            if bits > 24:  # with the byte over 32 bits
                h = h.astype(np.uint64)
            h <<= h.dtype.type(8)
            h |= wide[own]
            yield k, own, h


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with an end byte each, and where each begins."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(LAST_BYTE.join(texts) + LAST_BYTE, np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def portions(texts: list[bytes], most: int):
    """(first, last) of successive texts that hold about most bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def tallied(entries: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries, sorted, and how often each came (as uint32)."""
    if counts is None:
        entries.sort()
    else:
        order = np.argsort(entries, kind="stable")
        entries, counts = entries[order], counts[order]
    first = np.flatnonzero(np.append(True, entries[1:] != entries[:-1])) if len(entries) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(entries))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return entries[first], n.astype(np.uint32)


class Tables:
    """Counts of bytes by context and slot; only those that came are held."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.made: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(CONTEXTS)]
        self.held = 0

    def add(self, texts: list[bytes]) -> None:
        for a, b in portions(texts, BUFFER):
            data, starts = joined(texts[a:b])
            seen = np.empty(len(data), np.uint64 if self.bits > 24 else np.uint32)
            for k, own, entries in slots(data, starts, self.bits):
                seen[own] = entries
                if own.stop == len(data):
                    now = tallied(seen)  # sorted in its place: each context fills it anew
                    self.made[k].append(now)
                    self.held += len(now[0])

    def totals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.made[k]:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        return tallied(*(np.concatenate(x) for x in zip(*self.made[k], strict=True)))

    @property
    def counts(self) -> np.ndarray:
        """Of half-bytes in all slots, for small tables."""
        out = np.zeros((CONTEXTS, 16 << self.bits), np.uint32)
        for k in range(CONTEXTS):
            at, n = self.totals(k)
            out[k] = spread(at.astype(np.uint64), n, 0, self.bits)
        return out

    def parts(self, last: bool = False):
        """(context and part, packed entries and counts); last: what was held is let go on the way."""
        shift = part_bits(self.bits) + 8
        for k in range(CONTEXTS):
            at, n = self.totals(k)
            if last:
                self.made[k] = []
            if not len(at):
                continue
            part = (at >> at.dtype.type(shift)).astype(np.int64)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True):
                yield (k << 32) + int(part[a]), packed((at[a:b] & at.dtype.type((1 << shift) - 1)).astype(np.uint32), n[a:b])


def spread(entries: np.ndarray, n: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Of 2**bits slots, of which the first has this number: how often each half-byte came; entries go by slots from first on."""
    slot, byte = entries >> np.uint64(8), entries & np.uint64(255)
    high = byte >> np.uint64(4)
    low = followed(slot + np.uint64(first), high) - np.uint64(first)
    cells = np.concatenate([slot << np.uint64(4) | high, low << np.uint64(4) | byte & np.uint64(15)]).astype(np.int64)
    return np.bincount(cells, np.concatenate([n, n]).astype(np.float64), 16 << bits)


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Steps between rising places and counts, by bytes of equal weight, so that zeros lie together for the codec."""
    both = np.stack([np.diff(at, prepend=np.uint32(0)), n]).astype("<u4")
    return both.view(np.uint8).reshape(2, len(at), 4).transpose(0, 2, 1).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(blob, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
    both = np.ascontiguousarray(m).view("<u4")[:, :, 0]
    return np.cumsum(both[0], dtype=np.int64), both[1]


class Odds:
    """The log odds of all slots, stored by parts; workers of an executor map one file, which the first of them writes."""

    def __init__(self, bits: int, files: list[str]):
        self.bits, self.files, self.name = bits, files, f"driftloom-odds-{uuid.uuid4().hex}"

    def mapped(self) -> np.ndarray:
        def write(f) -> None:
            for h, odds in stored_rows(self.files, ["h", "odds"]):
                f.seek(((h >> 32) * 16 << self.bits) + ((h & 0xFFFFFFFF) * 16 << part_bits(self.bits)))
                f.write(odds)

        path = laid_out(self.name, CONTEXTS * 16 << self.bits, write)
        return np.memmap(path, np.int8, "r", shape=(CONTEXTS, 16 << self.bits))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of slots of 16 counts: the log odds of a one at the tree's 15 nodes, in sixteenths."""
    c = counts.reshape(-1, 16).astype(np.float64)
    out = np.zeros((len(c), 16), np.int8)
    node = c
    for level in range(3, -1, -1):
        pair = node.reshape(len(c), 1 << level, 2)
        odds = np.log((pair[:, :, 1] + 0.4) / (pair[:, :, 0] + 0.4)) * 16
        out[:, 1 << level : 2 << level] = np.clip(np.rint(odds), -127, 127)
        node = pair.sum(2)
    return out


class Mixer:
    def __init__(self, bits: int, odds: np.ndarray):
        """odds: CONTEXTS rows of slots of 16 log odds."""
        self.bits = bits
        self.tables = [np.asarray(t).view(np.complex128) for t in odds]  # a slot's 16 bytes are one item

    def passed(self, k: int, entries: np.ndarray) -> np.ndarray:
        """The eight log odds that each byte passes, in one word of bytes."""
        byte = entries & entries.dtype.type(255)
        slot = entries >> entries.dtype.type(8)
        both = np.empty(2 * len(entries), np.int64)  # side by side, as a byte's two slots lie on one page
        both[::2], both[1::2] = slot, followed(slot, byte >> byte.dtype.type(4))
        half = np.empty(len(both), np.uint8)
        half[::2], half[1::2] = byte >> byte.dtype.type(4), byte & byte.dtype.type(15)
        slots = self.tables[k].take(both).view(np.uint64)
        low, high = slots[::2], slots[1::2]
        out = np.empty((len(both), 4), np.uint8)  # of nodes 1, 2 or 3, 4 to 7 and 8 to 15 of the slot's bytes
        out[:, 0] = low >> np.uint64(8)
        out[:, 1] = low >> _SECOND.take(half)
        out[:, 2] = low >> _THIRD.take(half)
        out[:, 3] = high >> _FOURTH.take(half)
        return out.reshape(-1, 8).view(np.uint64)[:, 0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The log10 probability of each text with its end."""
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts of like lengths go together
        texts, out = [texts[i] for i in order], np.zeros(len(texts))
        for a, b in portions(texts, BUFFER):
            out[order[a:b]] = self._scores(texts[a:b])
        return out

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        data, starts = joined(texts)
        n = len(data)
        inputs = np.empty((CONTEXTS, n), np.uint64)
        for k, own, entries in slots(data, starts, self.bits):
            inputs[k, own] = self.passed(k, entries)
        ends = np.append(starts[1:], n)
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        at, size = starts[order], (ends - starts)[order]
        lanes = len(order)
        # the steps' arrays are of bytes, lanes and bits, so that what lanes and bits share is read in one run
        bias = np.zeros(lanes * 8 * RANGES, np.float32)  # one cell for each lane, bit and range
        cells = np.arange(lanes * 8) * RANGES + RANGES // 2
        weights = np.full((CONTEXTS, lanes * 8), START / 16, np.float32)  # inputs are in sixteenths
        rate, bias_rate = np.float32(RATE / 256), np.float32(BIAS_RATE)
        room = np.empty(CONTEXTS * TOGETHER * lanes * 8, np.float32)
        cost = np.zeros(lanes)
        live = lanes
        for step in range(0, int(size[0]), TOGETHER):
            while size[live - 1] <= step:
                live -= 1
            left = size[:live] - step
            place = at[:live] + step + np.minimum(_AHEAD[:, None], left - 1)
            x = room[: CONTEXTS * TOGETHER * live * 8].reshape(CONTEXTS, TOGETHER, live * 8)
            for i, own in zip(inputs, x, strict=True):
                own[...] = i.take(place).view(np.int8)
            w = weights[:, : live * 8]
            p = np.einsum("kbm,km->bm", x, w)
            sign = _SIGNS.take(data.take(place), axis=0).reshape(p.shape)
            cell = p * np.float32(2)
            np.clip(cell, -RANGES // 2, RANGES // 2 - 1, out=cell)
            cell = np.floor(cell, out=cell).astype(np.int64)
            cell += cells[: live * 8]
            old = bias.take(cell)
            p += old
            p *= sign
            # the probability of the bit that came
            np.clip(p, -FAR, FAR, out=p)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += ONE
            np.reciprocal(p, out=p)
            if int(left[-1]) < TOGETHER or (left < TOGETHER).any():  # past the end of a text: nothing is paid or learnt
                p[np.repeat(_AHEAD[:, None] >= left, 8, axis=1)] = ONE
            for half in (p[: TOGETHER // 2], p[TOGETHER // 2 :]):  # eight factors stay in the range of floats
                cost[:live] += np.log10(np.multiply.reduce(half, axis=0)).reshape(live, 8).sum(1)
            np.subtract(ONE, p, out=p)
            p *= sign
            old += p * bias_rate
            bias[cell] = old
            p *= rate
            w += np.einsum("kbm,bm->km", x, p)
        out = np.empty(lanes)
        out[order] = cost
        return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def together(batches, most: int):
    """Batches of ids and texts, joined until their texts hold most characters."""
    ids, texts, size = [], [], 0
    for own, t in batches:
        ids, texts, size = ids + own, texts + t, size + sum(len(x or "") for x in t)
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def gathered(df: DataFrame, text: str, key: str, bits: int) -> DataFrame:
    """(kind, h, n, blob) of the training rows: token counts (kind 0) and parts of tables (kind 1), each added up in its task."""

    def run(batches):
        tables, seen_h, seen_n, size = Tables(bits), [], [], 0

        def tokens():
            h, at = np.unique(np.concatenate(seen_h), return_inverse=True)
            n = np.bincount(at, np.concatenate(seen_n)).astype(np.int64)
            return [np.zeros(len(h), np.int32), h.astype(np.int64), n, [None] * len(h)]

        def parts():
            now: list = []
            for part in tables.parts(last=True):
                now.append(part)
                if len(now) == 100:
                    yield [[1] * len(now), [h for h, _ in now], [0] * len(now), [b for _, b in now]]
                    now = []
            tables.clear()
            if now:
                yield [[1] * len(now), [h for h, _ in now], [0] * len(now), [b for _, b in now]]

        for ids, texts in batches:
            own = [(t or "").encode() for i, t in zip(ids, texts, strict=True) if not held_out(i)]
            if not own:
                continue
            tables.add(own)
            for _, _, words in blocks([t.lower() for t in own]):
                h, n = np.unique(words, return_counts=True)
                seen_h.append(h)
                seen_n.append(n)
                size += len(h)
            seen_h.append(np.array([END], np.uint64))
            seen_n.append(np.array([len(own)]))
            if size > 2_000_000:
                yield tokens()
                seen_h, seen_n, size = [], [], 0
            if tables.held > HELD:
                yield from parts()
        if seen_h:
            yield tokens()
        yield from parts()

    return map_rows(df, [F.col(key).cast("long"), F.col(text)], run, "kind int, h long, n long, blob binary")


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", top: int = 3_000_000):
    """(odds, token counts (h, n), the most frequent ones as sorted arrays, the least count among them, N, V)."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = bits_for(size)
    made = stored(gathered(df, text, key, bits))
    counts = stored(made.filter("kind = 0").groupBy("h").agg(F.sum("n").alias("n")))

    def added(t: pa.Table) -> pa.Table:
        first = (t.column("h")[0].as_py() & 0xFFFFFFFF) << part_bits(bits)
        at, n = (np.concatenate(x) for x in zip(*map(unpacked, t.column("blob").to_pylist()), strict=True))
        total = spread(at.astype(np.uint64), n, first, part_bits(bits))
        return pa.table({"h": pa.array(t.column("h")[:1].to_pylist(), pa.int64()), "odds": pa.array([log_odds(total).tobytes()], pa.binary())})

    tables = stored(made.filter("kind = 1").groupBy("h").applyInArrow(added, "h long, odds binary"))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = 2  # tokens seen once are most of a vocabulary; at every size they are left to the join
    if v > top:  # the least count that top tokens or fewer reach
        upto = 0
        for c, m in counts.groupBy(F.least("n", F.lit(1 << 20)).alias("c")).count().orderBy(F.desc("c")).toLocalIterator():
            upto += m
            if upto > top:
                least = max(least, c + 1)
                break
    rows = counts.filter(F.col("n") >= least).select("h", "n").toArrow()  # at most top rows
    h, c = rows.column("h").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return Odds(bits, tables.inputFiles()), counts, (h[order], np.minimum(c[order], 2**32 - 1).astype(np.uint32)), least, int(n), int(v)


def score(df: DataFrame, text: str = "text", key: str = "doc_id", top: int = 3_000_000) -> DataFrame:
    """One row per row of df: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the text with its end)."""
    spark = df.sparkSession
    shared_folder(spark)
    small_batches(spark)
    odds, counts, frequent, least, total, distinct = fit(df, text, key, top)
    sent = spark.sparkContext.broadcast((odds, *frequent))
    under = total + distinct + 1

    def run(batches):
        stored_odds, h, c = sent.value
        model = Mixer(stored_odds.bits, stored_odds.mapped())
        logs = lambda x: np.log10((x + 1.0) / under)
        for ids, texts in together(batches, GATHER):
            raw = [(t or "").encode() for t in texts]
            scores = model.scores(raw)
            n, known, base = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), np.zeros(len(raw))
            marks = [zlib.crc32(t) for t in raw]
            far: list = []
            for places, off, words in blocks([t.lower() for t in raw]):
                k = len(places)
                doc = np.repeat(np.arange(k), np.diff(off))
                words, doc = np.append(words, np.full(k, END)), np.append(doc, np.arange(k))
                own_words, spot = np.unique(words, return_inverse=True)  # sorted, so that the search stays in cache
                at = np.minimum(np.searchsorted(h, own_words), max(0, len(h) - 1))
                found = h[at] == own_words if len(h) else np.zeros(len(own_words), bool)
                hit = found[spot]
                own = slice(places.start, places.stop)
                n[own] = np.bincount(doc, minlength=k)
                known[own] = np.bincount(doc[hit], minlength=k)
                if len(h):
                    base[own] = np.bincount(doc[hit], logs(c[at].astype(np.float64))[spot[hit]], k)
                if not hit.all():
                    far.append((words[~hit], doc[~hit] + places.start))
            yield [[0] * len(raw), ids, marks, [held_out(i) for i in ids], n, known, base, scores, scores * -math.log2(10) / np.array([len(t) + 1 for t in raw]), [0] * len(raw)]
            for missed, doc in far:
                order = np.lexsort((missed, doc))
                d, w = doc[order], missed[order]
                first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])))
                d, w, m = d[first].tolist(), w[first], np.diff(np.append(first, len(order)))
                yield [[1] * len(m), [ids[i] for i in d], [marks[i] for i in d], [False] * len(m), m, [0] * len(m), [0.0] * len(m), [0.0] * len(m), [0.0] * len(m), w.astype(np.int64)]

    rows = map_rows(df, [F.col(key).cast("long"), F.col(text)], run, "kind int, id long, mark long, held_out boolean, n long, known long, base double, score double, bits double, h long")
    rows = stored(rows)
    missed = rows.filter("kind = 1").join(counts.filter(F.col("n") < least).withColumnRenamed("n", "c"), "h", "left")
    logs = F.log10((F.coalesce("c", F.lit(0)) + 1.0) / float(under))
    # rows that repeat have each sent their tokens: the sums are shared out among them
    found = missed.groupBy("id", "mark").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * logs).alias("b"))
    alike = rows.filter("kind = 0").groupBy(F.col("id").alias("id2"), F.col("mark").alias("mark2")).count()
    found = found.join(alike, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2"))).select("id2", "mark2", (F.col("k") / F.col("count")).cast("long").alias("k"), (F.col("b") / F.col("count")).alias("b"))
    rows = rows.filter("kind = 0").join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    rows = rows.withColumns({"known": F.col("known") + F.coalesce("k", F.lit(0)), "base": F.col("base") + F.coalesce("b", F.lit(0.0))})
    return rows.select(F.col("id").alias(key), "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.col("bits").alias("bits_per_byte"))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op4."""
    return score(df.select("doc_id", "text"))
