"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units (a run of the space mark and what
follows it; no piece of the model spans more). The distinct units that the
task has not met yet are joined into one string and indexed by a suffix
array, in stretches of ``CHUNK`` characters, sorted as deep as the longest
piece. Units recur, so a task keeps the ids of those it has met, up to
``MEMORY`` characters and ids; then it starts afresh. Every piece is looked up by binary search; its range in
the array is the set of its occurrences. These edges, sorted by position
and length, are what relaxation works on.

The public model at hand is a BPE model, so an edge's weight is a merge
rank, and adding weights along paths (as for unigram models) gives other
ids than the model's. Relaxation therefore takes the best-ranked edge over
two neighbouring symbols of a unit, the leftmost of equals, and repeats
until no edge is left: all units of a batch take a step at once, and units
over ``LONG`` characters go through a heap, one merge in O(log n). Symbols
without a piece become byte pieces. The ids equal the model's own. The model's bytes travel by broadcast, so only
the driver opens its file.

Decoding joins the pieces' bytes, turns space marks into spaces and drops
the leading one. decode(encode(x)) is x, except that U+2581 in a text
comes back as a space, as in the model's own code.

Defined cases: a null text has null ids and a null decoded text; an empty
text has no ids; ids out of range and control pieces decode to nothing and
invalid bytes to U+FFFD; a unit of any length is encoded whole, in memory
linear in its length (some 120 bytes a character); repeated rows and empty tables need no care (rows
are independent); ``encode`` keeps all columns and adds one, which must
not exist yet.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import small_batches
from ticketlens.llm.token_hashes import gather

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LONG = 256
#: Characters of distinct units that are indexed at once.
CHUNK = 1 << 18
#: Characters of texts whose units are told apart at once.
GROUP = 1 << 22
#: Characters and ids of units whose ids a task keeps.
MEMORY = 1 << 23
#: Rows of an Arrow batch.
ROWS = 512


class Pieces:
    """The model's table of pieces."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        plain, self.raw = [], []
        for i, p in enumerate(self.names):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                plain.append((p, i, sp.get_score(i)))
                self.raw.append(p.encode().replace(SPACE.encode(), b" "))
        self.longest = max(len(p) for p, _, _ in plain)
        self.texts = [p for p, _, _ in plain]
        self.ids = np.array([i for _, i, _ in plain], dtype=np.int32)
        # rank of merges: 1 is best; equal scores share a rank, the position decides
        order = sorted({-s for _, _, s in plain})
        rank = {s: k + 1 for k, s in enumerate(order)}
        self.ranks = np.array([rank[-s] for _, _, s in plain], dtype=np.int32)
        self.lengths = np.array([len(p) for p in self.texts], dtype=np.int64)
        # characters by number; those of no piece are 0, as is what follows the end of a text
        self.alphabet = np.array(sorted({ord(c) for p in self.texts for c in p}), dtype=np.int64)
        self.bits = (len(self.alphabet) + 1).bit_length()
        self.block = 62 // self.bits  # characters of a key
        self.blocks = -(-self.longest // self.block)
        self.low = np.stack([self.keys_of([p[j * self.block:(j + 1) * self.block] for p in self.texts], 0) for j in range(self.blocks)])
        self.high = np.stack([self.keys_of([p[j * self.block:(j + 1) * self.block] for p in self.texts], (1 << self.bits) - 1) for j in range(self.blocks)])
        self.raw_lengths = np.array([len(b) for b in self.raw], dtype=np.int64)
        self.raw_starts = np.concatenate([[0], np.cumsum(self.raw_lengths)[:-1]])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)


    def numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def keys_of(self, parts: list[str], fill: int) -> np.ndarray:
        """Keys of strings of up to ``block`` characters, filled up."""
        numbers = np.full((len(parts), self.block), fill, dtype=np.int64)
        for k, p in enumerate(parts):
            if p:
                numbers[k, :len(p)] = self.numbers(np.array([ord(c) for c in p], dtype=np.int64))
        return self.packed(numbers)

    def packed(self, numbers: np.ndarray) -> np.ndarray:
        out = numbers[..., 0]
        for j in range(1, self.block):
            out = (out << self.bits) | numbers[..., j]
        return out


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def load(path: str) -> Pieces:
    return pieces_of(Path(path).read_bytes())


def suffix_array(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, list]:
    """Positions sorted by the next ``longest`` characters, and the keys of
    each sorted position, one for each block of characters."""
    n = len(codes)
    numbers = np.zeros(n + pieces.block * pieces.blocks, dtype=np.int64)
    numbers[:n] = pieces.numbers(codes)
    first = pieces.packed(np.lib.stride_tricks.sliding_window_view(numbers, pieces.block))
    keys = [first[j * pieces.block:j * pieces.block + n] for j in range(pieces.blocks)]
    # ranks of blocks of characters are short: three of them make one number to sort
    rank, width = ranked(first), len(first).bit_length()
    sort_by, held = np.zeros(n, dtype=np.int64), 0
    for j in range(pieces.blocks):
        if (held + 1) * width > 62:
            sort_by, held = ranked(sort_by), 1
        sort_by, held = (sort_by << width) | rank[j * pieces.block:j * pieces.block + n], held + 1
    order = np.argsort(sort_by)
    return order, [k[order] for k in keys]


def ranked(values: np.ndarray) -> np.ndarray:
    """Each value's number among the distinct ones."""
    order = np.argsort(values)
    v = values[order]
    out = np.empty(len(v), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[False], v[1:] != v[:-1]])) if len(v) else 0
    return out


def edges(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """table[position, length]: number + 1 of the piece that begins there,
    0 for none. codes end with a terminator that is in no piece. Stretches
    of bounded size are indexed one by one, each with what its last
    positions reach into."""
    n = len(codes)
    table = np.zeros((n, pieces.longest + 1), dtype=np.uint16 if len(pieces.lengths) < 65535 else np.int32)
    for at in range(0, n, 2 * CHUNK):
        part = codes[at:at + 2 * CHUNK + pieces.longest]
        own = min(2 * CHUNK, n - at)
        position, length, piece = occurrences(part, pieces)
        inside = position < own
        table[at + position[inside], length[inside]] = piece[inside] + 1  # a table by position and length is the sorted order
    return table


def narrowed(keys: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, above: bool) -> np.ndarray:
    """First place from low on, up to high, whose key is not below (is
    above) the wanted one: binary search in all ranges at once."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        right = keys[mid] <= wanted[open_] if above else keys[mid] < wanted[open_]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def occurrences(codes: np.ndarray, pieces: Pieces):
    """(position, length, piece) of every occurrence of every piece."""
    order, keys = suffix_array(codes, pieces)
    # a piece's range: that of its first block of characters, narrowed block by block
    first = np.searchsorted(keys[0], pieces.low[0], side="left")
    after = np.searchsorted(keys[0], pieces.high[0], side="right")
    for j in range(1, pieces.blocks):
        open_ = np.flatnonzero((first < after) & (pieces.lengths > j * pieces.block))
        low, high = first[open_], after[open_]
        first[open_] = narrowed(keys[j], low, high, pieces.low[j][open_], False)
        after[open_] = narrowed(keys[j], low, high, pieces.high[j][open_], True)
    counts = after - first
    which = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return order[place], pieces.lengths[which], which


def relax(table: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Length of the symbol at each position (0 inside a symbol)."""
    n = len(table)
    rank_of = np.concatenate([[0], pieces.ranks])
    length = np.zeros(n + 1, dtype=np.int64)
    for a, b in zip(starts[ends - starts > LONG].tolist(), ends[ends - starts > LONG].tolist()):
        length[a:b] = relax_long(table[a:b], rank_of, b - a)
    short = ends - starts <= LONG
    size = (ends - starts)[short]
    pos = np.repeat(starts[short], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    unit = np.repeat(np.arange(short.sum()), size)
    length[pos] = 1
    far = np.iinfo(np.int64).max

    def pair(at, of_unit, limit):
        """Merge key of the symbols at ``at`` and after it: rank, then
        place, so equal ranks go left first."""
        total = length[at].copy()
        follow = at + total
        inside = follow < limit[of_unit]
        total += np.where(inside, length[np.minimum(follow, n)], 0)
        fits = inside & (total <= pieces.longest)
        rank = rank_of[table[at, np.where(fits, total, 0)]]
        return np.where(fits & (rank > 0), rank.astype(np.int64) * (n + 1) + at, far)

    limit = ends[short]
    key = np.full(n + 1, far, dtype=np.int64)
    key[pos] = pair(pos, unit, limit)
    before = np.full(n + 1, -1, dtype=np.int64)
    before[pos] = pos - 1
    before[starts] = -1
    while len(pos):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(key[pos], first)
        alive = best < far
        if not alive.any():
            break
        of = unit[first][alive]
        at = best[alive] % (n + 1)
        gone = at + length[at]
        length[at] += length[gone]
        length[gone] = 0
        key[gone] = far
        after = at + length[at]
        has = after < limit[of]
        before[after[has]] = at[has]
        key[at] = pair(at, of, limit)
        left = before[at]
        some = left >= 0
        key[left[some]] = pair(left[some], of[some], limit)
        live = np.zeros(len(limit), dtype=bool)
        live[of] = True
        keep = live[unit] & (length[pos] > 0)
        pos, unit = pos[keep], unit[keep]
    return length[:n]


def relax_long(table: np.ndarray, rank_of: np.ndarray, n: int):
    """The same for one unit, with a heap of merges. A merge is one number:
    rank, place, and the lengths of its left symbol and of the whole."""
    length, before = array("q", [1]) * n, array("q", range(-1, n - 1))
    longest = table.shape[1] - 1
    ranks = rank_of[table[np.arange(n - 1), 2]] if longest > 1 else np.zeros(n - 1, dtype=np.int64)
    some = np.flatnonzero(ranks)
    bits = n.bit_length()
    heap = ((((ranks[some].astype(object) << bits) | some.astype(object)) << 20) | (1 << 10) | 2).tolist()
    heapq.heapify(heap)
    mask = (1 << bits) - 1

    def push(a):
        b = a + length[a]
        if b < n:
            total = length[a] + length[b]
            if total <= longest:
                piece = table[a, total]
                if piece:
                    heapq.heappush(heap, (((int(rank_of[piece]) << bits) | a) << 20) | (length[a] << 10) | total)

    while heap:
        key = heapq.heappop(heap)
        a, la, total = (key >> 20) & mask, (key >> 10) & 1023, key & 1023
        b = a + la
        if length[a] != la or b >= n or length[b] != total - la:
            continue
        length[a], length[b] = total, 0
        if a + total < n:
            before[a + total] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    return np.frombuffer(length, dtype=np.int64)


def encode_units(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, number of ids of each)."""
    ids, counts = [], []
    at = 0
    while at < len(units):
        end, size = at, 0
        while end < len(units) and (end == at or size + len(units[end]) < CHUNK):
            size += len(units[end])
            end += 1
        part, at = units[at:end], end
        sizes = np.array([len(u) for u in part], dtype=np.int64)
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        table = edges(np.concatenate([codes, [-1]]), pieces)[:-1]
        length = relax(table, ends - sizes, ends, pieces)
        where = np.flatnonzero(length)
        piece = table[where, length[where]].astype(np.int64)
        known = piece > 0
        token = np.concatenate([[0], pieces.ids])[piece]
        n_tokens = np.ones(len(where), dtype=np.int64)
        if not known.all():  # single characters without a piece: their UTF-8 bytes
            raw = [chr(c).encode("utf-8", "replace") for c in codes[where[~known]].tolist()]
            n_tokens[~known] = [len(b) for b in raw]
            spread = np.repeat(token, n_tokens)
            spread[np.repeat(~known, n_tokens)] = pieces.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            token = spread
        of = np.searchsorted(ends, where, side="right")
        ids.append(token.astype(np.int32))
        counts.append(np.bincount(of, weights=n_tokens, minlength=len(part)).astype(np.int64))
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Met:
    """Units that a task has met, with their ids."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.size = np.zeros(0, dtype=np.int32), 0

    def add(self, fresh: list[str], pieces: Pieces) -> None:
        """The units' ids; ``fresh`` are numbered next, in order."""
        ids, counts = encode_units(fresh, pieces)
        self.starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.ids)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.size += len(ids) + sum(map(len, fresh))


def encode_texts(texts: list[str], pieces: Pieces, met: Met | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    met = met or Met()
    number, fresh = met.number, []
    place, per_text = [], []
    for text in texts:
        units = UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []
        for u in set(units):
            if u not in number:
                number[u] = len(number)
                fresh.append(u)
        place += map(number.__getitem__, units)
        per_text.append(len(units))
    met.add(fresh, pieces)
    place = np.array(place, dtype=np.int64)
    counts = met.counts[place]
    out = met.ids[gather(met.starts[place], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    cut = np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])
    return out, ends[cut[1:]] - ends[cut[:-1]]


def decode_ids(ids: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> list[str]:
    """The texts of rows of ids, given one after the other."""
    ids = np.where((ids < 0) | (ids >= len(pieces.raw)), 0, ids)  # the unknown piece is empty
    lengths = pieces.raw_lengths[ids]
    raw = pieces.raw_bytes[gather(pieces.raw_starts[ids], lengths)].tobytes()
    at = np.concatenate([[0], np.cumsum(lengths)])
    cut = at[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
    return [t[1:] if t[:1] == " " else t for t in texts]


def grouped(texts: list):
    """Stretches of rows of a bounded number of characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or "") > GROUP:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    yield at, len(texts)


def encode(docs: DataFrame, text: str = "text", to: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with the ids of their text in column ``to``."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches):
        import pyarrow as pa
        pieces, met = pieces_of(shared.value), Met()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            all_ids, all_sizes = [], []
            for a, b in grouped(texts):
                if met.size > MEMORY:
                    met = Met()
                ids, sizes = encode_texts([t or "" for t in texts[a:b]], pieces, met)
                all_ids.append(ids)
                all_sizes.append(sizes)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(all_sizes))]).astype(np.int32)
            missing = pa.array([t is None for t in texts], pa.bool_())
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids), pa.int32()), mask=missing)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, to])

    small_batches(docs.sparkSession, ROWS)
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """The rows with the text of their ids in column ``to``."""
    shared = rows.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches):
        import pyarrow as pa
        pieces = pieces_of(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            missing = column.is_null().to_pylist()
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode_ids(column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), sizes, pieces)
            out = pa.array([None if gone else t for gone, t in zip(missing, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, to])

    small_batches(rows.sparkSession, ROWS)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))
