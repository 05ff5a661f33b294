"""Byte-level BPE encoding and decoding.

Texts are cut into pieces as the public split pattern cuts them (class runs found on
whole batches of code points).  Distinct pieces not met before are encoded together:
grouped by length in padded numpy matrices, where every row merges its leftmost pair
of least rank each round.  Pairs are looked up in an open hash table; merged rows are
compacted and finished rows leave the matrix.  In pieces of over ``LONG_PIECE`` bytes a round
merges all places of the least pair from the left, which is the same.  A store bounded in
bytes keeps the ids of pieces already met, so memory does not grow with the corpus; pieces are
told apart by two 64-bit hashes.

The general interface is :class:`ByteBPE` (``encode_batch``, ``decode``) and
:func:`encode` on DataFrames.  Null and empty texts have no ids.  Texts are taken whole
however long, a longer one alone; equal texts and repeated rows get equal ids; rows are never
dropped, and null doc_ids are kept.  Of a tie of ranks the leftmost pair goes first, as in the
public library.  An empty table gives an empty one.  Columns of the input with the name of
one made here are replaced, others kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What the split pattern takes after an apostrophe as a piece of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, NUMBER, OTHER, SPACE, END = range(5)
_MULT = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
#: Bytes of known pieces kept in a worker, bytes of texts taken together, and the bytes
#: from which a piece's rounds merge all places of its least pair.
STORE_BYTES, BATCH_BYTES, LONG_PIECE = 64_000_000, 400_000, 8_000
NO_RANK = np.iinfo(np.int32).max
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_VALUES, _SALTS = (_RANDOM.integers(1 << 63, size=2, dtype=np.uint64) for _ in range(2))


def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other.

    Letters and numbers are asked of the library whose results are to be matched, as
    versions of Unicode differ in what is a letter.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        matched = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(matched).decode().encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = SPACE
    return out


def piece_starts(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Flags of the positions where the split pattern begins a piece.

    ``cls`` holds END after each text (and begins with one), so that no piece or
    look-ahead crosses from one text into the next.
    """
    n = len(cp)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    space = cls == SPACE
    start = change.copy()
    # a run joins the plain space before it
    after_blank = np.zeros(n, bool)
    np.logical_and(cp[:-1] == 32, space[:-1], out=after_blank[1:])
    start &= ~after_blank | space | (cls == END)
    # of white space before more text, the last character begins anew
    last = np.zeros(n, bool)
    np.logical_and(space[:-1], ~space[1:] & (cls[1:] != END), out=last[:-1])
    start |= last
    # contractions
    at = np.flatnonzero((cp[:-1] == 39) & (cls[:-1] == OTHER) & (cls[1:] == LETTER))
    if len(at):
        at = at[change[at] & ~after_blank[at]]
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        for c in CONTRACTIONS:
            fit = one == ord(c[0])
            if len(c) == 2:
                fit &= two == ord(c[1])
            hit = at[fit]
            start[hit + 1] = False
            after = hit + 1 + len(c)
            start[after] = True  # an END at least follows every text
    return start


class PairTable:
    """Rank (= id) of the merged pair for two ids, by linear probing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 2 + 2))))
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.val = np.full(size, -1, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.key[s] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = free & first
            self.key[s[put]] = key[todo[put]]
            self.val[s[put]] = merged[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, -1 where the pair does not merge."""
        key = (left.astype(np.int64) << 32) | right
        key[(left < 0) | (right < 0)] = -2
        flat = key.ravel()
        slot = self._slot(flat)
        out = np.full(len(flat), -1, np.int32)
        got = self.key[slot]
        hit = got == flat
        out[hit] = self.val[slot[hit]]
        todo = np.flatnonzero(~hit & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            got = self.key[slot[todo]]
            hit = got == flat[todo]
            out[todo[hit]] = self.val[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out.reshape(key.shape)


class Places:
    """Random odd multipliers of the places in a piece, for each of the two hashes; made from
    the places when a longer piece comes."""

    def __init__(self) -> None:
        self.rows = [np.empty(0, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if n > len(self.rows[0]):
            self.rows = [_mixed(np.arange(2 * n, dtype=np.uint64) + salt) | np.uint64(1) for salt in _SALTS]
        return self.rows


_PLACES = Places()


def piece_hashes(cp: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece: sums of random values of its code
    points times random multipliers of their places (128 bits together)."""
    place = np.arange(len(cp)) - np.repeat(begin, size)
    out = []
    for value, by_place in zip(_VALUES, _PLACES.upto(int(size.max())), strict=True):
        x = (cp.astype(np.uint64) + value) * _MULT
        x ^= x >> np.uint64(29)
        x *= by_place[place]
        out.append(np.add.reduceat(x, begin))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _roomy(a: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """``a`` if it has room, else a copy of its used part in an array half as long again as wanted."""
    if wanted <= len(a):
        return a
    out = np.zeros(wanted + wanted // 2, a.dtype)
    out[:used] = a[:used]
    return out


class PieceStore:
    """Numbers of known pieces by their two hashes: open addressing in numpy arrays that double."""

    def __init__(self) -> None:
        self.bits, self.used = 16, 0
        self._room()

    def _room(self) -> None:
        self.first, self.second = (np.zeros(1 << self.bits, np.uint64) for _ in range(2))
        self.number = np.full(1 << self.bits, -1, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(first))
        while len(todo):
            s = slot[todo]
            full = self.number[s] >= 0
            hit = full & (self.first[s] == first[todo]) & (self.second[s] == second[todo])
            out[todo[hit]] = self.number[s[hit]]
            todo = todo[full & ~hit]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        """Pieces that are not there yet, each once."""
        self.used += len(first)
        if self.used * 5 > 3 << self.bits:  # three fifths are full
            old = self.number >= 0
            first, second, number = (np.concatenate([a[old], b]) for a, b in ((self.first, first), (self.second, second), (self.number, number)))
            self.bits = int(np.ceil(np.log2(self.used * 2)))
            self._room()
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(first))
        while len(todo):
            s = slot[todo]
            lead = np.zeros(len(todo), bool)
            lead[np.unique(s, return_index=True)[1]] = True
            put = lead & (self.number[s] < 0)
            at, what = s[put], todo[put]
            self.first[at], self.second[at], self.number[at] = first[what], second[what], number[what]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


class ByteBPE:
    """Encoder and decoder for one rank file (base64 token and rank on each line)."""

    def __init__(self, rank_file: str) -> None:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = max(self.tokens) + 1
        self.token_list = [self.tokens.get(i, b"") for i in range(self.size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = np.frombuffer(b"".join(self.token_list), np.uint8)
        self.token_bound = np.concatenate([[0], np.cumsum([len(t) for t in self.token_list])])
        self.ranks = ranks
        # any split of a token into two tokens can merge into it
        left, right, merged = [], [], []
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, merged)))
        self.classes = code_point_classes()
        self.clear()

    def clear(self) -> None:
        """Forget the pieces met so far."""
        self.known = PieceStore()
        self.flat = np.empty(1 << 16, np.int32)  # ids of known pieces; doubled when full
        self.offset = np.zeros(1 << 16, np.int64)
        self.pieces = 0

    def stored_bytes(self) -> int:
        return self.flat.nbytes + self.offset.nbytes + 20 * len(self.known.number)

    # -- pieces -> ids ---------------------------------------------------------

    def merge(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(lens, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            # a bucket holds like lengths and a bounded number of cells
            low = max(1, int(lens[order[at]]))
            end = int(np.searchsorted(lens[order], low + low // 4, "right"))
            end = max(at + 1, min(end, at + max(1, 1_000_000 // (low + low // 4 + 1))))
            self._merge_bucket(rows, order[at:end], lens[order[at:end]], done)
            at = end
        count = np.zeros(len(rows), np.int64)
        for which, n, _ in done:
            count[which] = n
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for which, n, ids in done:
            flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, count

    def _merge_bucket(self, rows: list[bytes], which: np.ndarray, n: np.ndarray, done: list) -> None:
        width = int(n.max())
        if width > LONG_PIECE:
            for i in which.tolist():
                ids = self._merge_long(rows[i])
                done.append((np.array([i]), np.array([len(ids)]), ids))
            return
        ids = np.full((len(which), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < n[:, None]] = self.byte_id[np.frombuffer(b"".join([rows[i] for i in which.tolist()]), np.uint8)]
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rank[rank < 0] = NO_RANK
        n = n.copy()
        while True:
            best = rank.argmin(1)
            r = np.arange(len(which))
            least = rank[r, best]
            over = least == NO_RANK
            if over.any():
                part, k = ids[over], n[over]
                done.append((which[over], k, part[np.arange(part.shape[1]) < k[:, None]]))
                keep = ~over
                if not keep.any():
                    return
                width = int(n[keep].max())
                ids, rank, n, which, best, least = ids[keep, : width + 1], rank[keep, :width], n[keep], which[keep], best[keep], least[keep]
                r = np.arange(len(which))
            # compaction: what follows the pair moves one place to the left
            move = np.arange(width) > best[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=move)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=move[:, :-1])
            ids[r, best] = least
            ids[:, -1] = -1
            rank[:, -1] = NO_RANK
            n -= 1
            # the two pairs that hold the new id
            before = np.maximum(best - 1, 0)
            left = np.where(best > 0, ids[r, before], -1)
            found = self.pairs.find(np.stack([left, least]), np.stack([least, ids[r, best + 1]]))
            found[found < 0] = NO_RANK
            rank[r, before] = np.where(best > 0, found[0], rank[r, before])
            rank[r, best] = found[1]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece: a round merges the places of the least pair from the left, up to
        the first that makes a pair of no greater rank, which comes next.

        The same as a round for each place: a place's merge changes nothing else before the
        next place of that rank is the leftmost least pair.
        """
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self._ranks(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) < NO_RANK:
            at = np.flatnonzero(rank == least)
            # places one after another overlap: of each run every second one counts
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            new = np.full(len(at), least, ids.dtype)
            left = np.where(np.diff(at, prepend=-2) == 2, least, ids[at - 1])
            left[at == 0] = -1
            right = np.append(ids, [-1, -1]).astype(ids.dtype)[at + 2]
            early = (self._ranks(left, new) <= least) | (self._ranks(new, right) <= least)
            if early.any():
                at = at[: int(early.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], np.append(rank, NO_RANK).astype(rank.dtype)[keep][:-1]
            now = at - np.arange(len(at))  # where the merged ids have come to lie
            for place in (now[now > 0] - 1, now[now < len(rank)]):
                rank[place] = self._ranks(ids[place], ids[place + 1])
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.find(left, right)
        found[found < 0] = NO_RANK
        return found

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Encode pieces that are not known yet; their numbers."""
        flat, count = self.merge([p.encode("utf-8") for p in pieces])
        first, used = self.pieces, int(self.offset[self.pieces])
        self.pieces += len(pieces)
        self.flat = _roomy(self.flat, used, used + len(flat))
        self.offset = _roomy(self.offset, first + 1, self.pieces + 1)
        self.flat[used : used + len(flat)] = flat
        self.offset[first + 1 : self.pieces + 1] = used + np.cumsum(count)
        return np.arange(first, self.pieces)

    # -- texts -----------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one bound more than texts)."""
        if self.stored_bytes() > STORE_BYTES:
            self.clear()
        joined = "\0".join(["", *texts, ""])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.concatenate([[0], np.cumsum(lens + 1)])  # places of the separators
        cls = self.classes[cp]
        cls[ends] = END
        begin = np.flatnonzero(piece_starts(cp, cls))
        stop = np.append(begin[1:], len(cp))
        real = cls[begin] != END
        first, second = piece_hashes(cp, begin, stop - begin)
        begin, stop, first, second = begin[real], stop[real], first[real], second[real]
        bound = np.searchsorted(begin, ends)  # pieces before each separator
        ix = self.known.find(first, second)
        miss = np.flatnonzero(ix < 0)
        if len(miss):
            # equal pieces lie together in this order, whatever their hashes
            order = miss[np.lexsort((second[miss], first[miss]))]
            new = np.ones(len(order), bool)
            new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            lead = order[new]
            number = self._learn([joined[a:b] for a, b in zip(begin[lead].tolist(), stop[lead].tolist(), strict=True)])
            self.known.add(first[lead], second[lead], number)
            ix[order] = number[np.cumsum(new) - 1]
        count = self.offset[ix + 1] - self.offset[ix]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.offset[ix] - total[:-1], count)]
        return ids, total[bound]

    def decode_batch(self, ids: np.ndarray, bound: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each text's bytes begin."""
        n = self.token_bound[ids + 1] - self.token_bound[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.token_bytes[np.arange(total[-1]) + np.repeat(self.token_bound[ids] - total[:-1], n)].tobytes(), total[bound]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


_ENCODERS: dict[str, ByteBPE] = {}


def encoder(rank_file: str) -> ByteBPE:
    """One encoder a Python worker, kept between tasks."""
    if rank_file not in _ENCODERS:
        _ENCODERS[rank_file] = ByteBPE(rank_file)
    return _ENCODERS[rank_file]


def chunks(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` bytes together, from a column; whole texts always, null
    as empty.  Only one chunk is turned into Python texts at a time."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 1)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + (limit or BATCH_BYTES), "right")))
        yield at, [t or "" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def encode(docs: DataFrame, rank_file: str, text: str = "text", ids: bool = False, digest: bool = True) -> DataFrame:
    """Add what BPE makes of ``text`` to each row of ``docs``; one row out for each row in.

    ``n_tokens`` long; with ``digest``, ``ids_sha256`` and ``decoded_sha256`` (of the ids
    as little-endian unsigned 32-bit integers, and of the bytes decoded from them); with
    ``ids``, ``token_ids`` binary.  Null texts count as empty; other columns pass through,
    except that a column of ``docs`` with a name made here is replaced.  There is no
    shuffle.  ``rank_file`` must exist on the executors, as an installed package's data does.
    """
    made = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else []), *(["token_ids"] if ids else [])]
    docs = docs.drop(*(c for c in made if c != text))
    kinds = {"n_tokens": "long", "token_ids": "binary"}
    schema = T.StructType(list(docs.schema.fields))
    for c in made:
        schema = schema.add(c, kinds.get(c, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file)
        for batch in batches:
            cells: dict[str, list] = {c: [] for c in made}
            for _, part in chunks(batch.column(text)):
                got, bound = bpe.encode_batch(part)
                if digest:
                    back, at = bpe.decode_batch(got, bound)
                    cells["decoded_sha256"] += [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    own = got[a:b].astype("<u4")
                    cells["n_tokens"].append(b - a)
                    if digest:
                        cells["ids_sha256"].append(hashlib.sha256(own).hexdigest())
                    if ids:
                        cells["token_ids"].append(own.tobytes())
            more = [pa.array(cells[c], pa.int64() if c == "n_tokens" else pa.binary() if c == "token_ids" else pa.string()) for c in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *made])

    return docs.mapInArrow(run, schema)


def rank_file() -> str:
    """The vocabulary of the registered queries; the operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return encode(docs, rank_file()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
