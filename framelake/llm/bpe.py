"""Byte-level BPE by corpus-level merge replay.

encode() takes the texts of an input partition block by block. The distinct words of a block stand in one symbol
array; an inverted index leads from each pair of neighbouring tokens to its positions in all those words. Merges are
applied in rank order to all their positions at once, and only the two neighbours of a merged pair change the index.
Words repeat far more than texts, so what has been replayed is kept and the replay sees a frequent word once per worker
(of CACHE_WORDS words or CACHE_CHARS characters held, the less used half goes, or all). Merges never cross a word's border, so the
replay of a block gives the ids that one replay over the whole corpus would. There is no shuffle and no state
between tasks: a lost executor costs its running tasks.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_batches, with_field

#: Characters of a block, and words handled at once in a longer text; words, and characters of them, that are held.
BLOCK_CHARS, BLOCK_WORDS, CACHE_WORDS, CACHE_CHARS = 1_000_000, 200_000, 200_000, 4_000_000
#: Places from which on one merge is done in arrays.
WIDE = 24
_SHIFT = 20
_BORDER, _GONE, _PAIR = -1, -2, (1 << 2 * _SHIFT) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes distinct words together; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words_of = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)])
        self.byte_pair = np.array([[ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)])
        self.merge = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merge[a << _SHIFT | b] = rank
        # ranks whose merge can make a pair of a lower rank
        self.odd = {x for pair, rank in self.merge.items() for x in (pair >> _SHIFT, pair & (1 << _SHIFT) - 1) if rank < x}
        self.pair_keys = np.array(sorted(self.merge), np.int64)
        self.pair_ranks = np.array([self.merge[x] for x in self.pair_keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        """Drops every word held."""
        self.at: dict[str, int] = {}
        self.chars = 0
        self.used, self.arrays = np.zeros(0, np.int64), (np.zeros(1, np.int64), np.zeros(0, np.int32))

    def thin(self) -> None:
        """Keeps the words used most since the last time, half of what can be held at most."""
        starts, ids = self.arrays
        bar = 2
        while (keep := np.nonzero(self.used >= bar)[0]).size > CACHE_WORDS // 2:
            bar *= 2
        words = np.array(list(self.at), object)[keep].tolist()
        sizes = starts[keep + 1] - starts[keep]
        self.at, self.chars = dict(zip(words, range(len(words)))), sum(map(len, words))
        self.used, self.arrays = np.zeros(len(words), np.int64), (np.concatenate(([0], np.cumsum(sizes))), ids[gather(starts[keep], sizes)])

    def learn(self, words) -> None:
        """Replays the words not yet held; a word that is a token needs no merge."""
        new = [w for w in words if w not in self.at]
        if not new:
            return
        raw = [w.encode() for w in new]
        whole = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int64, len(raw))
        merged, counts = self.replayed([w for w, r in zip(raw, whole.tolist()) if r < 0])
        sizes = np.ones(len(new), np.int64)
        sizes[whole < 0] = counts
        ids, by_merge = np.zeros(int(sizes.sum()), np.int32), np.repeat(whole < 0, sizes)
        ids[by_merge], ids[~by_merge] = merged, whole[whole >= 0]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.chars += sum(map(len, new))
        starts, before = self.arrays
        self.arrays = np.concatenate((starts, starts[-1] + np.cumsum(sizes))), np.concatenate((before, ids))
        self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        ids, counts = self.replayed(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    def replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has. token, after and before are one chain of symbols for all words, a border after each."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbols = self.byte[raw].astype(np.int64)
        symbols[np.cumsum(sizes + 1) - 1] = _BORDER
        # the index's first entries: neighbouring bytes that merge, grouped by their pair
        inner = np.nonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))[0]
        ranks = self.byte_pair[raw[inner], raw[inner + 1]]
        inner, ranks = inner[ranks >= 0], ranks[ranks >= 0]
        keys = ranks << 2 * _SHIFT | symbols[inner] << _SHIFT | symbols[inner + 1]
        by = np.argsort(keys, kind="stable")
        inner, keys = inner[by], keys[by]
        cuts = np.nonzero(np.diff(keys, prepend=-1))[0]
        due = keys[cuts].tolist()  # sorted, so a heap: rank, then the pair
        at = np.append(cuts, len(keys)).tolist()
        places = inner.tolist()
        index = {key & _PAIR: places[s:e] for key, s, e in zip(due, at, at[1:])}
        token, after, before = (array("q", x.tobytes()) for x in (symbols, np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)))
        chain = tuple(np.frombuffer(x, np.int64) for x in (token, after, before))
        starts = (np.cumsum(sizes + 1) - sizes - 1).tolist()
        merges, listed, push, pop = self.merge.get, index.get, heapq.heappush, heapq.heappop
        while due:
            rank, pairs = due[0] >> 2 * _SHIFT, [pop(due) & _PAIR]
            places = index.pop(pairs[0])
            while due and due[0] >> 2 * _SHIFT == rank:
                pairs.append(pop(due) & _PAIR)
                places += index.pop(pairs[-1])
            odd = rank in self.odd
            if len(places) >= WIDE and not odd:
                places = self.wide(chain, rank, pairs, places, index, due)
            elif len(places) > 1:
                places.sort()
            left, held = rank << _SHIFT, -1  # held: a word in which a merge made a pair of a lower rank, which comes first there
            for i in places:
                if token[i] < 0:
                    continue
                j = after[i]
                if token[j] < 0 or merges(pair := token[i] << _SHIFT | token[j]) != rank:
                    continue
                if odd and bisect.bisect_right(starts, i) == held:
                    if (entry := listed(pair)) is None:
                        index[pair] = [i]
                        push(due, rank << 2 * _SHIFT | pair)
                    else:
                        entry.append(i)
                    continue
                k, p = after[j], before[i]
                token[i], token[j], after[i], before[k] = rank, _GONE, k, i
                if (x := token[k]) >= 0 and (made := merges(pair := left | x)) is not None:
                    if (entry := listed(pair)) is None:
                        index[pair] = [i]
                        push(due, made << 2 * _SHIFT | pair)
                    else:
                        entry.append(i)
                    if made < rank:
                        held = bisect.bisect_right(starts, i)
                if p >= 0 and (x := token[p]) >= 0 and (made := merges(pair := x << _SHIFT | rank)) is not None:
                    if (entry := listed(pair)) is None:
                        index[pair] = [p]
                        push(due, made << 2 * _SHIFT | pair)
                    else:
                        entry.append(p)
                    if made < rank:
                        held = bisect.bisect_right(starts, i)
        live = np.concatenate(([0], np.cumsum(chain[0] >= 0)))
        ends = np.cumsum(sizes + 1)
        return chain[0][chain[0] >= 0], live[ends] - live[ends - sizes - 1]

    def wide(self, chain, rank: int, pairs: list[int], places: list[int], index: dict, due: list[int]) -> list[int]:
        """One merge at many places, in arrays. Returns the places instead where some of them overlap."""
        token, after, before = chain
        at = np.unique(np.array(places))
        at = at[token[at] >= 0]
        nxt = after[at]
        valid = np.isin(token[at] << _SHIFT | token[nxt], pairs) if len(pairs) > 1 else (token[at] == pairs[0] >> _SHIFT) & (token[nxt] == pairs[0] & (1 << _SHIFT) - 1)
        valid &= token[nxt] >= 0
        at, nxt = at[valid], nxt[valid]
        if (nxt[:-1] == at[1:]).any():
            return at.tolist()
        end = after[nxt]
        token[at], token[nxt], after[at], before[end] = rank, _GONE, end, at
        prev = before[at]  # -1 at the very start leads to the last border
        keys = np.concatenate((rank << _SHIFT | token[end], token[prev] << _SHIFT | rank))
        place = np.concatenate((at, prev))
        inner = np.concatenate((token[end], token[prev])) >= 0
        keys, place = keys[inner], place[inner]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[found] == keys
        keys, place, made = keys[hit], place[hit], self.pair_ranks[found[hit]]
        by = np.argsort(keys, kind="stable")
        keys, made, place = keys[by], made[by], place[by].tolist()
        cuts = np.nonzero(np.diff(keys, prepend=-1))[0]
        ends = np.append(cuts, len(keys)).tolist()
        for pair, r, s, e in zip(keys[cuts].tolist(), made[cuts].tolist(), ends, ends[1:]):
            entry = index.get(pair)
            if entry is None:
                index[pair] = place[s:e]
                heapq.heappush(due, r << 2 * _SHIFT | pair)
            else:
                entry += place[s:e]
        return []

    def block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        self.learn(dict.fromkeys(words))
        starts, ids = self.arrays
        which = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        sizes = starts[which + 1] - starts[which]
        flat = ids[gather(starts[which], sizes)]
        self.used += np.bincount(which, minlength=len(self.used))
        if len(self.at) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.thin()
            if self.chars > CACHE_CHARS // 2:
                self.forget()
        return flat, sizes

    def encode(self, texts: list[str | None]):
        """(number of texts, their ids one after another, ids of each text), block by block."""
        i = 0
        while i < len(texts):
            words, counts, chars, first = [], [], 0, i
            while i < len(texts) and (i == first or chars + len(texts[i] or "") <= BLOCK_CHARS):
                text = texts[i] or ""
                chars += len(text)
                if chars > 4 * BLOCK_CHARS:  # a text by itself
                    break
                found = self.words_of.findall(text)
                words += found
                counts.append(len(found))
                i += 1
            if counts:
                flat, sizes = self.block(words)
                ends = np.cumsum([0, *counts])
                yield len(counts), flat, np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends])
            else:
                parts, each = [], self.words_of.finditer(texts[i])
                while words := [m.group() for m in islice(each, BLOCK_WORDS)]:
                    parts.append(self.block(words)[0])
                flat = np.concatenate(parts)
                yield 1, flat, np.array([len(flat)])
                i += 1


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_ready: dict = {}


class _Vocabulary:
    """Ranks as a broadcast (its size is fixed by the vocabulary's file, some 50,000 tokens, not by the data), told apart by content."""

    def __init__(self, df: DataFrame, ranks: dict[bytes, int], pattern: str = ""):
        known = hashlib.sha256(b"".join(b"%d %d " % (len(t), r) + t for t, r in sorted(ranks.items())))
        self.shared, self.key = df.sparkSession.sparkContext.broadcast(ranks), (known.hexdigest(), pattern)

    def ready(self, kind):
        """The worker's own kind(ranks, pattern): one of each kind is held, that of the last vocabulary."""
        if _ready.get(kind, (None,))[0] != self.key:
            _ready[kind] = self.key, kind(self.shared.value, self.key[1])
        return _ready[kind][1]


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = ""):
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.sizes = np.zeros(tokens[-1][1] + 2, np.int64)
        for raw, rank in tokens:
            self.sizes[rank] = len(raw)
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw for raw, _ in tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
        """The bytes of each value, which has so many of the ids."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))]
        joined = self.flat[gather(self.starts[ids], self.sizes[ids])].tobytes()
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(joined)])


def _replaced(batch: pa.RecordBatch, *new: tuple[str, pa.Array], drop: str | None = None) -> pa.RecordBatch:
    gone = {name for name, _ in new} | {drop}
    keep = [i for i, x in enumerate(batch.schema.names) if x not in gone]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(x for _, x in new)], [*(batch.schema.names[i] for i in keep), *(x for x, _ in new)])


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, pa.int32()))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds out: the ids (array of int) of each whole text, as the tiktoken library's encode_ordinary gives them.

    A null or empty text has no ids (an empty array). Rows are neither dropped nor merged; repeated rows repeat
    their ids. A column of the name out is replaced; other columns pass through, null or not. An empty table has no rows.
    """
    bounded_batches(df.sparkSession)
    own = _Vocabulary(df, ranks, pattern)

    def run(batches):
        replay = own.ready(MergeReplay)
        for batch in batches:
            at = 0
            for n, flat, sizes in replay.encode(batch.column(text).to_pylist()):
                yield _replaced(batch.slice(at, n), (out, _lists(flat, sizes)))
                at += n

    return df.mapInArrow(run, with_field(df.schema, out, T.ArrayType(T.IntegerType())))


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """decode(encode(df)) without the text, in one pass through Python: a worker a core holds the vocabulary, and ids aren't sent to a second one."""
    bounded_batches(df.sparkSession)
    own = _Vocabulary(df, ranks, pattern)
    schema = T.StructType([f for f in df.schema.fields if f.name != text])
    schema = with_field(with_field(schema, ids, T.ArrayType(T.IntegerType())), decoded, T.BinaryType())

    def run(batches):
        replay, decoder = own.ready(MergeReplay), own.ready(Decoder)
        for batch in batches:
            at = 0
            for n, flat, sizes in replay.encode(batch.column(text).to_pylist()):
                yield _replaced(batch.slice(at, n), (ids, _lists(flat, sizes)), (decoded, decoder.decode(flat, sizes)), drop=text)
                at += n

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Like encode(), but keeps only the number of ids (long) and drops the text column."""
    bounded_batches(df.sparkSession)
    own = _Vocabulary(df, ranks, pattern)
    schema = with_field(T.StructType([f for f in df.schema.fields if f.name != text]), out, T.LongType())

    def run(batches):
        replay = own.ready(MergeReplay)
        for batch in batches:
            sizes = [s for _, _, s in replay.encode(batch.column(text).to_pylist())]
            counts = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield _replaced(batch, (out, counts), drop=text)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds out: the bytes (binary) of the ids. Null ids give null; an id outside the vocabulary is an error. Rows and other
    columns are as in encode()."""
    bounded_batches(df.sparkSession)
    own = _Vocabulary(df, ranks)

    def run(batches):
        decoder = own.ready(Decoder)
        for batch in batches:
            column = batch.column(ids)
            counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            made = decoder.decode(column.flatten().to_numpy(zero_copy_only=False), counts)
            if column.null_count:
                made = pa.compute.if_else(column.is_valid(), made, pa.scalar(None, pa.binary()))
            yield _replaced(batch, (out, made))

    return df.mapInArrow(run, with_field(df.schema, out, T.BinaryType()))


def digests(encoded: DataFrame, ids: str = "ids") -> list:
    """Columns n_tokens and ids_sha256 of an encoded frame."""
    joined = F.array_join(F.col(ids).cast("array<string>"), " ")
    return [F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256")]
