"""Byte-level BPE: whole texts to token ids and back.

A text is cut by the tokenizer's pattern; each piece that is not a token itself is merged
by the ranks. Merging uses a rank queue: one bucket of linked-list positions per rank, and
a hierarchical bitmap over the ranks in which find-first-set gives the next one, so that a
piece of n bytes takes O(n log n) steps however long it is. Entries whose pair has changed
since they were queued are skipped when they come up. Short pieces that are new to a Python
worker share one queue, whose buckets are worked off by array operations.

Texts are encoded where they lie; nothing is shuffled. NULL and empty texts give no ids.
Ids are kept as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces kept with their ids in each Python worker, and the longest such piece: bounds on memory, not on input.
KEPT_PIECES, KEPT_CHARS = 200_000, 40
BATCH_CHARS = 3_000_000  # texts whose new pieces are merged together
LONG = 200  # bytes from which a piece is merged by itself
FAN, LOW = 8, 255  # 256 ranks in each word of the bitmap
ID_BITS = 24  # ids lie below 2**24


class Merges:
    """Ranks of pairs of tokens, keyed by both ids, beside the ranks of whole pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([i])] if bytes([i]) in ranks else -1 for i in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = rank
        self.byte_ids_array = np.array(self.byte_ids, np.int64)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        every = np.arange(256)
        self.byte_pairs = self.lookup(self.byte_ids_array[every][:, None] << ID_BITS | self.byte_ids_array[every]).reshape(256, 256)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where a pair is no token."""
        if not len(self.keys):
            return np.full(keys.shape, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


def merge(piece: bytes, merges: Merges) -> list[int]:
    """Token ids of one piece: always the pair of least rank, the leftmost of equal ones."""
    whole = merges.ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank_of = len(piece), merges.pairs.get
    ids = [merges.byte_ids[b] for b in piece]
    due = [rank_of(a << ID_BITS | b, -1) for a, b in zip(ids, ids[1:])]  # rank of the pair that starts here
    due.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    buckets: dict[int, list[int]] = {}  # rank: heap of positions
    words: dict[int, int] = {}  # lower level of the bitmap: 256 ranks each
    top = 0  # upper level: the words that are not empty
    for at, rank in enumerate(due):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(at)  # ascending, so a heap already
            else:
                buckets[rank] = [at]
                word = rank >> FAN
                words[word] = words.get(word, 0) | 1 << (rank & LOW)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word << FAN | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if due[at] != rank:
            continue  # stale: the pair has gone into another token
        gone = after[at]
        ids[at], ids[gone], due[gone] = rank, -1, -1
        after[at] = end = after[gone]
        due[at] = -1
        if end < n:
            before[end] = at
            due[at] = new = rank_of(rank << ID_BITS | ids[end], -1)
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    word = new >> FAN
                    words[word] = words.get(word, 0) | 1 << (new & LOW)
                    top |= 1 << word
        at = before[at]
        if at >= 0:
            due[at] = new = rank_of(ids[at] << ID_BITS | rank, -1)
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    word = new >> FAN
                    words[word] = words.get(word, 0) | 1 << (new & LOW)
                    top |= 1 << word
    return [i for i in ids if i >= 0]


def merge_many(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Ids (as bytes) of many short pieces at once, by one queue for all of them.

    A bucket then holds positions of several pieces; of each piece the leftmost is merged,
    the others wait in the bucket, so every piece goes through the steps of ``merge``.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.concatenate([[0], np.cumsum(sizes)])
    raw, n = np.frombuffer(b"".join(pieces), np.uint8), int(first[-1])
    # positions and ids fit 32 bits: a batch's pieces are short
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    ids = merges.byte_ids_array.astype(np.int32)[raw]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[first[1:] - 1], before[first[:-1]] = n, -1
    due = np.append(merges.byte_pairs.astype(np.int32)[raw[:-1], raw[1:]], np.int32(-1))
    due[first[1:] - 1] = -1
    order = np.flatnonzero(due >= 0).astype(np.int32)
    order = order[np.argsort(due[order], kind="stable")]
    starts = np.flatnonzero(np.diff(due[order], prepend=-1))
    waiting = {int(due[part[0]]): part for part in np.split(order, starts[1:]) if len(part)}  # as sorted, before any merge
    buckets: dict[int, list[int]] = {}  # what comes up later
    words: dict[int, int] = {}
    for rank in waiting:
        words[rank >> FAN] = words.get(rank >> FAN, 0) | 1 << (rank & LOW)
    top = sum(1 << word for word in words)
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word << FAN | (bits & -bits).bit_length() - 1
        at = np.array(buckets.pop(rank, []), np.int64)
        if rank in waiting:
            at = np.concatenate([waiting.pop(rank), at])
        at = np.sort(at[due[at] == rank])  # the rest is stale
        lead = np.diff(piece[at], prepend=-1) != 0
        if lead.all():
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        else:
            buckets[rank] = at[~lead].tolist()
            at = at[lead]
        gone = after[at]
        end = after[gone]
        ids[at], ids[gone], due[gone], due[at], after[at] = rank, -1, -1, -1, end
        inner = end < n
        right, end, left = at[inner], end[inner], before[at]
        before[end] = right
        left = left[left >= 0]
        changed = np.concatenate([right, left])
        new = merges.lookup(np.concatenate([ids[end].astype(np.int64) | rank << ID_BITS, ids[left].astype(np.int64) << ID_BITS | rank]))
        due[changed] = new
        some = new >= 0
        for rank, i in zip(new[some].tolist(), changed[some].tolist()):
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]  # others may wait, then the bit is set already
                word = rank >> FAN
                words[word] = words.get(word, 0) | 1 << (rank & LOW)
                top |= 1 << word
    kept = ids >= 0
    ends = (np.append(0, np.cumsum(kept))[first] * 4).tolist()
    out = ids[kept].astype("<u4").tobytes()
    return [out[a:b] for a, b in zip(ends, ends[1:])]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file (``path`` is local to the driver; the ranks travel with the job)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _members(prop: str) -> str:
    """The characters of a class, by the Unicode tables of the tokenizer library."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    coder = tiktoken.Encoding("class", pat_str=prop + "+", mergeable_ranks=single, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return coder.decode_bytes(coder.encode_ordinary(every)).decode()


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}-\\U{chars[j]:08x}")
        i = j + 1
    return "".join(out)


def split_patterns(pattern: str) -> tuple[str, str]:
    r"""The pattern with \p{L}, \p{N}, \s and \S spelled out: for Latin-1 texts, for all texts."""
    out = []
    for end in (0x100, 0x110000):
        letter, number, space = ([ord(c) for c in _members(p) if ord(c) < end] for p in (r"\p{L}", r"\p{N}", r"\s"))
        spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_ranges(sorted(letter + number + space))}]")
        spelled = spelled.replace(r"\p{L}", f"[{_ranges(letter)}]").replace(r"\p{N}", f"[{_ranges(number)}]")
        out.append(spelled.replace(r"\s", f"[{_ranges(space)}]").replace(r"\S", f"[^{_ranges(space)}]"))
    return out[0], out[1]


class Encoder(dict):
    """Ids of pieces as bytes; short pieces that came up more than once among some texts are remembered."""

    def __bool__(self) -> bool:
        return True

    def __init__(self, ranks: dict[bytes, int], patterns: tuple[str, str]) -> None:
        super().__init__()
        self.merges = Merges(ranks)
        self.latin, self.any = (re.compile(p) for p in patterns)

    def _found(self, text: str | None) -> list[str]:
        if not text:
            return []
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            return self.any.findall(text)

    def _learn(self, pieces: Iterable[str]) -> None:
        ranks, several = self.merges.ranks, []
        for piece in pieces:
            raw = piece.encode()
            whole = ranks.get(raw)
            if whole is not None:
                self[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self[piece] = array("I", merge(raw, self.merges)).tobytes()
            else:
                several.append((piece, raw))
        if several:
            self.update(zip((p for p, _ in several), merge_many([raw for _, raw in several], self.merges)))

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text."""
        return [ids for part in self.parts(texts) for ids in part]

    def parts(self, texts: list) -> Iterator[list[bytes]]:
        """The same, some texts at a time: what is done need not stay in memory."""
        i = 0
        while i < len(texts):
            found, chars = [], 0
            while i < len(texts) and chars < BATCH_CHARS:
                found.append(self._found(texts[i]))
                chars += len(texts[i] or "")
                i += 1
            times = Counter(chain.from_iterable(found))
            new = {piece: n for piece, n in times.items() if piece not in self}
            del times
            self._learn(new)
            out = [b"".join(map(self.__getitem__, pieces)) for pieces in found]
            for piece, n in new.items():
                if n == 1 or len(piece) > KEPT_CHARS:
                    del self[piece]
            if len(self) > KEPT_PIECES:
                self.clear()
            del found, new
            yield out


def encoder(spark, ranks: dict[bytes, int], pattern: str):
    """A column function: text to ids."""
    shared = spark.sparkContext.broadcast({"parts": (ranks, split_patterns(pattern))})

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state = shared.value  # one object per Python worker, so the coder lasts for all its tasks
        coder = state["coder"] = state.get("coder") or Encoder(*state["parts"])
        for texts in batches:
            for part in coder.parts(texts.tolist()):
                yield pd.Series(part, dtype=object)

    encoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encoded, "binary")


def decoder(spark, ranks: dict[bytes, int]):
    """A column function: ids to the bytes they stand for."""
    shared = spark.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([joined(ids, shared.value) for ids in column], dtype=object)

    decoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decoded, "binary")


def joined(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, array("I", ids)))


def round_trip(spark, ranks: dict[bytes, int], pattern: str):
    """A column function: text to its ids and the bytes these decode to, in one Python worker."""
    shared = spark.sparkContext.broadcast({"parts": (ranks, split_patterns(pattern))})

    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = shared.value
        coder = state["coder"] = state.get("coder") or Encoder(*state["parts"])
        tokens = state["tokens"] = state.get("tokens") or {i: b for b, i in state["parts"][0].items()}
        for texts in batches:
            for ids in coder.parts(texts.tolist()):
                yield pd.DataFrame({"token_ids": ids, "decoded": [joined(i, tokens) for i in ids]}, dtype=object)

    both.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(both, "token_ids binary, decoded binary")


def id_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """The table with the ids of ``text`` in column ``out``; its other columns and repeated rows stay."""
    return docs.withColumn(out, encoder(docs.sparkSession, ranks, pattern)(F.col(f"`{text}`").cast("string")))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The table with the bytes of the ids in column ``out``."""
    return docs.withColumn(out, decoder(docs.sparkSession, ranks)(F.col(f"`{ids}`")))


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """The table with columns ``token_ids`` and ``decoded``: what ``encode`` and ``decode`` give, in one pass."""
    both = docs.withColumn("_coded", round_trip(docs.sparkSession, ranks, pattern)(F.col(f"`{text}`").cast("string")))
    return both.withColumns({c: F.col("_coded")[c] for c in ("token_ids", "decoded")}).drop("_coded")
