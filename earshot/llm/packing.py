"""Best-fit packing: token pieces placed into as few sequences of a bounded length as can be.

``pieces`` turns texts into token ids, ends each with one end id and cuts what is longer than
a sequence (the first piece may be shorter, so that only it leaves room). ``pack`` counts
pieces by length, which gives at most ``capacity`` rows whatever the table, solves the
configuration program over this histogram (configurations.py) on the driver, and numbers the
pieces of each length: a number says which configuration a piece belongs to, which copy of it
and which place there. Numbers are counted within the stored partitions and moved on by the
counts of the partitions before, so a length that a third of all pieces share is no one task's
work. The plan that goes to the tasks grows with the number of lengths only.

A NULL or empty text is its end id alone. Equal rows are packed one by one. Pieces whose
length is NULL, below one or above the capacity get a NULL place. Columns the caller has stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from earshot.llm.bpe import split_patterns
from earshot.llm.configurations import plan
from earshot.llm.tables import written

CAPACITY = 2048
END_ID = 0
KEPT_PIECES = 400_000  # distinct pre-tokens a worker remembers; forgetting them changes no ids
TEXTS = 500  # texts whose pieces are sent on together


def byte_letters() -> dict[int, str]:
    """The letters byte-level vocabularies write bytes with: printable Latin-1 as it is, the others in order from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Coder(dict):
    """Pre-token to its ids (little-endian unsigned 32-bit), by the tokenizer's own model."""

    def __init__(self, path: str, patterns: tuple[str, str]) -> None:
        self.model = Tokenizer.from_file(path).model
        self.latin, self.any = (re.compile(p).findall for p in patterns)
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        return ids

    def __bool__(self) -> bool:
        return True

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin(text)
        except UnicodeEncodeError:
            return self.any(text)

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text or "")))


def cuts(n: int, limit: int) -> list[int]:
    """Where the pieces of n ids start, and n: all but the first are as long as a sequence."""
    return [0, *range((n - 1) % limit + 1, n, limit), n]


def pieces(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = CAPACITY) -> DataFrame:
    """One row per piece: ``key``, piece, start, length and ids (binary, little-endian unsigned 32-bit).

    ``tokenizer`` is a byte-level file of the tokenizers library and ``pattern`` the one it splits texts by.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (tokenizer, split_patterns(pattern))})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = shared.value  # one object per Python worker, so the coder lasts for all its tasks
        coder = state["coder"] = state.get("coder") or Coder(*state["parts"])
        for pdf in batches:
            for i in range(0, len(pdf), TEXTS):
                some, of, rows = pdf.iloc[i:i + TEXTS], [], []
                for j, t in enumerate(some["text"]):
                    ids = coder.ids(t) + end
                    at = cuts(len(ids) // 4, limit)
                    rows += [(p, a, b - a, ids[4 * a:4 * b]) for p, (a, b) in enumerate(zip(at, at[1:]))]
                    of += [j] * (len(at) - 1)
                found = pd.DataFrame(rows, columns=["piece", "start", "length", "ids"])
                found.insert(0, "key", some["key"].array.take(of))
                yield found

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(
        cut, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


class Places:
    """The plan as arrays: for the pieces of a length from a number on, their configuration's sequences and offsets."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        found, self.bound = plan(histogram, capacity)
        used = dict.fromkeys(histogram, 0)
        rows, first = [], 0
        for configuration, times in found:
            offset = 0
            for length, copies in configuration:
                rows.append((length, used[length], first, copies, offset))
                used[length] += copies * times
                offset += length * copies
            first += times
        self.sequences = first
        length, self.number, self.first, self.copies, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.start = np.searchsorted(length, np.arange(capacity + 2))  # rows of each length

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers within their lengths."""
        row = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        at = np.flatnonzero(np.diff(length[order], prepend=-1))
        for i, j in zip(at, np.append(at[1:], len(order))):
            some, own = order[i:j], length[order[i]]
            low, high = self.start[own], self.start[own + 1]
            row[some] = low + np.searchsorted(self.number[low:high], number[some], side="right") - 1
        copy, place = np.divmod(number - self.number[row], self.copies[row])
        return self.first[row] + copy, self.offset[row] + place * length


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """The rows with the sequence each is in and its place there; sequences have no gaps before their end."""
    size = F.col(f"`{length}`").cast("long")
    stored = written(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), size.alias("length")))
    fits = F.col("length").between(1, capacity)
    numbered = stored.withColumns({"slot": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    counts = numbered.where(fits).groupBy("length", "slot").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = Places(histogram, capacity)

    @F.pandas_udf("sequence long, offset long")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, numbers in batches:
            found = places.of(lengths.to_numpy(np.int64), numbers.to_numpy(np.int64))
            yield pd.DataFrame({"sequence": found[0], "offset": found[1]})

    own = Window.partitionBy("length", "slot").orderBy("at")
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = numbered.where(fits).withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "slot"])
    names = [F.col(f"row.`{c}`").alias(c) for c in pieces.columns]
    done = ranked.select("row", placed("length", F.col("before") + F.col("own")).alias("p")).select(
        *names, F.col("p.sequence").alias(sequence), F.col("p.offset").alias(offset))
    rest = stored.where(~F.coalesce(fits, F.lit(False))).select(
        *names, F.lit(None).cast("long").alias(sequence), F.lit(None).cast("long").alias(offset))
    return done.unionAll(rest)
