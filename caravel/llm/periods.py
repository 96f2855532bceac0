"""Periodic runs of words, found online by catching squares with completed blocks of powers of two.

Words are appended one at a time. Whenever an aligned block of 2**k words is complete it becomes a catcher for
the periods p from 2**(k+1) - 1 to 2**(k+2) - 2: any stretch of period p that holds a square holds such a block in its
first half. A catcher lives from the place where its block could end again at the smallest of these periods to the
largest; it waits for the last word of its block, so an appended word wakes only catchers that wait for it. Where
the suffix of the text equals the block (compared by a running hash, then word by word), the comparison is carried
on to the left at once, less than a block because an earlier catcher saw what lies further left, and to the right by every further
word. A comparison as long as its period is a square; when it breaks, the squares it went through have merged into one run.
A period that is a multiple of the period of a comparison that covers it adds nothing and is not followed.

A run is a stretch with smallest period p, no neighbouring word extending it, of at least ``repeats`` periods
and ``least`` words. Each word costs two catchers on average, whatever the length of the text; a text of any length is read in
pieces and kept as word numbers. Words are what stands between ASCII white space. A null, empty or
blank text has no words and no runs. Repeated rows are searched one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from caravel.llm.frames import pick, slices

REPEATS, LEAST = 4, 6
BASE, MODULUS = 1_000_003, (1 << 61) - 1
PIECE_BYTES = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"


class Catchers:
    """The words appended so far, the catchers that wait, and the comparisons that are still equal."""

    def __init__(self, repeats: int = REPEATS, least: int = LEAST):
        self.repeats, self.least = repeats, least
        self.words, self.sums, self.powers = array("I"), array("Q", [0]), [BASE]
        self.waiting: dict[int, list[tuple[int, int]]] = {}  # last word of a block: (level, last place)
        self.equal: dict[int, int] = {}  # period: first place whose word equals the one a period before
        self.found: dict[tuple[int, int], int] = {}  # (start, length): smallest period

    def append_all(self, words: list[int]) -> None:
        mine, sums, equal = self.words, self.sums, self.equal
        at, total = len(mine), sums[-1]
        for word in words:
            mine.append(word)
            total = (total * BASE + word + 1) % MODULUS
            sums.append(total)
            if equal:
                for period in [p for p in equal if mine[at - p] != word]:
                    self.close(period, at)
            if at > 1:  # blocks of one word, for the periods 1 and 2
                if mine[at - 1] == word and 1 not in equal:
                    self.catch(0, at - 1, at)
                if mine[at - 2] == word and 2 not in equal:
                    self.catch(0, at - 2, at)
                if not at & 1:
                    self.turn(at)
            elif at and mine[0] == word:
                self.catch(0, 0, at)
            for level, last in self.waiting.get(word, ()):
                if at - last not in equal:
                    self.catch(level, last, at)
            at += 1

    def turn(self, at: int) -> None:
        """Let the catchers of two words and more in and out whose time begins or ends with the word at this place."""
        level, due = 1, at + 2
        while True:
            size = 1 << level
            last = at - 2 * size + 1
            if due & (size - 1) or last < size - 1:
                return
            self.waiting.setdefault(self.words[last], []).append((level, last))
            gone = last - 2 * size
            if gone >= size - 1:
                word = self.words[gone]
                left = self.waiting[word]
                left.remove((level, gone))
                if not left:
                    del self.waiting[word]
            level += 1

    def covered(self, start: int, period: int) -> bool:
        """Whether a comparison that goes on explains equality at this period from the start on."""
        return any(period % smaller == 0 and first - smaller <= start for smaller, first in self.equal.items())

    def catch(self, level: int, last: int, at: int) -> None:
        """Compare the suffix with a block, and start a comparison that its equality leads to."""
        size, period, words = 1 << level, at - last, self.words
        start = last - size + 1
        if len(self.equal) < 4 and self.covered(start, period):  # the cheaper test first
            return
        if level:
            if words[at - 1] != words[last - 1]:
                return
            while len(self.powers) <= level:
                self.powers.append(self.powers[-1] * self.powers[-1] % MODULUS)
            power, sums = self.powers[level], self.sums
            if (sums[at + 1] - sums[at + 1 - size] * power - sums[last + 1] + sums[last + 1 - size] * power) % MODULUS:
                return
        if self.covered(start, period):
            return
        first = at - size + 1
        if words[start : last + 1] != words[first : at + 1]:
            return
        while first > period and words[first - 1] == words[first - 1 - period]:
            first -= 1
        self.equal[period] = first

    def close(self, period: int, at: int) -> None:
        """The word at this place breaks a comparison: what it went through is a run if long enough."""
        start = self.equal.pop(period) - period
        length = at - start
        if length >= max(self.least, self.repeats * period):
            self.found[start, length] = min(period, self.found.get((start, length), period))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs when no word follows, by start, then period."""
        for period in list(self.equal):
            self.close(period, len(self.words))
        return sorted(((start, length, period) for (start, length), period in self.found.items()), key=lambda r: (r[0], r[2]))


def read_words(text: str | None, seen: dict[bytes, int]) -> Iterator[list[int]]:
    """The words of a text as numbers in order of first appearance, about a megabyte at a time."""
    data, start = (text or "").encode(), 0
    while start < len(data):
        end = min(start + PIECE_BYTES, len(data))
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield [seen.setdefault(w, len(seen)) for w in data[start:end].split()]
        start = end


def periodic_runs(text: str | None, repeats: int = REPEATS, least: int = LEAST) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, the runs, and the words outside repeats: what any run holds after its first period is dropped."""
    seen: dict[bytes, int] = {}
    catchers = Catchers(repeats, least)
    for words in read_words(text, seen):
        catchers.append_all(words)
    runs, n = catchers.runs(), len(catchers.words)
    kept = bytearray(b"\x01") * n
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    names = list(seen)
    return n, runs, b" ".join(names[w] for w, keep in zip(catchers.words, kept) if keep).decode()


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """One row per input row: key, n_words, runs (structs of start, length, period, in order) and collapsed (kept words, one space between)."""
    if repeats < 2:
        raise ValueError("a run is at least a square: repeats must be 2 or more")
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = [periodic_runs(t.as_py(), repeats, least) for t in part.column(1)]
            told = [[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs, _ in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(told, run_type), pa.array([f[2] for f in found], pa.string())],
                names=["key", "n_words", "runs", "collapsed"],
            )

    out = f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)
