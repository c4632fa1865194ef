"""Passages of held-out evaluation items inside a corpus, found with one Aho-Corasick automaton.

A word is a maximal run of letters and digits, compared case-folded; whatever stands between words is ignored.
A document leaks an item when it holds at least ``min_words`` consecutive words of it, in order.

Any ``min_words`` consecutive words of an item contain one of its aligned blocks of ``min_words // 2`` words
whole, so the automaton holds just these blocks: as many characters as the items themselves. One scan of the
normalised document yields the blocks in it; each is extended to both sides, word by word, against the item,
and the run is reported if it is long enough, with its offsets in the original text.

A block that many items hold is looked up with its neighbouring words: of the ``min_words`` words, half of those
outside the block or more stand on one side of it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut

_WORD = r"[\p{L}\p{N}]+"
_SCHEMA = "item_id long, doc_id long, n_words int, start long, end long"


def normalise(text: str) -> tuple[list[str], str]:
    """The words of a text, case-folded, and the same joined by single spaces, with a space at both ends."""
    import regex

    joined = " ".join(regex.findall(_WORD, text)).casefold()
    return (joined.split(" ") if joined else []), f" {joined} "


class Leaks:
    """The automaton over the aligned blocks of ``items`` (pairs of id and text)."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, many: int = 16) -> None:
        import ahocorasick

        block = max(1, min_words // 2)
        self.min_words, self.side = min_words, -(-(min_words - block) // 2)
        self.items = [(item_id, normalise(text)[0]) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(self.items):
            if len(words) >= min_words:
                for at in range(0, len(words) - block + 1, block):
                    places[f" {' '.join(words[at : at + block])} "].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for pattern, where in places.items():
            self.automaton.add_word(pattern, (len(pattern), block, where if len(where) <= many else self._by_neighbours(where, block)))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def _by_neighbours(self, where: list[tuple[int, int]], block: int) -> dict[tuple, list[tuple[int, int]]]:
        """The places of a block by the words before (``0, ...``) and after it (``1, ...``)."""
        by = defaultdict(list)
        for k, at in where:
            words = self.items[k][1]
            if at >= self.side:
                by[0, *words[at - self.side : at]].append((k, at))
            if at + block + self.side <= len(words):
                by[1, *words[at + block : at + block + self.side]].append((k, at))
        return dict(by)

    def _candidates(self, where, words: list[str], n: int, block: int) -> list[tuple[int, int]]:
        """The places that a block at word ``n`` of a text may belong to."""
        if isinstance(where, list):
            return where
        left = where.get((0, *words[n - self.side : n]), []) if n >= self.side else []
        right = where.get((1, *words[n + block : n + block + self.side]), [])
        return left + right

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, words, start, end) of every maximal run of at least ``min_words`` words, per item and alignment."""
        if self.empty:
            return
        words, joined = normalise(text)
        done: dict[tuple[int, int], int] = {}
        spans, counted, n = None, 0, -1
        for end, (length, block, where) in self.automaton.iter(joined):
            start = end - length + 1
            # Starts need not grow: a longer block can end later. Count from the last place, either way.
            n += joined.count(" ", counted, start + 1) if start + 1 >= counted else -joined.count(" ", start + 1, counted)
            counted = start + 1
            for k, at in self._candidates(where, words, n, block):
                item_id, item = self.items[k]
                if done.get((k, n - at), -1) > n:
                    continue
                left = right = 0
                while left < min(at, n) and item[at - left - 1] == words[n - left - 1]:
                    left += 1
                while right < min(len(item) - at, len(words) - n) and item[at + right] == words[n + right]:
                    right += 1
                done[k, n - at] = n + right
                if left + right >= self.min_words:
                    if spans is None:
                        import regex

                        spans = [m.span() for m in regex.finditer(_WORD, text)]
                    yield item_id, left + right, spans[n - left][0], spans[n + right - 1][1]


#: The automaton that this worker process made last, with the name of the call it belongs to.
_LAST: dict[str, Leaks] = {}


def _made_once(name: str, items: list[tuple[int, str]], min_words: int) -> Leaks:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Leaks(items, min_words)
    return _LAST[name]


def _passages(leaks: Leaks, batch: pd.DataFrame) -> pd.DataFrame:
    rows = [
        (item_id, doc_id, n, start, end)
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"])
        for item_id, n, start, end in leaks.find(text)
    ]
    return pd.DataFrame(rows, columns=["item_id", "doc_id", "n_words", "start", "end"])


def eval_leaks(
    corpus: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 12,
    automaton_chars: int = 4_000_000,
    held_chars: int = 32_000_000,
) -> DataFrame:
    """The leaked passages: ``item_id, doc_id, n_words, start, end`` (offsets in characters of the document's text).

    The corpus is scanned once, whole, without a shuffle; only passages leave the scan. A worker process makes the
    automaton once. Items of more than ``automaton_chars`` characters are broadcast in parts of about that many, so that
    the memory of driver and tasks is bounded: a task then holds ``held_chars`` characters of texts and takes them through
    the parts' automata one after the other, still in the one scan. Null ids and texts hold nothing; items of fewer than
    ``min_words`` words cannot leak; repeated rows give repeated passages only once. Empty tables give an empty result.
    """
    spark = corpus.sparkSession
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).dropna().distinct()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // automaton_chars))
    if parts > 1:
        tests = cut(tests)
    docs = corpus.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    shared = []
    for part in range(parts):
        # The driver holds one part at a time; broadcasts are files.
        mine = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        shared.append(spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.sort("item_id", "text").toLocalIterator()]))
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def through() -> Iterator[pd.DataFrame]:
            for k, part in enumerate(shared):
                leaks = _made_once(f"{name}{k}", part.value, min_words)
                if parts > 1:
                    del part._value
                yield from (_passages(leaks, batch) for batch in held)
            held.clear()

        for batch in batches:
            held.append(batch)
            size += int(batch["text"].str.len().sum())
            if parts == 1 or size > held_chars:
                yield from through()
                size = 0
        yield from through() if held else ()

    return docs.mapInPandas(scan, _SCHEMA).distinct()
