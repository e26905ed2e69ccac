"""Benchmark passages in documents: exact pieces find them, Myers' distance verifies."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow.parquet
from pyspark.sql import DataFrame, functions as F

from tamiz.llm.files import listed, open_random
from tamiz.session import scratch

# Scripts written without spaces (Thai and Lao, Burmese, Khmer, kana, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
#: Bytes of items in one file of the stored benchmark.
FILE_BYTES = 1 << 26
#: Bytes of texts that wait for all blocks of items, where there is more than one.
HELD_BYTES = 1 << 25
FOUND = "array<struct<item_id: bigint, distance: int, start_word: int, end_word: int>>"


def words_of(text: str) -> list[str]:
    """Words without case and marks; white space and punctuation don't count as edits.

    In scripts written without spaces every letter is a word.
    """
    return WORD.findall(text.casefold())


def budget(words: int, rate: float) -> int:
    """Edited words allowed in a passage of so many words."""
    return int(words * rate)


def pieces(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """``errors`` + 1 runs of words, with their starts: that many edits leave one of them whole."""
    cuts = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A row of words, compared by Myers' bit-parallel edit distance."""

    def __init__(self, words: list[str]):
        self.length = len(words)
        self.full = (1 << self.length) - 1
        self.last = 1 << (self.length - 1)
        self.places: dict[str, int] = defaultdict(int)
        for i, word in enumerate(words):
            self.places[word] |= 1 << i

    def best(self, text: list[str]) -> tuple[int, int]:
        """Least distance to any run of words that ``text`` holds, and where such a run first ends."""
        plus, minus, score = self.full, 0, self.length
        least, end = score, 0
        get = self.places.get
        for at, word in enumerate(text, 1):
            equal = get(word, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(horizontal | plus) & self.full
            down = plus & horizontal
            if up & self.last:
                score += 1
            if down & self.last:
                score -= 1
            # A run may begin anywhere: nothing is shifted in below.
            up = up << 1 & self.full
            down = down << 1 & self.full
            plus = down | ~(vertical | up) & self.full
            minus = up & vertical
            if score < least:
                least, end = score, at
        return least, end


class Matcher:
    """Finds which items a text holds with at most their budget of edited words."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_words: int = 1):
        self.patterns: list[Pattern] = []
        self.errors: list[int] = []
        self.ids: list[list[int]] = []
        same: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) >= max(1, least_words):
                same[tuple(words)].append(item_id)
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (words, ids) in enumerate(same.items()):
            errors = budget(len(words), rate)
            self.ids.append(ids)
            self.patterns.append(Pattern(list(words)))
            self.errors.append(errors)
            for start, piece in pieces(list(words), errors):
                owners[f" {' '.join(piece)} "].append((at, start))
        self.search = ahocorasick.Automaton()
        for piece, users in owners.items():
            self.search.add_word(piece, (len(piece), users))
        if owners:
            self.search.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, word after the last) for each item found, the nearest place of each."""
        if not self.ids or not text:
            return []
        words = words_of(text)
        line = f" {' '.join(words)} "
        starts = None
        seen: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int, int]] = {}
        for end, (length, users) in self.search.iter(line):
            if starts is None:
                starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
            at = int(np.searchsorted(starts, end - length + 2))
            for item, offset in users:
                first = at - offset
                pattern, errors = self.patterns[item], self.errors[item]
                if not errors:
                    # Its only piece is the item itself, and the first place is the answer.
                    best.setdefault(item, (0, first + pattern.length, first))
                    continue
                if (item, first) in seen:
                    continue
                seen.add((item, first))
                low = max(0, first - errors)
                distance, stop = pattern.best(words[low : first + pattern.length + errors])
                if distance <= errors and (item not in best or (distance, low + stop) < best[item][:2]):
                    best[item] = (distance, low + stop, max(low, low + stop - pattern.length))
        return sorted((i, d, start, stop) for at, (d, stop, start) in best.items() for i in self.ids[at])


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    rate: float = 0.15,
    least_words: int = 1,
    block_bytes: int = 1 << 22,
) -> DataFrame:
    """Adds ``passages``: the benchmark items that each row's whole text holds.

    An item of m words is found where at most int(m * ``rate``) words are inserted,
    left out or replaced; a short one, whose budget is nothing, where it stands
    unchanged. It is cut into one piece more than the budget, so one piece is there
    unchanged; all pieces are looked for in one pass over the text, and each place that
    a piece points to is verified by the edit distance of the whole item. ``distance``
    is the least found, ``start_word`` and ``end_word`` where it is (the start as if no
    word were inserted or missing). Words are runs of letters, digits and underscores;
    in scripts written without spaces every letter is a word.

    Items of fewer than ``least_words`` words are not searched; null items and items
    without a word neither. Items of the same text are found under each id, an item
    that is there twice once. A null or empty text holds nothing; repeated rows keep a
    row each; a column ``passages`` is replaced. Tables may be empty.

    The items are stored in the shared folder and read by the tasks in blocks of about
    ``block_bytes``; neither the driver nor the plan holds them. A task keeps the only
    block, or lets ``HELD_BYTES`` of texts wait while it takes block after block, so its
    memory does not grow with the benchmark.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = scratch(docs.sparkSession, "items")
    items.distinct().coalesce(size // FILE_BYTES + 1).write.parquet(path)
    found = _search(path, rate, least_words, block_bytes)(F.col(text))
    kept = docs.drop("passages")
    return kept.select("*", found.alias("passages"))


def _blocks(path: str, rate: float, least_words: int, block_bytes: int) -> Iterator[Matcher]:
    """Matchers of the stored items, each of about ``block_bytes`` of text."""
    held, size = [], 0
    for name in listed(path, ".parquet"):
        with open_random(name) as file:
            for batch in pyarrow.parquet.ParquetFile(file).iter_batches(1024, columns=["item_id", "text"]):
                for item in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                    held.append(item)
                    size += len(item[1])
                    if size >= block_bytes:
                        yield Matcher(held, rate, least_words)
                        held, size = [], 0
    if held:
        yield Matcher(held, rate, least_words)


def _search(path: str, rate: float, least_words: int, block_bytes: int):
    names = ("item_id", "distance", "start_word", "end_word")

    def blocks() -> Iterator[Matcher]:
        return _blocks(path, rate, least_words, block_bytes)

    def answers(hits: list[list[tuple]]) -> pd.Series:
        return pd.Series([[dict(zip(names, hit)) for hit in row] for row in hits], dtype=object)

    def through(held: list[pd.Series]) -> Iterator[pd.Series]:
        hits = [[[] for _ in batch] for batch in held]
        for matcher in blocks():
            for batch, rows in zip(held, hits):
                for row, some in zip(rows, batch):
                    row += matcher.find(some)
        return map(answers, hits)

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first = list(islice(blocks(), 2))
        if len(first) < 2:
            for batch in batches:
                yield answers([first[0].find(t) if first else [] for t in batch])
            return
        del first
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(len(t) for t in batch if t)
            if size >= HELD_BYTES:
                yield from through(held)
                held, size = [], 0
        yield from through(held)

    return search


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """A row for each document and item it holds: ``key``, ``item_id``, ``distance``, ``start_word``, ``end_word``."""
    found = find_passages(docs.select(key, "text"), items, **options)
    return found.select(key, F.explode("passages").alias("hit")).select(key, "hit.*")
