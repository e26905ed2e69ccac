"""What filters remove in every order, with copies found in tries over ranges of texts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.session import materialize, small_batches

#: Bytes of text that a trie holds before it is emptied, unless asked for otherwise.
TRIE_BYTES = 1 << 24
#: Bytes of text for which there is a range, and ranges at most; beyond that ranges grow, which a task reads in order.
RANGE_BYTES, MOST_RANGES = 1 << 25, 4096
#: Texts, and bytes of each, from which the ends of ranges are chosen. They deal work out and decide no result.
SAMPLE, SAMPLE_BYTES = 16384, 1024
#: Filters at most: all their orders are reported.
MOST_FILTERS = 6
#: Rows by range that are still open (with their text), or decided (without).
ROWS = "range int, salt int, text binary, id long, part string, mask int, times long"
_SCHEMA = pa.schema([
    ("range", pa.int32()), ("salt", pa.int32()), ("text", pa.binary()), ("id", pa.int64()),
    ("part", pa.string()), ("mask", pa.int32()), ("times", pa.int64()),
])


def common(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` and ``text`` from ``at`` on begin with alike."""
    size = min(len(label), len(text) - at)
    apart = np.frombuffer(label, np.uint8, size) != np.frombuffer(text, np.uint8, size, at)
    first = int(apart.argmax())
    return first if apart[first] else size


class Node:
    """An edge of the trie and what lies below; a text that ends here has its smallest id and the rows of that id."""

    __slots__ = ("label", "children", "least", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.rows = label, {}, None, None


class Trie:
    """A compressed trie of whole texts. Of each it holds the rows with the smallest id; others are copies at once."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def find(self, text: bytes) -> Node:
        """The node where ``text`` ends; made if it isn't there, which may split an edge."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is not None and text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            if child is not None:
                shared = common(child.label, text, at)
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                node, at = upper, at + shared
            if at < len(text):
                leaf = node.children[text[at]] = Node(text[at:])
                self.size += len(leaf.label)
                return leaf
        return node

    def insert(self, text: bytes, row_id: int, rest: tuple, times: int = 1) -> list[tuple]:
        """Adds ``times`` rows (id, rest); returns the rows that this shows to be copies: (id, rest, times)."""
        node, copies = self.find(text), []
        if node.least is not None and row_id > node.least:
            return [(row_id, rest, times)]
        if node.least is None or row_id < node.least:
            if node.rows:
                copies = [(node.least, r, n) for r, n in node.rows.items()]
            node.least, node.rows = row_id, {}
        node.rows[rest] = node.rows.get(rest, 0) + times
        self.size += 256 * (len(node.rows) == 1)
        return copies

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple, int]]:
        """All texts with the rows of their smallest id: (text, id, rest, times)."""
        path = [(self.root, b"")]
        while path:
            node, before = path.pop()
            text = before + node.label
            for rest, times in (node.rows or {}).items():
                yield text, node.least, rest, times
            path.extend((child, text) for child in node.children.values())


class Ranges:
    """Ranges of texts by the prefixes that begin them, each as short as tells it from the texts before.

    A prefix that fills several ranges on its own begins one, whose texts are first
    dealt to as many salts.
    """

    def __init__(self, texts: list[tuple[bytes, int]], ranges: int):
        """``texts``: some texts' beginnings and their weights."""
        ordered = sorted(texts)
        ends = np.cumsum([w for _, w in ordered], dtype=float)
        wanted = ends[-1] * np.arange(1, ranges) / ranges if len(ends) else []
        self.prefixes: list[bytes] = []
        self.salts = [1]
        last = None
        for at in np.searchsorted(ends, wanted):
            text = ordered[at][0]
            if text == last:
                self.salts[-1] += 1
                continue
            first = bisect_right(ordered, (text,)) - 1
            before = ordered[first][0] if first >= 0 else b""
            last, prefix = text, text[: common(before, text, 0) + 1] if before and text else text
            if self.prefixes and prefix <= self.prefixes[-1]:
                continue
            self.prefixes.append(prefix)
            self.salts.append(1)

    def of(self, text: bytes) -> int:
        return bisect_right(self.prefixes, text)


def choose_ranges(rows: DataFrame) -> Ranges:
    n = rows.count()
    some = rows.where("text is not null").sample(min(1.0, SAMPLE / max(1, n)), 0)
    some = some.select(F.substring("text", 1, SAMPLE_BYTES).alias("text"), F.octet_length("text").alias("size")).limit(2 * SAMPLE)
    texts = [(bytes(r["text"]), r["size"] + 1) for r in some.collect()]
    size = sum(w for _, w in texts) / max(1, len(texts)) * n
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Ranges(texts, max(parts, min(MOST_RANGES, int(size / RANGE_BYTES) + 1)))


class Sender:
    """Gathers rows into batches of bounded size."""

    def __init__(self, most_rows: int = 8192, most_bytes: int = 1 << 22):
        self.most_rows, self.most_bytes, self.rows, self.size = most_rows, most_bytes, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += len(row[2] or b"")
        if len(self.rows) >= self.most_rows or self.size >= self.most_bytes:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(_SCHEMA)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
        self.rows, self.size = [], 0
        return out


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def flag_copies(rows: DataFrame, bit: int, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Adds ``bit`` to the mask of every row whose text another row of a smaller ``id`` has: id, part, mask, times.

    ``rows`` has ``id``, ``part``, ``mask`` and ``text`` (binary). Equal rows may be counted
    together in ``times``. A row without id is no copy and makes none.

    Every task first fills a trie with its own texts: rows that it shows to be copies
    are decided there, so that of a group of copies one row and one text a trie go on
    (one for each kind of row, if rows repeat an id). Those are dealt by range of
    text, and a trie over the range decides. Within a range texts come in order, so a
    trie can be emptied between two texts and a range of any size fits.
    """
    rows = rows.select("id", "part", "mask", "text")
    ranges = choose_ranges(rows)
    with small_batches(rows.sparkSession):
        first = materialize(_decide(rows.mapInArrow(_gather(ranges, bit, trie_bytes), ROWS), ranges.salts, bit, trie_bytes))
        decided = first.where("text is null")
        if max(ranges.salts) > 1:
            # What the salts of a range left open.
            last = materialize(_decide(first.where("text is not null"), None, bit, trie_bytes))
            decided = decided.unionByName(last)
    return decided.select("id", "part", "mask", "times")


def _gather(ranges: Ranges, bit: int, trie_bytes: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, sent = Trie(), Sender(), 0

        def decided(copies):
            nonlocal sent
            for row_id, (part, mask), times in copies:
                sent += 1
                # No range: dealt anywhere.
                yield from out.add(-1, sent % 4096, None, row_id, part, mask, times)

        def emptied():
            nonlocal trie
            # One salt for a trie; its size is as good a draw as any.
            salt = trie.size * 0x9E3779B97F4A7C15 >> 32 & 0xFFFF
            for text, row_id, (part, mask), times in trie:
                place = ranges.of(text)
                yield from out.add(place, salt % ranges.salts[place], text, row_id, part, mask, times)
            trie = Trie()

        for batch in batches:
            for row_id, part, mask, text in _columns(batch):
                if row_id is None:
                    yield from decided([(None, (part, mask), 1)])
                    continue
                copies = trie.insert(text, row_id, (part, mask))
                yield from decided((i, (p, m | bit), n) for i, (p, m), n in copies)
                if trie.size >= trie_bytes:
                    yield from emptied()
        yield from emptied()
        yield out.batch()

    return gather


def _decide(rows: DataFrame, salts: list[int] | None, bit: int, trie_bytes: int) -> DataFrame:
    """Merges what tasks sent to a range; rows keep their text where the range has salts and remain open."""
    key = ["range"] if salts is None else ["range", "salt"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, place, last = Trie(), Sender(), None, None

        def decided(copies):
            for row_id, (part, mask), times in copies:
                yield from out.add(None, None, None, row_id, part, mask | bit, times)

        def emptied():
            nonlocal trie
            still = place is not None and salts is not None and salts[place[0]] > 1
            for text, row_id, (part, mask), times in trie:
                yield from out.add(place[0] if still else None, None, text if still else None, row_id, part, mask, times)
            trie = Trie()

        for batch in batches:
            for in_range, salt, text, row_id, part, mask, times in _columns(batch):
                if text is None:
                    yield from out.add(None, None, None, row_id, part, mask, times)
                    continue
                here = (in_range, salt) if salts is not None else (in_range,)
                if here != place or trie.size >= trie_bytes and text != last:
                    yield from emptied()
                    place = here
                yield from decided(trie.insert(text, row_id, (part, mask), times))
                last = text
        yield from emptied()
        yield out.batch()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts is not None:
        parts = max(parts, len(salts))
    return rows.repartition(parts, *key).sortWithinPartitions(*key, "text").mapInArrow(merge, ROWS)


def masks(
    docs: DataFrame,
    filters: dict[str, Column],
    copies: str,
    part: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``id``, ``part``, ``mask`` and ``times``: which filters documents fail, a bit for each letter in order.

    ``filters`` says when a row fails; null is not failing. ``copies`` is the letter of the
    filter that fails a text which a smaller key has. Null texts are empty, a null part too.
    """
    letters = sorted({*filters, copies})
    mask = F.lit(0)
    for name, fails in filters.items():
        mask = mask + F.when(F.coalesce(fails, F.lit(False)), 1 << letters.index(name)).otherwise(0)
    rows = docs.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.cast("int").alias("mask"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return flag_copies(rows, 1 << letters.index(copies), trie_bytes)


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column],
    copies: str = "E",
    part: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """For every part, order of the filters and step: what the step's filter keeps, removes and shares with others.

    ``filters`` maps a letter to the condition under which a row of ``docs`` fails; the
    filter ``copies`` fails rows whose whole text a row of a smaller ``key`` has anywhere,
    removed or not. Every order of the letters is applied left to right. Columns: ``part``,
    ``filter_order``, ``step``, and counts of documents: ``kept`` after the step, ``removed`` in it,
    ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing its filter
    alone), ``good_lost`` and ``toxic_lost`` (removed here, with that label), ``shapley``
    (removed by its filter, over all orders).

    ``labels`` has ``key``, ``good`` and ``toxic``; several rows of a key are one, true if any is.
    Rows of ``docs`` with a null key have no label, are no copies and make none. A
    null text is empty, a null part the empty string. Repeated rows count each. An empty
    table gives no rows. Other columns play no part and may have any name.

    A document is reduced to its mask as soon as its copies are known; masks are
    counted by part and label, at most 4 * 2 ** filters numbers a part, and all
    orders are read off those.
    """
    letters = sorted({*filters, copies})
    if len(letters) > MOST_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"filters must have one letter and be {MOST_FILTERS} at most")
    found = masks(docs, filters, copies, part, key, text, trie_bytes)
    known = (
        labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"))
        .agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    )
    # Null ids, however many, don't meet in one task.
    none = [F.lit(False).alias(c) for c in ("good", "toxic")]
    unnamed = found.where("id is null").select("part", "mask", "times", *none)
    named = found.where("id is not null").join(known, "id", "left")
    named = named.select("part", "mask", "times", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    counts = named.unionByName(unnamed).groupBy("part", "mask", "good", "toxic").agg(F.sum("times").alias("n"))
    # Few rows a part, whatever the number of documents.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("kinds"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bits = F.create_map(*[F.lit(x) for i, name in enumerate(letters) for x in (name, 1 << i)])
    steps = materialize(parts).select("part", "kinds", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    steps = steps.select(
        "*", letter.alias("letter"), bits[letter].alias("bit"),
        F.aggregate(earlier, F.lit(0), lambda seen, name: seen + bits[name]).alias("before"),
    )

    def total(of) -> Column:
        return F.aggregate("kinds", F.lit(0).cast("long"), lambda n, kind: n + F.when(of(kind), kind["n"]).otherwise(0))

    def fails(kind) -> Column:
        return kind["mask"].bitwiseAND(F.col("bit")) != 0

    def fresh(kind) -> Column:
        return kind["mask"].bitwiseAND(F.col("before")) == 0

    return steps.select(
        "part", "filter_order", "step", "letter",
        total(lambda k: ~fails(k) & fresh(k)).alias("kept"),
        total(lambda k: fails(k) & fresh(k)).alias("removed"),
        total(lambda k: fails(k) & ~fresh(k)).alias("redundant"),
        total(lambda k: k["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda k: fails(k) & fresh(k) & k["good"]).alias("good_lost"),
        total(lambda k: fails(k) & fresh(k) & k["toxic"]).alias("toxic_lost"),
    ).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
