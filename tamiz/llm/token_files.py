"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id
and a bit that says whether the id goes on; level 1 the next chunk of those that do,
and so on. A rank directory, the number of set bits before every 512th, leads from
a place in one level to its place in the next, so any token is found by a rank on
each level and no block is decoded. A run of tokens is a run of bytes on each level.

A file: the magic, then little-endian 64-bit numbers: levels; for each level its
entries and the starts of its chunks, its bitmap and its directory; then the parts.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tamiz.llm.files import create, open_random
from tamiz.session import materialize, scratch

MAGIC = b"DACIDS01"
BLOCK = 512
INDEX = "doc_id long, file string, at long, n_tokens long"
READ = "doc_id long, file string, at long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray) -> bytes:
    """The file of a row of ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ends = np.arange(0, len(rest) + 1, BLOCK)
        counts = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])
        levels.append(((rest & 255).astype(np.uint8), bits, counts[ends].astype("<i8"), len(rest)))
        if not more.any():
            break
        rest = rest[more] >> 8
    at = len(MAGIC) + 8 + 32 * len(levels)
    head, body = [struct.pack("<q", len(levels))], []
    for chunks, bits, ranks, entries in levels:
        parts = [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
        places = [at, at + len(parts[0]), at + len(parts[0]) + len(parts[1])]
        head.append(struct.pack("<4q", entries, *places))
        body += parts
        at += sum(map(len, parts))
    return MAGIC + b"".join(head) + b"".join(body)


class TokenFile:
    """Reads runs of tokens from a file without decoding what lies before them."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(len(MAGIC) + 8, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (levels,) = struct.unpack("<q", head[len(MAGIC) :])
        table = file.read_at(32 * levels, len(head))
        self.levels = list(struct.iter_unpack("<4q", table))

    def __len__(self) -> int:
        return self.levels[0][0]

    def _bits(self, level: int, start: int, end: int) -> np.ndarray:
        first = start // 8
        data = self.file.read_at((end + 7) // 8 - first, self.levels[level][2] + first)
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        return bits[start - 8 * first : end - 8 * first].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        """Set bits of a level before ``at``: a directory entry and the bits after it."""
        block = at // BLOCK
        before = int.from_bytes(self.file.read_at(8, self.levels[level][3] + 8 * block), "little")
        return before + int(self._bits(level, block * BLOCK, at).sum()) if at % BLOCK else before

    def read(self, start: int, count: int) -> np.ndarray:
        """Tokens ``start`` to ``start + count``."""
        if start < 0 or start + count > len(self):
            raise IndexError(f"tokens {start} to {start + count} of {len(self)}")
        ids = np.zeros(count, np.uint32)
        who, level = np.arange(count), 0
        while len(who):
            data = self.file.read_at(len(who), self.levels[level][1] + start)
            ids[who] |= np.frombuffer(data, np.uint8).astype(np.uint32) << np.uint32(8 * level)
            more = self._bits(level, start, start + len(who))
            start, who, level = self._rank(level, start), who[more], level + 1
        return ids

    def token(self, at: int) -> int:
        return int(self.read(at, 1)[0])


#: White space that sets no words apart on its own.
PAIRS = ("  ", " \n", "\n ", "\n\n")
WHITE = [c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n"]


#: Longer words are not kept.
KEPT_CHARS = 64


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` named by ``index``, one after another, and where each ends."""
    sizes = size[index]
    stop = np.cumsum(sizes)
    return flat[np.repeat(start[index] - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)], stop


class Encoder:
    """Ids of whole texts under a byte-level tokenizer, each distinct word of a call encoded once, kept ones not at all.

    A text is cut before a single space or line feed between two other characters.
    The tokenizer's own first cut is there too, a space going with what follows it and
    a line feed standing alone, so the words can be encoded apart and the ids are those
    of the whole text. Between Latin letters and marks at a word's end it cuts as well,
    which makes fewer words. The words of many texts are cut and numbered as one Arrow
    array, the distinct ones encoded many in a row, told apart by the ids that begin
    with a space or line feed, and all ids gathered by number.

    The ids of the first ``keep`` words of at most ``KEPT_CHARS`` characters are kept from
    call to call, since common words come in every call; ``forget`` makes room for others.
    """

    cut = re.compile(r"(?<=\S)(?=[ \n]\S)").split
    #: Latin letters with marks after them, between which the tokenizer cuts.
    ended = "^(?P<body>\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<marks>[!-/:-@\\[-`{-~]+)$"

    def __init__(self, path: str, at_once: int = 1 << 12, keep: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer, self.at_once, self.keep = Tokenizer.from_file(path), at_once, keep
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True

    def forget(self) -> None:
        """Drops the words kept."""
        self.known: dict[str, int] = {}
        self.known_ids, self.known_size = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.known) >= self.keep

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _apart(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of words, in pieces, and how many each has; a word follows a space unless a line feed begins it."""
        flat, sizes = [], []
        for first in range(0, len(words), self.at_once):
            some = [w if w[0] == "\n" else " " + w for w in words[first : first + self.at_once]]
            row = "".join(some)
            ids = self._ids(row)
            starts = np.flatnonzero(self.begins[ids])
            # Other white space within a word begins ids too: then each goes alone.
            if len(starts) != len(some) or len(row) - sum(map(len, row.split())) != len(some):
                parts = list(map(self._ids, some))
                flat += parts
                sizes.append(np.array([len(p) for p in parts], np.int64))
            else:
                flat.append(ids)
                sizes.append(np.diff(starts, append=len(ids)))
        return flat, sizes

    def _units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words among others, where each word's start, and how many it has; some of the new ones are kept."""
        place = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(place < 0)
        fresh = [words[at] for at in new]
        flat, sizes = self._apart(fresh)
        held = len(self.known_size)
        place[new] = held + np.arange(len(new))
        ids = np.concatenate([self.known_ids, *flat])
        size = np.concatenate([self.known_size, *sizes])
        start = np.cumsum(size) - size
        kept = [at for at, w in enumerate(fresh) if len(w) <= KEPT_CHARS][: max(0, self.keep - held)]
        if kept:
            self.known.update((fresh[at], held + n) for n, at in enumerate(kept))
            more, _ = gather(ids, start, size, held + np.array(kept))
            self.known_ids = np.concatenate([self.known_ids, more])
            self.known_size = np.concatenate([self.known_size, size[held:][kept]])
        return ids, start[place], size[place]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and where each starts and how many it has."""
        split = pc.extract_regex(words, self.ended)
        two = split.is_valid().to_numpy(zero_copy_only=False)
        units = pc.if_else(split.is_valid(), pc.struct_field(split, "body"), words).dictionary_encode()
        marks = pc.struct_field(split, "marks").drop_null().dictionary_encode()
        ids, begin, size = self._units(units.dictionary.to_pylist())
        ends = [self._ids(m) for m in marks.dictionary.to_pylist()]
        pieces = np.concatenate([ids, *ends])
        length = np.array([len(e) for e in ends], np.int64)
        begin = np.concatenate([begin, len(ids) + np.cumsum(length) - length])
        size = np.concatenate([size, length])
        # A word is a unit, or a unit and its marks.
        at = np.arange(len(words)) + np.cumsum(two) - two
        row = np.empty(len(words) + two.sum(), np.int64)
        row[at] = units.indices.to_numpy()
        row[at[two] + 1] = len(units.dictionary) + marks.indices.to_numpy()
        whole, stop = gather(pieces, begin, size, row)
        last = stop[at + two]
        start = np.concatenate([[0], last[:-1]]) if len(last) else last
        return whole, start, last - start

    def _joined(self, words: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of words in a row, cut at ``ends``; the first of each part is the line feed put before it."""
        coded = words.dictionary_encode()
        row, stop = gather(*self._words(coded.dictionary), coded.indices.to_numpy())
        cuts = np.concatenate([[0], stop])[ends]
        return [row[a + 1 : b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, other = [], []
        for at, text in enumerate(texts):
            if not text or text[0].isspace():
                out[at] = self._ids(text)
            elif text[-1] in " \n" or any(pair in text for pair in PAIRS) or any(c in text for c in WHITE):
                other.append(at)
            else:
                plain.append(at)
        kind = pa.large_string()
        if plain:
            # A word after a space is written without it, one after a line feed, and the first, with it.
            broken = pc.replace_substring(pa.array([texts[at] for at in plain], kind), "\n", " \n")
            lines = pc.binary_join_element_wise(pa.scalar("\n", kind), broken, pa.scalar("", kind))
            words = pc.split_pattern(lines, " ")
            for at, ids in zip(plain, self._joined(words.flatten(), words.offsets.to_numpy())):
                out[at] = ids
        if other:
            split = [self.cut("\n" + texts[at]) for at in other]
            words = pa.array([part.removeprefix(" ") for parts in split for part in parts], kind)
            for at, ids in zip(other, self._joined(words, np.cumsum([0, *map(len, split)]))):
                out[at] = ids
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
    return Encoder(path)


def write_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    file_tokens: int = 1 << 21,
    batch_chars: int = 1 << 23,
) -> DataFrame:
    """Encode ``text`` of ``docs`` in ascending ``doc_id`` order; returns the stored index.

    Documents are dealt by ranges of ``doc_id``, sorted, encoded and written, with
    ``end_id`` after each, into files of about ``file_tokens`` tokens. A task's files
    have fresh names and the index, committed by Spark, names those that counted.
    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer)
        if words.full():
            words.forget()  # what an earlier task kept may be of another kind
        held, rows, at = [], [], 0

        def finish():
            nonlocal held, rows, at
            name = f"{folder}/{uuid.uuid4().hex}.dac"
            with create(name) as out:
                out.write(encode(np.concatenate(held)))
            index = _index([(doc, name, start, n) for doc, start, n in rows], INDEX)
            held, rows, at = [], [], 0
            return index

        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            first = 0
            while first < len(texts):
                chars, last = 0, first
                while last < len(texts) and (last == first or chars + len(texts[last]) <= batch_chars):
                    chars += len(texts[last])
                    last += 1
                for key, ids in zip(keys[first:last], words.encode(texts[first:last])):
                    ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                    rows.append((key, at, len(ids)))
                    held.append(ids)
                    at += len(ids)
                    if at >= file_tokens:
                        yield finish()
                first = last
        if rows:
            yield finish()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id")
    return materialize(dealt.sortWithinPartitions("doc_id", "text").mapInPandas(write, INDEX))


def _index(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[n for n, _ in fields])
    return frame.astype({n: "Int64" for n, kind in fields if kind == "long"})


def read_files(index: DataFrame) -> DataFrame:
    """Read every document's ids back: ``start`` over all files, ``n_tokens`` and CRC-32.

    Files follow each other by the smallest ``doc_id`` they hold; what lies before a
    file comes from a table with one row for each file. A file is the unit of
    reading, a document of access.
    """
    files = index.groupBy("file").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.sum("n_tokens").alias("tokens")
    )
    earlier = Window.partitionBy().orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        files.select("file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, some in batch.groupby("file"):
                with open_random(name) as opened:
                    file = TokenFile(opened)
                    rows = []
                    for row in some.itertuples(index=False):
                        ids = file.read(int(row.at), int(row.n_tokens))
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((row.doc_id, name, row.at, row.n_tokens, crc))
                yield _index(rows, READ)

    read_back = index.mapInPandas(read, READ)
    return read_back.join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file", "at"
    )


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write token files of ``docs`` (``doc_id``, ``text``) and read them back.

    A null text is empty and has the end id alone. A null ``doc_id`` comes before all
    others, repeated ids keep a row each, by text; other columns play no part. An
    empty table makes no file.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, tokenizer, end_id))
