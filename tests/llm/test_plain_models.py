"""The registered queries of language identification and of the language model against plain loops over small tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
import zstandard

from tamiz.llm.queries import QUERIES

WORDS = {
    "de": "der die und nicht ein schön über Haus Straße wir gehen heute morgen".split(),
    "en": "the of and is not house street we walk today with Tomorrow that".split(),
    "fr": "le la et pas maison été nous marchons aujourd'hui demain avec une".split(),
}


def written(spark, folder, rows: list[tuple]) -> str:
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def remainder(doc_id: int | None, of: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % of


def test_language_query_equals_plain_loops(spark, tmp_path):
    chance = random.Random(5)
    rows = []
    for i in range(330):
        lang = ("de", "en", "fr")[i % 3]
        rows.append((i, " ".join(chance.choices(WORDS[lang], k=chance.randrange(1, 60))), lang))
    rows += [
        (400, None, "de"), (401, "", "en"), (402, "12 !? 345", "fr"), (403, "xq", None), (404, "der the", "en"),
        (405, "nicht house demain " * 2000, None), (None, "the house is not of that", "en"), (406, "wir we nous", "de"),
    ]
    rows += [rows[0], rows[1]]
    found = QUERIES["op1_compression_language"](spark, written(spark, tmp_path, rows)).collect()

    def plain(text: str) -> bytes:
        return f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode()

    dictionaries = {}
    for lang in WORDS:
        held = [
            (xxhash.xxh64_intdigest("" if i is None else str(i), 42), text)
            for i, text, of in rows
            if of == lang and remainder(i, 4) != 2 and text and any(c.isalpha() for c in text)
        ]
        # Spark's hash is signed, and that of null the seed.
        held = [(42 if text == rows[336][1] else h - 2**64 if h >= 2**63 else h, text) for h, text in held]
        dictionaries[lang] = b"".join(plain(text) for _, text in sorted(held)[:64])
        assert len(held) > 64 and len(dictionaries[lang]) < 1 << 16

    def size(lang: str, data: bytes) -> int:
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=9)
        made = zstandard.ZstdCompressor(
            level=9, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return len(made.compress(data))

    want, seen = Counter(), Counter()
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            name, score, rejected = "und", 0.0, True
        else:
            data, sizes = plain(text), []
            for lang in dictionaries:
                third = len(dictionaries[lang]) // 3
                lead = dictionaries[lang][third : third + 64]
                pieces = [data[at : at + 2048] for at in range(0, len(data), 2048)]
                sizes.append((sum(size(lang, lead + p) - size(lang, lead) for p in pieces), lang))
            (best, name), (second, _) = sorted(sizes)[:2]
            margin = (second - best) / max(1, second)
            score, rejected = max(0.0, min(1.0, 16 * margin)), margin < 0.002
            seen[rejected] += 1
        want[i, remainder(i, 4) == 2, name, round(score, 9), rejected] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.rejected) for r in found) == want
    # The margin rule is met both ways.
    assert seen[True] and seen[False]


def test_model_query_equals_plain_loops(spark, tmp_path):
    chance = random.Random(7)
    texts = [" ".join(chance.choices(WORDS["en"] + WORDS["de"], k=chance.randrange(1, 40))) for _ in range(30)]
    texts += [None, "", "Z", "the the the " * 40, texts[0], "1234567890" * 12]
    rows = [(i, text, "en") for i, text in enumerate(texts)] + [(None, "the house of", "en")]
    found = QUERIES["op7_context_mixing"](spark, written(spark, tmp_path, rows)).collect()

    orders, start = (1, 2, 3, 4, 6), (0.2, 0.2, 0.25, 0.3, 0.4)
    lines = [(i, remainder(i, 7) == 2, b"\xff" * 6 + (text or "").encode().lower() + b"\xff") for i, text, _ in rows]
    bits = Counter()
    for _, held_out, line in lines:
        for at in range(6, len(line)):
            for place in () if held_out else range(8):
                for order in orders:
                    bits[line[at - order : at], 1 << place | line[at] >> (8 - place), order, line[at] >> (7 - place) & 1] += 1

    def score(line: bytes) -> float:
        weights = defaultdict(lambda: list(start))
        refined = {(place, cell): 1 / (1 + math.exp(8 - cell / 2)) for place in range(8) for cell in range(33)}
        total = 0.0
        for at in range(6, len(line)):
            byte = line[at]
            for place in range(8):
                node, bit = 1 << place | byte >> (8 - place), byte >> (7 - place) & 1
                odds = []
                for order in orders:
                    context = line[at - order : at]
                    one, zero = bits[context, node, order, 1], bits[context, node, order, 0]
                    odds.append(round(4096 * math.log((one + 0.4) / (zero + 0.4))) / 4096)
                half = line[at - 1] >> 4 if place < 4 else byte >> 4
                weight = weights[place, half]
                mix = max(-7.99, min(7.99, sum(w * o for w, o in zip(weight, odds))))
                first, cell = 1 / (1 + math.exp(-mix)), int((mix + 8.25) * 2)
                second = refined[place, cell]
                mean = (first + second) / 2
                total += math.log10(mean if bit else 1 - mean)
                refined[place, cell] += 0.02 * (bit - second)
                weights[place, half] = [w + 0.02 * o * (bit - first) for w, o in zip(weight, odds)]
        return total

    want = {(i, held_out): score(line) for i, held_out, line in lines}
    assert {(r.doc_id, r.held_out): r.score for r in found} == pytest.approx(want, rel=1e-4)
    assert len(found) == len(rows) and len({held_out for _, held_out, _ in lines}) == 2
