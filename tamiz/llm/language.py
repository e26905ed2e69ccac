"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Languages that can be told apart at most; their dictionaries are held by every task.
MOST_LANGUAGES = 512
#: All dictionaries together.
MOST_BYTES = 32 << 20

WORD = re.compile(r"[^\W\d_]+")
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    texts: int = 64,
    dictionary_bytes: int = 1 << 16,
) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows.

    The fit is on a bounded sample: for each language the ``texts`` rows whose key
    has the smallest hash, of each at most ``dictionary_bytes`` characters, cut to
    ``dictionary_bytes`` in all. Only those rows leave their tasks. Rows without
    language, text or letters are left out; without any row left there are no
    dictionaries. More than ``MOST_LANGUAGES`` languages are an error.
    """
    rows = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(
        F.col(lang).alias("lang"),
        F.xxhash64(F.col(key).cast("string")).alias("place"),
        F.substring(F.col(text), 1, dictionary_bytes).alias("text"),
    )
    first = Window.partitionBy("lang").orderBy("place", "text")
    sample = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= texts)
    languages = labelled.where(F.col(lang).isNotNull()).select(lang).distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    limit = min(dictionary_bytes, MOST_BYTES // max(languages, 1))
    joined: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "n").toLocalIterator():
        parts = joined.setdefault(row["lang"], [])
        if sum(map(len, parts)) < limit:
            parts.append(letters(row["text"]).encode())
    return {k: b"".join(v)[:limit] for k, v in joined.items()}


def letters(text: str) -> str:
    """The words of a text in lower case, a space around each: marks and digits tell no language."""
    return " " + " ".join(WORD.findall(text.lower())) + " "


class Classifier:
    """Chooses the language whose dictionary leaves a text smallest.

    A text is compressed in pieces of ``piece`` bytes: in a long frame the text
    itself would soon be the better dictionary. Each piece follows ``lead`` bytes of the
    dictionary, whose own size is taken off, so that a few words aren't lost in a
    frame's fixed cost. ``score`` is what the best dictionary
    saves against the next one in sixteenths of the smaller size, at most 1.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int = 9, piece: int = 2048, least_margin: float = 0.002, lead: int = 64):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.names = sorted(dictionaries)
        self.piece, self.least_margin = piece, least_margin
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=content, **plain)
            third = len(dictionaries[name]) // 3
            before = dictionaries[name][third : third + lead]
            self.compressors.append((compressor.compress, before, len(compressor.compress(before))))

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode()
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        return [sum(len(compress(before + p)) - taken for p in pieces) for compress, before, taken in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        ranked = sorted(zip(self.sizes(text), self.names))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, 1.0, False
        (best, name), (second, _) = ranked[:2]
        margin = (second - best) / max(1, second)
        return name, max(0.0, min(1.0, 16 * margin)), margin, margin < self.least_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", **options) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` to every row.

    Only the text is read, whole. A null text or one without a letter is ``und``,
    scored 0 and rejected; a margin below ``least_margin`` is rejected as well but
    keeps its language. Equal sizes go to the first language by name, with margin 0.
    Without dictionaries everything is ``und``. Result columns replace columns of
    the same name.
    """

    @F.pandas_udf(RESULT)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries, **options)
        for batch in batches:
            yield pd.DataFrame(
                [classifier.predict(t) for t in batch], columns=["lang_pred", "score", "margin", "rejected"]
            )

    names = ["lang_pred", "score", "margin", "rejected"]
    kept = docs.drop(*names, "_language")
    return kept.withColumn("_language", classify(F.col(text).cast("string"))).select(
        *kept.columns, *[F.col(f"_language.{n}").alias(n) for n in names]
    )
