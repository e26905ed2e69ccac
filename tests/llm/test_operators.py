"""Each operator against a brute-force version, with nulls, empties, ties and clashing columns."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tamiz.llm import (
    context_mixing, decontamination, language, mixing, sharding, simhash, token_files, topk, url_rules, warc,
)
from tamiz.llm.queries import QUERIES, byte_tokenizer

WORDS = "the of and tion erst hand sch ung keit que les dans para los con uno".split()


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i % 40 if i % 3 else i, 5 + i % 60), ["en", "de", None][i % 3], f"src{i % 4}") for i in range(160)]
    rows += [(900, None, "en", None), (901, "", None, "src0"), (902, "  \n", "en", "src1"), (903, "one", "en", "solo")]
    rows += [(904, "12 34 !!", "de", "src0"), (905, prose(5, 9000), "en", "src0"), (906, "a  b\tc", "en", "src0")]
    rows += [(3, prose(3, 8), "en", "src3"), (3, prose(3, 8), "en", "src3"), (None, prose(7, 30), "en", "src0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.selectExpr("*", "'x' AS score", "1 AS shard", "'y' AS passages", "0 AS code", "'z' AS rate")


def empty(df):
    return df.where("false")


def test_shards(docs):
    placed = sharding.interleave(docs.select("doc_id", "source", "shard"), 8).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    sizes = Counter(r.shard for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(n))
    for source, n in Counter(r.source for r in placed).items():
        got = Counter(r.shard for r in placed if r.source == source)
        assert all(abs(got[s] - n / 8) <= 2 for s in range(8))
    assert sharding.interleave(empty(docs.select("doc_id", "source")), 8).collect() == []


def test_url_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/es/deep/"), ("allow", "net", "/es/deep/"), ("block", "b", "")]
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "a.net", "b", "c.b", "org", ""]
    paths = ["", "/", "/en/", "/en", "/en/x", "/es/y", "/es/deep/z", "/fr/é", "/es/deep"]
    urls = [f"http://{h.upper()}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#://")]
    urls += [None, "", "no scheme", "://", "x://a://b/en/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v == "block", v) for v, h, p in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2], best[4] if best else "allow"

    judged = url_rules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: want(u) for i, u in enumerate(urls * 2)}
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_rules.judge(pages, none).collect()} == {"allow"}
    assert url_rules.judge(empty(pages), none).collect() == []


def test_warc(spark):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "http://a/\r\nX: y", big), (5, None, big), (5, "u", big), (2, "u", other), (3, "u", other), (4, "u", None),
            (6, "u", ""), (None, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (8, "u", "z" * 700_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    read = warc.archive(pages.drop("payload")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in read) == sorted([
        ("1", "revisit", "5"), ("5", "response", "None"), ("5", "response", "None"), ("None", "revisit", "5"),
        *[(str(i), "response", "None") for i in (2, 3, 4, 6, 7, 8)]])
    import hashlib

    texts = dict((r[0], r[2] or "") for r in rows)
    for r in read:
        body = texts[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    # One frame is enough for one record.
    index = warc.write_bundles(warc.assign_revisits(pages), warc.scratch(spark, "b")).collect()
    for i in index:
        fields, payload = warc.fetch(i.bundle, i.frame, i.start, i.size)
        assert fields["WARC-Record-ID"] == f"<{i.record_id}>"
        assert fields["WARC-Type"] == "revisit" or payload == texts[i.page_id].encode()
    assert warc.archive(empty(pages)).collect() == []


def test_language(spark, docs):
    fitted = language.fit(docs)
    assert set(fitted) == {"en", "de"}
    rows = language.identify(docs, fitted).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.fit(empty(docs)) == {}
    german, english = "der und die nicht ein schön ist " * 300, "the and of that is not a with " * 300
    told = language.Classifier({"de": german.encode(), "en": english.encode()})
    assert told.predict("Das ist nicht der schön und die")[0] == "de"
    assert told.predict("THAT is not the, and of a!")[0] == "en"
    assert told.predict("zzz")[3]


def test_language_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(documents.where("doc_id % 4 = 0"), language.fit(documents.where("doc_id % 4 <> 0"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_simhash_index():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 400):
        near = rng.integers(0, 2**63, 3, dtype=np.uint64)
        some = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in near for i, j in rng.integers(0, 64, (n, 2))]
        codes = np.unique(np.array(some + [0, 3, 2**64 - 1], np.uint64))
        for distance in (0, 1, 2):
            got = set(zip(*map(list, simhash.GrayIndex(codes).search(codes, distance))))
            apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
            assert got == set(zip(*map(list, np.where(apart <= distance))))


@pytest.mark.parametrize("most", [simhash.CELL, 3])
def test_simhash_components(spark, docs, monkeypatch, most):
    plain = simhash.cells
    monkeypatch.setattr(simhash, "cells", lambda codes, distance: plain(codes, distance, most))
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def code(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    codes = [code(t) for _, t in rows]
    root = {c: c for c in codes}
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                low, high = sorted((root[a], root[b]))
                root = {c: low if r == high else r for c, r in root.items()}
    least = {}
    for (i, _), c in zip(rows, codes):
        if i is not None:
            least[root[c]] = min(i, least.get(root[c], i))
    want = Counter((i, f"{c:016x}", least.get(root[c])) for (i, _), c in zip(rows, codes))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(root.values())) and kept[0].asDict().keys() == set(docs.columns)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert simhash.near_duplicates(empty(docs)).collect() == []


def test_passages(spark, docs):
    item = "An unlikely sequence of quite particular words, which nobody would write twice by any chance at all."
    near = item.upper().replace("QUITE", "RATHER").replace("BY ANY", "by")
    far = " ".join(item.split()[:9])
    rows = [(1, f"{prose(1, 50)} {item} {prose(2, 50)}"), (2, f"x\n{near} y"), (3, far), (4, None), (5, ""), (6, item), (6, item)]
    texts = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, distance int")
    items = spark.createDataFrame([(7, item), (8, "too short here"), (9, None), (10, ""), (None, item)], "item_id long, text string")
    found = decontamination.contaminated(texts, items, block_bytes=20).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(1, 7, 0), (2, 7, 2), (6, 7, 0), (6, 7, 0)]
    assert found[0].end_word - found[0].start_word == len(decontamination.words_of(item))
    assert decontamination.contaminated(texts, empty(items)).collect() == []
    assert decontamination.find_passages(docs, items).columns[-1] == "passages"


def test_short_and_unspaced_items(spark):
    rows = [
        (1, "He said to BE, or not: twice."), (2, "be or nothing"), (3, "前面的话今天天气很好我们去公园玩吧后面的话"),
        (4, "前面的话今天天气不好我们去公园玩吧"), (5, "今天 天气"), (6, "カタカナ・テスト語"), (7, None), (8, ""), (9, "x " * 50_000 + "to be or not"),
        (10, "การทดสอบ mixed 語 text"),
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "to be or not"), (2, "be or not"), (3, "今天天气很好我们去公园玩吧"), (4, "天气"), (5, "?!"), (6, "mixed 語"), (6, "mixed 語"), (7, "天气")]
    found = contaminated_rows(texts, spark.createDataFrame(items, "item_id long, text string"))
    assert found == [
        (1, 1, 0), (1, 2, 0), (3, 3, 0), (3, 4, 0), (3, 7, 0), (4, 3, 1), (4, 4, 0), (4, 7, 0),
        (5, 4, 0), (5, 7, 0), (9, 1, 0), (9, 2, 0), (10, 6, 0),
    ]
    assert found == contaminated_rows(texts, spark.createDataFrame(items, "item_id long, text string"), block_bytes=6)


def contaminated_rows(texts, items, **options):
    return sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.contaminated(texts, items, **options).collect())


def test_decontamination_query_equals_every_pair(spark):
    """The registered query against the distance of every item to every document, without pieces."""
    folder = "/root/testdata/sf0.01"
    found = {tuple(r)[:3] + (r.end_word,) for r in QUERIES["op6_edit_decontamination"](spark, folder).collect()}
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    patterns = [(r.item_id, decontamination.Pattern(decontamination.words_of(r.text))) for r in items]
    expected = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words = decontamination.words_of(r.text or "")
        for item, pattern in patterns:
            distance, end = pattern.best(words)
            if distance <= int(0.15 * pattern.length):
                expected.add((r.doc_id, item, distance, end))
    assert found == expected and len(found) > 20


def test_myers():
    r = random.Random(3)
    for _ in range(500):
        pattern = r.choices("abc", k=r.randint(1, 12))
        text = r.choices("abc", k=r.randint(0, 20))
        row = [0] * (len(text) + 1)
        for i, a in enumerate(pattern, 1):
            above, row = row, [i]
            for j, b in enumerate(text, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        assert decontamination.Pattern(pattern).best(text) == (min(row), row.index(min(row)))


def test_rates_match_targets(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        p = [0.9, 0.06, 0.04]
        k = r.choices(range(3), [6, 3, 1])[0]
        p[0], p[k] = p[k], p[0]
        rows.append((i, r.randint(0, 200), p))
    scored = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    for weights, most in (([0.2, 0.5, 0.3], None), ([0.6, 0.3, 0.1], 1.0)):
        rates = mixing.fit_rates(scored, weights, total=0.8, most=most, rounds=100)
        out = scored.withColumn("rate", rates.column()).collect()
        tokens = sum(x.tokens for x in out)
        assert all(x.rate >= 0 and (most is None or x.rate <= most) for x in out)
        reached = [sum(x.tokens * x.rate * x.posterior[j] for x in out) / tokens for j in range(3)]
        assert reached == pytest.approx([0.8 * w for w in weights], abs=0.01)
    assert mixing.fit_rates(empty(scored), [1.0, 0.0, 0.0]).steps == []


def test_mixture(spark, docs):
    labels = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(160)] + [(None, "a"), (5, "c")], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labels, ["a", "b", "unseen"])
    rows = mixing.mix(docs, model, [0.5, 0.5, 0.0]).collect()
    assert len(rows) == docs.count()
    assert all(len(r.posterior) == 3 and abs(sum(r.posterior) - 1) < 1e-6 and 0 <= r.copies <= 1 for r in rows)
    assert mixing.mix(empty(docs), model, [0.5, 0.5, 0.0]).collect() == []
    assert mixing.fit_domains(docs, empty(labels), ["a", "b"]).stages is None


@pytest.mark.parametrize("n", [0, 1, 9, 300])
def test_topk(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(n)]
    rows += [(100, None), (101, [1.0, None] * 4), (102, [float("nan")] * 8), (103, []), (None, [0.5] * 8)] if n else []
    rows += [(1000 + i, rows[0][1]) for i in range(n and 30)] + rows[:1]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(frame, 1024)
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in dict((i, v) for i, v in usable if i is not None and i % 100 == 0).items():
        scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i) for i, b in usable if i != q]
        want += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda t: (t[0], t[1], t[2] or 0))[:10], 1)]
    got = topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10, block_rows=64, query_rows=2).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_token_codes(tmp_path):
    rng = np.random.default_rng(2)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1, 0, 7], rng.integers(0, 60000, 3000)):
        path = str(tmp_path / f"{len(ids)}.dac")
        with open(path, "wb") as out:
            out.write(token_files.encode(np.array(ids, np.uint32)))
        with token_files.open_random(path) as opened:
            file = token_files.TokenFile(opened)
            assert len(file) == len(ids)
            assert file.read(0, len(ids)).tolist() == [int(x) for x in ids]
            for at in range(0, len(ids), 37):
                assert file.token(at) == ids[at]
                assert file.read(at, min(5, len(ids) - at)).tolist() == [int(x) for x in ids[at : at + 5]]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_tokenizer())
    read = sorted(token_files.round_trip(docs, byte_tokenizer()).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for got, row in zip(read, rows, strict=True):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        assert (got.doc_id, got.start, got.n_tokens) == (row.doc_id, at, len(ids))
        assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.round_trip(empty(docs), byte_tokenizer()).collect() == []


@pytest.mark.parametrize("at_once", [5, 1 << 12])
def test_parts_encode_as_the_whole(at_once):
    from tokenizers import Tokenizer

    texts = ["", " ", "a  b", " lead", "tail ", "x ,y. z,.", "it's it's, don't.", "<|endoftext|> x", "ab cd   ef", "a\n b \n\nc",
             "a\x1c b", "1,000. 2.", "é, ü.", "a b", "\u00d7, a\u00d7! x_! don't' 5! z[]\\^ don't!!", "ñ***\nñ*** ñ", prose(1, 300)]
    whole = [e.ids for e in Tokenizer.from_file(byte_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    encoder = token_files.Encoder(byte_tokenizer(), at_once)
    assert [[x.tolist() for x in encoder.encode(texts)] for _ in range(2)] == [whole] * 2


@pytest.mark.parametrize("keep", [0, 3, 1 << 10])
def test_kept_words_are_not_encoded_again(keep):
    texts = ["uno dos, tres cuatro", "dos\ntres cinco seis uno", "uno  dos\tuno", "x" * 90 + " uno", "", "tres (seis) ocho uno"]
    encoder, sent = token_files.Encoder(byte_tokenizer(), keep=keep), []
    ids = encoder._ids
    whole = [ids(t).tolist() for t in texts]
    encoder._ids = lambda text: (sent.append(text), ids(text))[1]
    for _ in range(2):
        assert [encoder.encode([t])[0].tolist() for t in texts] == whole
    assert len(encoder.known) <= keep
    del sent[:]
    encoder.encode(["uno cuatro tres", "uno cinco"])
    assert (sent == []) == (keep == 1 << 10)
    encoder.forget()
    encoder.encode(["uno cuatro"])
    assert sent[-1].split() == ["uno", "cuatro"]


def test_base_scores(spark, docs):
    from pyspark.sql import functions as F

    rows = context_mixing.score_texts(docs, F.col("doc_id") % 7 != 2).collect()
    training = Counter()
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id % 7 != 2:
            training.update([*(r.text or "").encode().lower().split(), b"\n"])
    n, v = sum(training.values()), len(training)
    want = Counter()
    for r in docs.collect():
        words = [*(r.text or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((training[w] + 1) / (n + v + 1)) for w in words)
        want[r.doc_id, len(words), sum(training[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert context_mixing.score_texts(empty(docs), F.lit(True)).collect() == []


def test_model_is_a_probability():
    """One bit after another, by plain arithmetic: the chances of both values add up to 1."""
    counter = context_mixing.Counter()
    counter.add([b"abracadabra"] * 20)
    assert counter.counts.sum() == 20 * 12 * 8 * len(context_mixing.ORDERS)
    mixer = context_mixing.Mixer(context_mixing.odds(counter.counts))
    known, other = mixer.score([b"abracadabra", b"xylophonist"])
    assert known > other
    every = 10.0 ** mixer.score([bytes([b]) for b in range(255)])
    assert every.sum() < 1
    alone, beside = mixer.score([b"cab" * 999]), mixer.score([b"cab" * 999, b"a" * 5000, b""])
    assert beside[0] == pytest.approx(alone[0], rel=1e-6)


def test_model_beats_base_on_held_out_text(spark):
    from pyspark.sql import functions as F

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = context_mixing.score_texts(documents, F.col("doc_id") % 7 != 2).collect()
    held = [r for r in rows if not r.learned]
    texts = {r.doc_id: r.text for r in documents.collect()}
    bits = -sum(r.score for r in held) / math.log10(2) / sum(len((texts[r.doc_id] or "").encode()) + 1 for r in held)
    assert bits < 2.6


def test_contexts_are_counted_exactly():
    """Against a dictionary of contexts, and of the bits that followed."""
    texts = [prose(i, 30 + i).encode() for i in range(40)]
    want = Counter()
    for text in texts:
        line = b"\xff" * 6 + text + b"\xff"
        want.update((n, line[i - n : i], line[i]) for n in context_mixing.ORDERS for i in range(6, len(line)))
    counter = context_mixing.Counter()
    for text in texts:
        counter.add([text])
    keys = [(n, context, byte) for n, context, byte in want]
    coded = [n << 56 | int.from_bytes(context, "big") << 8 | byte for n, context, byte in keys]
    assert dict(zip(counter.counts.keys.tolist(), counter.counts.times.tolist())) == dict(zip(coded, map(want.get, keys)))
    assert 3 in context_mixing.ORDERS

    following = Counter()
    for (n, context, byte), times in want.items():
        for place in range(8):
            following[n, context, 1 << place | byte >> (8 - place), byte >> (7 - place) & 1] += times
    found = context_mixing.odds(counter.counts)(context_mixing.np.array(coded, "u8"))
    for (n, context, byte), row in zip(keys, found.tolist()):
        for place, got in enumerate(row):
            node = 1 << place | byte >> (8 - place)
            odds = math.log((following[n, context, node, 1] + 0.4) / (following[n, context, node, 0] + 0.4))
            assert abs(got / context_mixing.UNIT - max(-8, min(8, odds))) < 1e-3


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_contexts_are_found_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(context_mixing, "PIECE", piece)
    texts = [b"", b"abcabcabc", "ñandú".encode(), b"abc" * 40, b"x"]
    found = context_mixing.Laid(texts).distinct()
    want, lines = Counter(), [b"\xff" * 6 + t + b"\xff" for t in texts]
    for n, row in zip(context_mixing.ORDERS, found.within):
        keys = iter(found.keys[row[found.places]].tolist())
        for line in lines:
            for i in range(6, len(line)):
                key = int.from_bytes(line[i - n : i + 1], "big") | n << 56
                assert next(keys) == key
                want[key] += 1
    assert dict(zip(found.keys.tolist(), found.times().tolist())) == want


def test_what_tasks_have_left_shares_chunks(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([10, 5_000, 20_000, 70_000] * 4)], "doc_id long, text string")
    packed = context_mixing.pack_chunks(docs.repartition(8), "doc_id", F.lit(True), F.col("text")).collect()
    assert len(packed) == 1 and sorted(packed[0]["keys"]) == list(range(16))
    # Full chunks hold texts of like length, and none is larger than it may be.
    small = context_mixing.pack_chunks(docs, "doc_id", F.lit(True), F.col("text"), chunk_bytes=40_000).collect()
    assert sorted(k for row in small for k in row["keys"]) == list(range(16))
    assert all(row["size"] <= 40_000 or len(row["keys"]) == 1 for row in small)


def test_shuffled_contexts_are_gone_when_scored(spark, docs):
    from pyspark.sql import functions as F

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle")}

    packed = context_mixing.pack_chunks(docs, "doc_id", F.lit(True), F.col("text"))
    before = shuffled()
    scored = context_mixing.score_chunks(packed, 16)
    # Executors are told to delete them and not waited for.
    for _ in range(100):
        if shuffled() - before:
            time.sleep(0.1)
    assert not shuffled() - before
    assert scored.agg(F.sum(F.size("keys"))).first()[0] == docs.count()


def test_long_rows_come_in_small_batches(spark):
    from pyspark.sql import functions as F

    from tamiz.session import small_batches

    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = lambda batches: (b.iloc[:1].assign(text=str(len(b))) for b in batches)
    with small_batches(spark, "1m"):
        assert max(int(r.text) for r in rows.mapInPandas(sizes, "text string").collect()) < 200


def test_every_training_row_is_counted(spark):
    """Over many chunks and buckets, as one Counter over all rows has it; none is kept for the weights."""
    texts = [prose(i, 30 + i).encode() for i in range(40)]
    counter = context_mixing.Counter()
    counter.add(texts)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = context_mixing.score_texts(docs, docs.doc_id >= 0, bucket_bytes=100).collect()
    alone = context_mixing.Mixer(context_mixing.odds(counter.counts)).score(texts)
    assert {r.doc_id: r.score for r in rows} == pytest.approx(dict(enumerate(alone)), rel=1e-5)


def test_a_text_learns_to_its_end():
    """What a text repeats costs ever less: weights and refinement don't start again on the way."""
    counter = context_mixing.Counter()
    counter.add([b"else", b"eel"])
    mixer = context_mixing.Mixer(context_mixing.odds(counter.counts))
    short, long = mixer.score([b"e" * 1023, b"e" * 16367])
    assert long > 8 * short


def test_scarce_domain_reaches_its_target(spark, tmp_path):
    from tamiz.llm.queries import QUERIES

    kinds = ["poor" if i % 50 == 0 else "toxic" if i % 100 == 1 else "clean" for i in range(1000)]
    rows = [(i, " ".join([k] * 20 + [f"w{i % 7}"])) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(k == "clean"), int(k == "toxic")) for i, k in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = QUERIES["op5_soft_mixture"](spark, str(tmp_path)).collect()
    clean, poor = (sum(r.tokens * r.rate * r[f"p_{d}"] for r in out) for d in ("clean", "poor"))
    assert poor / (clean + poor) == pytest.approx(0.1, abs=0.01)


def test_missed_targets_are_told(spark):
    scored = spark.createDataFrame([(10, [0.98, 0.02])] * 9 + [(10, [0.1, 0.9])], "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="targets missed"):
        rates = mixing.fit_rates(scored, [0.5, 0.5], most=1.0)
    assert not rates.met and rates.nearest and rates.reached[1] < rates.wanted[1]
    assert mixing.fit_rates(scored, [0.5, 0.5], most=None).met
