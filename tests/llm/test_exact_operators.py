"""Digest merge, bit planes and filter audit against brute force, with nulls, empties, ties and clashing columns."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.llm import bitplanes, digest_merge, filter_audit

LONG = "a long text that goes on " * 20_000


@pytest.fixture(scope="module")
def rows():
    """A third of the rows have one text; copies of other sizes, near copies, prefixes, nulls, repeated and null keys."""
    r = random.Random(7)
    out = [(i, "hot copy", "en") for i in range(0, 300, 3)]
    out += [(1000 + i, f"text {i % 37}" + "x" * (i % 3), r.choice(["de", "en", None, ""])) for i in range(150)]
    out += [(2000 + i, "shared beginning " * 70 + str(i % 20), "de") for i in range(50)]
    out += [(3000, None, "en"), (3001, "", None), (3002, LONG, "de"), (3003, LONG, "de"), (3004, LONG + "!", "de")]
    out += [(None, "hot copy", "en"), (None, "only without key", "fr"), (None, "only without key", "fr"), (None, None, None)]
    out += [(3, "hot copy", "en"), (0, "hot copy", "en"), (0, "hot copy", "en"), (4000, "é", "fr"), (4001, "é", "fr"), (4002, "\x00", "fr"), (4003, "\x00\x00", "fr")]
    out += [(-5, "text 3", "de"), (5000, "LOUD & clear words, LOUD", "en"), (5001, " \t\n", "en")]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    return frame.selectExpr("*", "'x' AS row", "1 AS run", "2 AS part", "'y' AS mask", "false AS kept", "0 AS id")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("run", [digest_merge.RUN, 3])
def test_copies_are_marked(docs, rows, keep, run):
    """Also with runs of 8 rows, which takes several rounds."""
    best = max if keep == "largest" else min
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text or "", []).append(i)
    want = Counter()
    for i, text, _ in rows:
        named = [x for x in groups[text or ""] if x is not None]
        keep_id = best(named) if named else None
        want[i, keep_id, len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = digest_merge.mark_copies(docs, keep=keep, run=run).collect()
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    stay = [g for g in got if g.kept]
    assert Counter(g.text_sha256 for g in stay) == Counter({g.text_sha256 for g in got})
    assert all(g.doc_id == g.keep_id for g in stay)


def test_copies_of_a_normal_form(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "key long, body string")
    got = digest_merge.mark_copies(docs, key="key", text=F.lower("body")).collect()
    assert sorted((g.key, g.keep_id, g.kept) for g in got) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert digest_merge.mark_copies(docs.where("false"), "key", "body").collect() == []
    with pytest.raises(ValueError):
        digest_merge.mark_copies(docs, "key", "body", keep="any")


def test_records_are_verified():
    """The same digest with another length or second hash is another record."""
    run = np.zeros(4, digest_merge.RECORD)
    run["record"] = [b"d" * 32 + x * 16 for x in (b"1", b"2", b"1", b"1")]
    run["named"], run["id"], run["row"], run["count"] = [True, True, False, True], [5, 4, 9, 5], [8, 7, 6, 3], 1
    found = digest_merge.merged([run[:2], run[2:]], largest=True)
    assert found["count"].tolist() == [3, 1] and found["id"].tolist() == [5, 4] and found["row"].tolist() == [3, 7]


def test_planes_are_exact():
    rng = np.random.default_rng(4)
    for low, high in ((0, 1), (-1, 0), (-256, 255), (-(2**26), 2**26), (7, 7)):
        a, b = rng.integers(low, high + 1, (9, 64)), rng.integers(-3, 200, (5, 64))
        packed = bitplanes.planes(a, bitplanes.bits_for(a.min(), a.max()))
        assert (bitplanes.unpacked(packed) == a).all()
        assert (bitplanes.dots(packed, bitplanes.planes(b, bitplanes.bits_for(b.min(), b.max()))) == a @ b.T).all()


@pytest.mark.parametrize("n", [0, 1, 3, 200])
def test_clusters(spark, n):
    rng = np.random.default_rng(n)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.4, 64)]) for i in range(n)]
    vectors += vectors[:1] * n + [(None, [0.25] * 64)] * bool(n)
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64),
           (905, [float("-inf")] * 64), (906, [1e30] * 64), (907, [])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    frame = frame.selectExpr("*", "1 AS cluster", "'x' AS planes").repartition(5)
    got = bitplanes.cluster(bitplanes.integer_vectors(frame, 256), k=6, rounds=3, seed=2).collect()

    held = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    place = {i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest() for i, _ in held}
    centroids = [v for _, v in sorted(held, key=lambda x: (place[x[0]], x[1]))[:6]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(3):
        found = [(nearest(v)[1], v) for _, v in held]
        for j in {j for j, _ in found}:
            some = [v for x, v in found if x == j]
            centroids[j] = [sum(c) // len(some) for c in zip(*some)]
    near = [(i, *nearest(v)) for i, v in held]
    inertia = Counter()
    for _, d, j in near:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = Counter((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, d, j in near)
    assert Counter((g.vec_id, g.cluster, g.distance, g.cluster_inertia, g.inertia, g.centroid_sha256) for g in got) == want


def test_trie_holds_what_a_dictionary_holds():
    r = random.Random(2)
    trie, least, copies = filter_audit.Trie(), {}, Counter()
    rows = [("".join(r.choices("ab", k=r.randint(0, 6))).encode(), r.randint(0, 9), r.choice("xy")) for _ in range(400)]
    for text, i, rest in rows:
        copies.update({(j, x): n for j, x, n in trie.insert(text, i, rest)})
        least[text] = min(i, least.get(text, i))
    kept = Counter((text, i, rest) for text, i, rest in rows if i == least[text])
    assert Counter({(text, i, rest): n for text, i, rest, n in trie}) == kept
    assert copies == Counter((i, rest) for text, i, rest in rows if i > least[text])


def test_ranges_begin_with_short_prefixes():
    texts = [(f"common head {i:04d} and a tail".encode(), 10) for i in range(1000)]
    ranges = filter_audit.Ranges(texts, 10)
    counts = Counter(ranges.of(t) for t, _ in texts)
    assert len(counts) == 10 and max(counts.values()) <= 150 and max(map(len, ranges.prefixes)) <= 16
    hot = filter_audit.Ranges(texts + [(b"hot", 1)] * 5000, 10)
    assert max(hot.salts) > 1 and hot.of(b"hot") == hot.salts.index(max(hot.salts))
    assert filter_audit.Ranges([], 10).of(b"any") == 0


@pytest.mark.parametrize("size", [filter_audit.TRIE_BYTES, 600])
def test_audit(spark, docs, rows, size):
    """Also with tries that are emptied all the time, and ranges with salts."""
    filters = {"A": F.length("text") < 9, "B": F.col("lang") == "de", "D": F.col("text").rlike("[&x]")}
    known = [(0, True, False), (0, False, True), (1001, True, True), (None, True, True), (1002, None, None), (2003, False, True)]
    labels = spark.createDataFrame(known, "doc_id long, good boolean, toxic boolean")
    got = filter_audit.audit(docs.withColumn("lang", F.col("lang")), labels, filters, copies="C", trie_bytes=size).collect()

    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = []
    for i, text, lang in rows:
        fails = ("A" if text is not None and len(text) < 9 else "") + ("B" if lang == "de" else "")
        fails += "C" if i is not None and i > least[text or ""] else ""
        fails += "D" if text and set("&x") & set(text) else ""
        labels_of = [k for k in known if i is not None and k[0] == i]
        judged.append((lang or "", set(fails), any(k[1] for k in labels_of), any(k[2] for k in labels_of)))
    want, shapley = {}, Counter()
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCD"):
            for step, letter in enumerate(order, 1):
                some = [(f, good, toxic, not f & set(order[: step - 1])) for p, f, good, toxic in judged if p == part]
                here = [x for x in some if letter in x[0] and x[3]]
                want[part, "".join(order), step] = (
                    sum(letter not in f and open_ for f, _, _, open_ in some), len(here),
                    sum(letter in f and not open_ for f, _, _, open_ in some), sum(f == {letter} for f, *_ in some),
                    sum(x[1] for x in here), sum(x[2] for x in here),
                )
                shapley[part, letter] += len(here)
    assert len(got) == len(want)
    for g in got:
        key = (g.part, g.filter_order, g.step)
        assert (g.kept, g.removed, g.redundant, g.unique_fails, g.good_lost, g.toxic_lost) == want[key]
        assert g.shapley == shapley[g.part, g.filter_order[g.step - 1]]
    assert filter_audit.audit(docs.where("false"), labels, filters, copies="C").collect() == []


def test_long_texts_go_to_tries_in_small_batches(spark, monkeypatch):
    name, seen, store = "spark.sql.execution.arrow.maxBytesPerBatch", [], filter_audit.materialize
    monkeypatch.setattr(filter_audit, "materialize", lambda df: (seen.append(spark.conf.get(name)), store(df))[1])
    before = spark.conf.get(name)
    rows = spark.range(50).select("id", F.lit("").alias("part"), F.lit(0).alias("mask"), F.lit("x" * 2000).cast("binary").alias("text"))
    flagged = filter_audit.flag_copies(rows, 1).groupBy("mask").agg(F.sum("times").alias("n")).collect()
    assert {r["mask"]: r["n"] for r in flagged} == {0: 1, 1: 49}
    assert spark.conf.get(name) == before and seen and set(seen) == {"4m"}
