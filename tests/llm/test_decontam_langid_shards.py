import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import compaction, decontam, langid
from quern.llm.words import LETTERS, coded

EN = "the house of the people is on the hill and they have been there with that".split()
DE = "das haus der leute ist auf dem hügel und sie sind dort mit dem gewesen nicht".split()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, items, width=10):
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for name, item in items:
            v = WORD.findall((item or "").translate(LOWER))
            n = min(width, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add(name)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize(("size", "pairs"), [(10, 3), (1 << 20, 1 << 20)])
def test_decontamination(spark, monkeypatch, size, pairs):
    rng = random.Random(1)
    for name, value in (("SHARD_WORDS", size), ("BLOCK_WORDS", size), ("PAIRS", pairs)):
        monkeypatch.setattr(decontam, name, value)
    say = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [("1", say(15, 3)), ("2", "Short ITEM"), ("10", say(40, 2)), ("3", None), ("4", "... !"), ("5", "É x-y")]
    items.append(("6", items[0][1]))
    texts = [say(rng.randint(0, 120), rng.choice([2, 3, 8])) for _ in range(40)] + [None, "", "a SHORT, item here", "é X y", "É X y", items[0][1] + " b " + items[0][1]]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r["found"] for r in decontam.annotate(docs, bench).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items)):
        assert (got[i]["n_words"], got[i]["n_hit"], sorted(got[i]["items"])) == (n, hit, found), texts[i]
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(h == 0 for _, h, _ in brute(texts, items))
    assert decontam.decontaminate(docs, bench.where("false")).count() == len(texts)
    assert decontam.annotate(docs.where("false"), bench).count() == 0


def test_matches_are_longest(monkeypatch):
    def made(texts):
        return coded(pa.array(texts), LETTERS)

    block = decontam.Block(*made([" ".join("abcdefghijklmno")]), ["x"])
    shard = decontam.Shard.of(*made([" ".join("zzabcdefghijklzz"), "a b", ""]))
    assert decontam.found_in(shard, [block])[:2] == [(16, 12, ["x"], [("x", 2, 0, 12)], list(range(2, 14))), (2, 0, [], [], [])]
    rng = random.Random(3)
    texts, items = ([" ".join(rng.choice("ab") for _ in range(rng.randint(12, 90))) for _ in range(n)] for n in (6, 5))
    block, shard = decontam.Block.from_bytes(decontam.Block(*made(items), list("abcde")).to_bytes()), decontam.Shard.of(*made(texts))
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(decontam, "PAIRS", pairs)
        got, want = {tuple(r) for r in decontam.matches(shard, block).tolist()}, set()
        for t, text in enumerate(x.split() for x in texts):
            for k, item in enumerate(x.split() for x in items):
                for i in range(len(text)):
                    for j in range(len(item)):
                        if i and j and text[i - 1] == item[j - 1]:
                            continue
                        n = 0
                        while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n]:
                            n += 1
                        if n >= 10:
                            want.add((t, k, i, j, n))
        assert got == want and len(want) > 20


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 300)
    order = decontam.SuffixArray(codes, 64).order.tolist()
    padded = codes.tolist() + [0] * 65
    assert sorted(order) == np.flatnonzero(codes).tolist()
    cut = [tuple(padded[i : i + 64]) for i in order]
    stop = [c[: c.index(0)] if 0 in c else c for c in cut]
    assert all(a <= b or a[: len(b)] == b for a, b in zip(stop, stop[1:], strict=False))


def labelled(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(EN if i % 2 else DE) for _ in range(40)), "en" if i % 2 else "de") for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark):
    model = langid.fit(labelled(spark))
    assert model.languages == ["de", "en"]
    mixed = " ".join(EN * 2 + DE * 2 + EN)
    texts = [" ".join(EN), " ".join(DE), mixed, None, "", "123 -- !", "привет мир", "THE HOUSE"]
    docs = spark.createDataFrame([(i, t, "und", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r["language"] for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang"] for i in (0, 1, 2, 3, 4, 5, 7)] == ["en", "de", "en", "und", "und", "und", "en"]
    assert got[6]["lang"] in model.languages and all(0 <= g["score"] <= 1 for g in got.values()) and got[3]["score"] == 0
    spans = got[2]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "en"] and abs(spans[1]["start"] - 2 * len(EN)) <= 1
    assert langid.identify(docs.where("false"), model).count() == 0
    none = langid.fit(labelled(spark).where("false"))
    assert {r["language"]["lang"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_paths_are_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k, switch = int(rng.integers(1, 50)), int(rng.integers(1, 5)), float(rng.choice([1, 3, 8]))
        logs = rng.normal(size=(n, k)) * rng.choice([0.3, 1, 3])
        path = langid.paths([rng.normal(size=(7, k)), logs, rng.normal(size=(70, k))], switch)[1]
        one = langid.single(logs, switch)
        score = logs[0].copy()
        for row in logs[1:]:
            score = np.maximum(score, score.max() - switch) + row
        worth = lambda p: logs[np.arange(n), p].sum() - switch * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert abs(worth(path) - score.max()) < 1e-9
        assert one is None or abs(worth(np.full(n, one)) - score.max()) < 1e-9


def test_shards(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"), target_bytes=4000, least_bytes=200, fanout=3)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * (i % 50), i % 4) for i in range(400)] + [(1, "x", 1)], "doc_id long, text string, arrival int")
    assert store.append(rows.where("doc_id < 100").repartition(5)) == 1
    versions = store.append_arrivals(rows.where("doc_id >= 100").repartition(2), rows["arrival"])
    assert versions == [2, 3, 4, 5]
    old = store.manifest(5)[1]
    whole = sorted(map(tuple, store.read().collect()), key=str)
    assert whole == sorted(map(tuple, rows.collect()), key=str)
    done = store.compact()
    assert done and not store.runs() and len(store.manifest()[1]) < len(old)
    assert sorted(map(tuple, store.read().collect()), key=str) == whole == sorted(map(tuple, store.read(5).collect()), key=str)
    assert sum(s.rows for s in store.manifest()[1]) == 401
    assert store.vacuum() > 0 and sorted(map(tuple, store.read().collect()), key=str) == whole
    before = store.version()
    assert store.append(rows.where("false")) == before + 1 and store.read().count() == 401


def test_only_one_writer_takes_a_version(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    store.append(rows)
    schema, shards = store.manifest()
    with pytest.raises(compaction.Conflict):
        store._commit(1, schema, shards)
    with pytest.raises(compaction.Conflict):
        store._add([], schema, frozenset({"gone"}))
    assert store.version() == 1 and store.read().count() == 3
    with pytest.raises(ValueError, match="nothing"):
        compaction.ShardStore(spark, str(tmp_path / "t")).read()


def test_no_arrivals_are_a_version(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert store.append_arrivals(rows, rows["doc_id"] % 4) == [1] and store.compact() == []
    store.vacuum()
    assert store.read().count() == 0 and store.read().columns == ["doc_id", "text"]


def test_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "b c"), ("7", "c d")], "item_id string, text string")
    got = {r["doc_id"]: r["found"] for r in decontam.annotate(docs, bench).collect()}
    assert (got[1]["n_hit"], got[1]["items"], len(got[1]["matches"])) == (3, [None, "7"], 2) and got[2]["n_hit"] == 0
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [2]
