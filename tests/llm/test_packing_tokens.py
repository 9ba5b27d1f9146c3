import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing, token_store
from quern.llm.tokens import WordEncoder

ODD = ["a  b", "  lead", "trail ", "tab\there", "x \n y", " ", "", "a\xa0b", "<|endoftext|> x", "it's   don't", "nul\0byte here", "é combining", "日本語 12 123", "\n\n\nfoo", "foo \n\n bar", "Ünï ΣΑΣ ß", "a" * 300 + " b", "\x1c x \x1d", "🙂🙂 x", "foo\r\nbar  \r\n baz"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab '.,\n\t é1<|>"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_words_encode_as_texts(name, texts):
    coder = WordEncoder.__new__(WordEncoder)
    coder.__dict__ = _coder(name).__dict__
    texts = texts + ODD
    whole = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(c, coder.dtype).tolist() for c in coder.encode(texts)] == whole


_MADE = {}


def _coder(name):
    if name not in _MADE:
        _MADE[name] = WordEncoder(public_tokenizers.path(name))
    return _MADE[name]


def test_memory_is_bounded():
    coder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 20_000)
    for i in range(20):
        text = " ".join(f"w{i * j}" for j in range(30))
        assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(coder.young) <= 85 and len(coder.old) <= 85


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.sampled_from([1, 5, 40]), st.sampled_from([0.2, 0.4, 1.0]))
def test_plans_are_packings(histogram, groups, large):
    plan = packing.Plan(histogram, 64, groups, large)
    place = plan.lookup()
    used = Counter()
    for length, n in histogram.items():
        sequence, offset = place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used.update((s, o + i) for i in range(length))
    assert all(n == 1 for n in used.values())
    per = Counter(s for s, _ in used)
    assert all((s, n - 1) in used and n <= 64 for s, n in per.items()) and set(per) == set(range(plan.sequences))


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plans_are_tight():
    rng = random.Random(3)
    lengths = [rng.randint(1, 256) for _ in range(3000)]
    plan = packing.Plan(dict(Counter(lengths)), 256)
    assert plan.sequences <= 1.005 * best_fit_decreasing(lengths, 256) + 1


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, start int")


def test_pack_documents(spark):
    rows = [(1, "one two three", "x", 1), (2, None, None, None), (3, "", "y", 2), (4, "word " * 200, "z", 3), (4, "word " * 200, "z", 3), (None, "no id", "z", 3)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = packing.pieces(docs_of(spark, rows), path, 64, digest=lambda ids: token_store.crc32(ids)[0])
    placed, plan = packing.place(parts, 64)
    got = placed.collect()
    assert sum(r["length"] for r in got) == sum(len(_coder("byte_bpe_50k.json").tokenizer.encode(t or "").ids) + 1 for _, t, *_ in rows)
    assert max(r["length"] for r in got) <= 64 and len({r["sequence_id"] for r in got}) == plan.sequences
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(parts.where("doc_id in (1, 2, 3)"), placed.where("doc_id in (1, 2, 3)")).collect()}
    ids = np.array([*_coder("byte_bpe_50k.json").tokenizer.encode("one two three").ids, 2], "<u2").tobytes()
    r = next(r for r in got if r["doc_id"] == 1)
    assert ids in whole[r["sequence_id"]] and r["digest"] == zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
    first = [r for r in got if r["doc_id"] == 4 and r["piece"] == 0]
    assert len(first) == 2 and all(r["start"] == 0 for r in first)


def test_pack_nothing(spark):
    parts = packing.pieces(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 64)
    assert packing.place(parts, 64)[0].count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values = np.array(sorted(values), dtype=np.int64)
    made = token_store.EliasFano.from_bytes(token_store.EliasFano.of(values).to_bytes())
    assert made.decode().tolist() == values.tolist()
    assert [made[i] for i in range(0, len(values), 7)] == values[::7].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(token_store.EliasFano.of(values).to_bytes()) * 8 / len(values) < 13


def test_token_shards(spark):
    rows = [(9, "nine nine", "", 0), (1, "one", "", 0), (5, None, "", 0), (7, "", "", 0), (7, "twice", "", 0), (None, "none", "", 0)]
    folder = token_store.new_folder(spark)
    manifest = token_store.write_shards(docs_of(spark, rows), folder, public_tokenizers.path("word_bpe_49k.json"), shards=3)
    got = sorted(token_store.read_shards(manifest).collect(), key=lambda r: r["start"])
    tokenizer = _coder("word_bpe_49k.json").tokenizer
    want = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in [(None, "none"), (1, "one"), (5, None), (7, ""), (7, "twice"), (9, "nine nine")]]
    assert [(r["doc_id"], r["ids"]) for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *[len(i) for _, i in want]])[:-1].tolist()
    last = manifest.orderBy("shard").collect()[-1]
    shard, handle = token_store.open_shard(last["path"])
    with handle:
        assert shard.document(last["docs"] - 1).tolist() == want[-1][1]
    assert token_store.read_shards(token_store.write_shards(docs_of(spark, []), token_store.new_folder(spark), public_tokenizers.path("word_bpe_49k.json"))).count() == 0
