"""Every query of the subpackage, and the pipeline, on a small folder: columns, types, and rows against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from quern.llm import chains, queries

EN = "the house of people is on hill and they have been there with that from this great river".split()
DE = "das haus der leute ist auf dem hügel und sie sind dort mit nicht gewesen von diesem fluss".split()
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def prose(rng, n, lang):
    return " ".join(rng.choice(EN if lang == "en" else DE) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(12)
    item = " ".join(f"bench{i}" for i in range(25))
    passage = " ".join(f"shared{i}" for i in range(70))
    docs = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = prose(rng, rng.randint(3, 90), lang)
        if i % 17 == 5:
            text = f"{prose(rng, 40, lang)} {passage} {prose(rng, 40, lang)}"
        if i % 23 == 7:
            text += f" {item} {prose(rng, 5, lang)}"
        if i % 19 == 18:
            text = docs[i - 3][1]
        docs.append((i, text, lang if i % 7 else None, "s", 0))
    docs += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "123 -- 4", None, "s", 0), (203, "x", "en", "s", 0), (204, prose(rng, 2500, "en"), "en", "s", 0), (3, docs[3][1], "en", "s", 0)]
    pages = [(i, f"http://h{i % 3}.org/{i}", f"<nav><a href='/'>Home</a></nav><article><h1>T{i}</h1><p>{prose(rng, 30, 'en')}</p></article><footer>f</footer>" if i % 5 else "<p>" + "copied " * 20) for i in range(30)] + [(90, None, None)]
    base = np.random.default_rng(4).standard_normal((60, 24))
    vectors = [(i, [float(np.float32(x)) for x in (base[i // 3 * 3] + (i % 3) * 0.05 * base[i])], 0) for i in range(60)]
    held = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": ([(1, item), (2, "short item"), (3, None)], "item_id long, text string"),
        "pages": (pages, "page_id long, url string, html string"),
        "embeddings": (vectors + [(99, None, 1)], "vec_id long, embedding array<float>, label int"),
    }
    root = str(tmp_path_factory.mktemp("small"))
    for name, (rows, schema) in held.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root, {name: rows for name, (rows, _) in held.items()}


def run(spark, data, name, schema):
    found = queries.QUERIES[name](spark, data[0])
    assert [(f.name, f.dataType.simpleString()) for f in found.schema.fields[: len(schema.split(", "))]] == [tuple(c.split()) for c in schema.split(", ")]
    return found.collect()


def ids_of(name, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def packs(rows, docs):
    """Whether pieces are whole documents in order, packed without gaps; and the number of sequences."""
    texts, pieces, rooms = {}, {}, {}
    for d, text, *_ in docs:
        texts.setdefault(d, []).append(text)
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = ids_of("byte_bpe_50k.json", texts[d][0])
        times = len(texts[d])
        own = sorted(own, key=lambda r: r["piece"])[:: times]
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and all(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in own)
    for room in rooms.values():
        at = 0
        for offset, n in sorted(room):
            assert offset == at
            at += n
        assert at <= 1024
    return len(rooms)


PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def test_op1(spark, data):
    rows = run(spark, data, "op1_best_fit_packing", PACKED)
    assert packs(rows, data[1]["documents"]) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_op2(spark, data):
    rows = run(spark, data, "op2_warc_index", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    pages = {p: (h or "").encode() for p, _, h in data[1]["pages"]}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    want = {p: (p, len(h), hashlib.sha256(h).hexdigest(), *(("revisit", first[h]) if len(h) >= 100 and first[h] != p else ("response", None))) for p, h in pages.items()}
    assert {r["page_id"]: tuple(r) for r in rows} == want and len(rows) == len(want)


def test_op3(spark, data):
    rows = run(spark, data, "op3_html_extraction", "page_id bigint, url string, text string, n_chars bigint")
    for r in rows:
        html = next(h for p, _, h in data[1]["pages"] if p == r["page_id"]) or ""
        want = "\n\n".join(x for x in re.findall(r"<(?:h1|p)>([^<]*)", html)).strip()
        assert r["text"] == want and r["n_chars"] == len(want)


def runs_of(docs, least=chains.LEAST):
    """doc_id: words within runs of ``least`` words that a document of lesser id has."""
    seen, out = {}, {}
    for d, text in sorted(docs.items()):
        w = (text or "").lower().split()
        for i in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[i : i + least]), d) < d:
                out.setdefault(d, set()).update(range(i, i + least))
    return out


def test_op4(spark, data):
    rows = run(spark, data, "op4_substring_dedup", "doc_id bigint, start int, end int, other_id bigint, other_start int, other_end int, agreement double")
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    want = runs_of({d: t for d, t, *_ in data[1]["documents"]})
    assert len(want) > 5 and all(w <= got.get(d, set()) for d, w in want.items()) and set(got) == set(want)


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op5(spark, data):
    rows = run(spark, data, "op5_embedding_near_dedup", "vec_id bigint, n_links bigint, component_id bigint, kept boolean")
    v = np.array([e for _, e, _ in data[1]["embeddings"][:-1]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= 0.9
    np.fill_diagonal(linked, False)
    group = closure(range(len(v)), zip(*np.nonzero(linked), strict=True))
    want = {i: (i, int(linked[i].sum()), group[i], group[i] == i) for i in range(len(v))} | {99: (99, 0, 99, True)}
    assert linked.sum() > 20 and {r["vec_id"]: tuple(r) for r in rows} == want


def hits(text, items):
    w = WORD.findall((text or "").lower() if (text or "").isascii() else (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, names = set(), set()
    for name, item in items:
        v = WORD.findall((item or "").lower())
        n = min(10, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_op6(spark, data):
    rows = run(spark, data, "op6_decontamination", "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
    want = []
    for d, text, *_ in data[1]["documents"]:
        n, k, names = hits(text, data[1]["benchmark"])
        want.append((d, n, k, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), k > 0))
    assert sorted(map(tuple, rows)) == sorted(want) and any(w[5] for w in want)


def test_op7(spark, data):
    rows = run(spark, data, "op7_token_binary", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["start"]))
    at = 0
    for r, (d, text) in zip(rows, sorted((d, t or "") for d, t, *_ in data[1]["documents"]), strict=True):
        ids = ids_of("word_bpe_49k.json", text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), crc(ids))
        at += len(ids)


def test_op8(spark, data):
    rows = run(spark, data, "op8_language_id", "doc_id bigint, held_out boolean, lang_pred string, score double")
    docs = data[1]["documents"]
    assert len(rows) == len(docs)
    true = {d: ("en" if d % 3 else "de") for d, *_ in docs[:120]} | {203: "en", 204: "en"}
    copied = {i for i in range(120) if i % 19 == 18}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] in (200, 201, 202):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in true and r["doc_id"] not in copied and r["doc_id"] % 17 != 5 and r["doc_id"] % 23 != 7]
    assert len(held) > 15 and sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_op9(spark, data):
    rows = run(spark, data, "op9_size_tiered_sharding", "doc_id bigint, lang string, source string, n_chars bigint, text_sha256 string")
    want = [(d, lang, s, n, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, t, lang, s, n in data[1]["documents"]]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(docs):
    prints = {}
    for d, text, *_ in docs:
        prints.setdefault(d, fingerprint(text))
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    return prints, closure(prints, near)


def test_op10(spark, data):
    rows = run(spark, data, "op10_simhash_near_dedup", "doc_id bigint, fingerprint string, component_id bigint")
    prints, group = groups(data[1]["documents"])
    assert {tuple(r) for r in rows} == {(d, f"{f:016x}", group[d]) for d, f in prints.items()} and len(rows) == len(data[1]["documents"])


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = [r for r in data[1]["documents"] if any(c.isalpha() for c in r[1] or "")]
    _, group = groups(docs)
    docs = [r for r in docs if group[r[0]] == r[0]]
    out = []
    gone = runs_of({r[0]: r[1] for r in docs})
    for d, text, *_ in docs:
        text = " ".join(w for i, w in enumerate(text.split()) if i not in gone.get(d, ())) if d in gone else text
        if text and not hits(text, data[1]["benchmark"])[1]:
            out.append((d, text))
    rows = corpus_pipeline.run(spark, data[0]).collect()
    assert 20 < len(out) < len(docs) and gone
    assert packs(rows, out) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_empty_tables(spark, data, tmp_path):
    import corpus_pipeline

    root = str(tmp_path)
    for name in data[1]:
        spark.read.parquet(f"{data[0]}/{name}.parquet").where("false").write.parquet(f"{root}/{name}.parquet")
    for query in queries.QUERIES.values():
        assert query(spark, root).count() == 0
    assert corpus_pipeline.run(spark, root).count() == 0


def test_stages_keep_columns_of_any_name(spark, data):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ["found", "key", "spans", "a", "b", "language", "text_hash", "hash", "copy", "gone"]
    docs = spark.read.parquet(f"{data[0]}/documents.parquet").where("doc_id < 40").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
    assert docs.count() > 5 and corpus_pipeline.STAGES[-1][1](spark, docs, data[0]).count() > 5
