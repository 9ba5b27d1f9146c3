import random

import numpy as np
import pytest

from quern.llm import chains, common, near_vectors, simhash
from quern.llm.common import components

WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow_simhash(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def closure(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_documents(spark):
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(20)]
    texts += [texts[0], texts[0].upper(), texts[1].replace("w1 ", "w2 "), texts[1] + " extra", texts[2].rsplit(" ", 1)[0], None, "", "one", "one two", "\t \n", texts[3] + " "]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    want = {d: slow_simhash(t) for d, t, _ in rows}
    assert all(int(r["fingerprint"], 16) == want[r["doc_id"]] for r in got)
    near = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 3]
    group = closure(want, near)
    assert {r["doc_id"]: r["component_id"] for r in got} == group
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ball_links(spark):
    rng = random.Random(7)
    codes = {rng.getrandbits(64) for _ in range(200)}
    for c in list(codes)[:60]:
        for _ in range(rng.randint(1, 6)):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            codes.add(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    found = [(r["src"], r["dst"]) for r in links.collect()]
    assert set(map(tuple, map(sorted, found))) <= set(near)
    assert closure(signed, found) == closure(signed, near)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    """Rounds, and what the driver holds of them, don't follow the length of a chain whose nodes lie at random."""
    written, write = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(common, "LAST", 20, raising=False)
    rng = random.Random(9)
    nodes = [rng.getrandbits(63) - (1 << 62) for _ in range(3000)]
    edges = [*zip(nodes, nodes[1:], strict=False), *((nodes[0] + 1, nodes[0] + 2 + i) for i in range(200))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == closure({n for e in edges for n in e}, edges)
    assert len(written) < 80


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    rows = []
    for i, v in enumerate(base):
        rows.append(v)
        for _ in range(i % 3):
            rows.append(v + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3]))
    rows += [base[0] * 2, base[1], base[1], base[1]]
    vectors = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]
    n = len(vectors)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [float("inf")] * 16, 0), (n + 4, [], 0), (n + 5, [1.0, None], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [1e30] * 16, 0), (n + 8, [1e30] * 16, 0)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, a int")
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(df).collect()}
    m = np.array([v for _, v, _ in vectors])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    found = sum(got[i]["n_links"] for i in range(n))
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(n)) and found >= 0.98 * linked.sum()
    group = closure(range(n), zip(*np.nonzero(linked), strict=True))
    assert sum(got[i]["component_id"] == group[i] for i in range(n)) >= 0.98 * n
    for i in range(n, n + 7):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[n + 8]["component_id"] == n + 7 and got[n + 7]["n_links"] == 1
    assert near_vectors.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [100, 10_000, 10_000_000])
def test_calibration_keeps_cells_small(n):
    signs, lists, half = near_vectors.calibrate(n)
    assert n / 2**signs <= 16 and lists < 4000 and 0.8 < half < 1


def test_passages(spark):
    rng = random.Random(11)
    shared = [rng.choice(WORDS) for _ in range(70)]
    fuzzy = shared[:20] + ["changed"] + shared[21:45] + ["more", "words"] + shared[45:]
    short = " ".join(shared[:40])
    texts = {1: prose(rng, 100) + " " + " ".join(shared) + " " + prose(rng, 60), 2: prose(rng, 80) + "\n" + " ".join(shared).upper() + "\n" + prose(rng, 30), 3: prose(rng, 20) + " " + " ".join(fuzzy), 4: prose(rng, 90) + " " + short, 5: prose(rng, 300), 6: None, 7: "", 8: "tiny text", 10: ("same line again and again " * 60)}
    texts[9] = texts[5]
    rows = [(d, t, 0) for d, t in texts.items()] + [(None, texts[5], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = chains.passages(docs).collect()
    assert {r["doc_id"] for r in got} == {2, 3, 9} and all(r["other_id"] < r["doc_id"] and r["agreement"] >= 0.8 for r in got)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(range(80, 150)) <= of[2] <= set(range(78, 152)) and of[9] == set(range(300))
    assert len(of[3] & set(range(20, 92))) >= 68
    left = {r["doc_id"]: r["text"] for r in chains.remove_passages(docs, chains.passages(docs)).collect()}
    assert 9 not in left and len(left[2].split()) in range(106, 113) and left[1] == texts[1] and left[6] is None and left[7] == "" and left[10] == texts[10]
    assert chains.passages(docs.where("false")).count() == 0


def test_chain_is_best():
    rng = random.Random(4)
    for _ in range(200):
        runs = sorted({(rng.randint(0, 80), rng.randint(0, 80)): rng.randint(5, 12) for _ in range(rng.randint(1, 30))}.items())
        a, b, n = (np.array(x) for x in zip(*[(p, q, k) for (p, q), k in runs], strict=True))
        best = [float(k) for k in n]
        for i in range(len(a)):
            for j in range(i):
                gap_a, gap_b = a[i] - a[j] - n[j], b[i] - b[j] - n[j]
                if gap_a >= 0 and gap_b >= 0:
                    best[i] = max(best[i], n[i] + best[j] - chains.GAP * (gap_a + gap_b))
        score, _ = chains.best_chains(a, b, n)
        assert np.allclose(score, best)
        found = chains.chain(a, b, n)
        assert sorted(np.concatenate(found).tolist()) == list(range(len(a)))
        assert all((np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all() for c in found)


def test_words_are_cut_out():
    assert chains.without("a b  c\nd e ", [(1, 3)]) == "a d e" and chains.without("a b", [(0, 2)]) == "" and chains.without("é b", [(1, 9)]) == "é"


def repeats(texts, least):
    """The words of each document inside runs of ``least`` words that a document of lesser id has."""
    seen, out = {}, {}
    for doc in sorted(texts):
        words = texts[doc].lower().split()
        runs = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        for i, run in enumerate(runs):
            if seen.setdefault(run, doc) < doc:
                out.setdefault(doc, set()).update(range(i, i + least))
    return out


def covered(spark, texts):
    got = {}
    for r in chains.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert r["other_id"] < r["doc_id"] and r["agreement"] >= 0.8
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return got


def unlike(n, k):
    return " ".join(f"w{n}x{i}" for i in range(k))


def laid_out(spark, texts, parts):
    rows = [r for d, t in texts.items() for r in ([(d, t)] if not isinstance(t, list) else [(d, x) for x in t])]
    got = {}
    for r in chains.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "text")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return got


def test_verbatim_passages_whose_parts_have_other_holders(spark):
    a, b = unlike("a", 30), unlike("b", 25)
    held = [b, a, f"{a} {b}", a, b, f"{a} {b}"]
    texts = {i: f"{unlike(i, 60)} {t} {unlike(i + 100, 60)}" for i, t in enumerate(held)}
    assert repeats(texts, chains.LEAST)[5] <= covered(spark, texts).get(5, set())


def test_repeated_rows_and_fragments_lose_no_passage(spark):
    passage = [f"p{i}" for i in range(120)]
    whole = " ".join(passage)
    texts = {i: f"{unlike(i, 30)} {' '.join(passage[at : at + n])} {unlike(i + 50, 30)}" for i, (at, n) in enumerate([(0, 40), (30, 48), (70, 45), (80, 40), (10, 44), (50, 48)])}
    texts |= {10: f"{whole} {unlike(60, 20)}", 11: [f"{unlike(61, 20)} {whole}"] * 2, 12: [whole, "zz " + unlike(62, 70)]}
    for parts in (1, 4):
        got = laid_out(spark, texts, parts)
        assert set(range(20, 140)) <= got[11] and set(range(120)) <= got[12] and 10 not in got
    rows = [(11, texts[11][0]), (11, texts[11][0]), (10, texts[10]), (12, whole), (12, "zz " + unlike(62, 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r["doc_id"], r["text"]) for r in chains.remove_passages(docs, chains.passages(docs)).collect())
    assert left == [(10, texts[10]), (11, unlike(61, 20)), (11, unlike(61, 20)), (12, "zz " + unlike(62, 70))]


def test_verbatim_passages_equal_brute_force(spark):
    for seed, parts in ((5, 1), (6, 7)):
        rng = random.Random(seed)
        held = [unlike(f"p{i}", rng.choice([12, 25, 30, 48, 60])) for i in range(12)] + ["again and again " * 20]
        texts = {i: " ".join(rng.choice(held) if rng.random() < 0.7 else unlike(f"d{i}n{j}", 20) for j in range(9)) for i in range(60)}
        want, got, other = repeats(texts, chains.LEAST), laid_out(spark, texts, parts), laid_out(spark, texts, 3)
        assert len(want) > 30 and all(w <= got.get(i, set()) for i, w in want.items()) and got == other


def changed(rng, words, share, kinds="sdi"):
    """``words`` of which 1 - ``share`` are replaced, dropped or followed by another."""
    out = list(words)
    for i in sorted(rng.sample(range(len(words)), round(len(words) * (1 - share))), reverse=True):
        kind = rng.choice(kinds)
        out[i : i + 1] = [f"c{rng.random()}"] if kind == "s" else [] if kind == "d" else [out[i], f"c{rng.random()}"]
    return out


def test_recall_of_passages_that_differ(spark):
    """At least 0.9 of passages of 55 to 200 words of which 0.8 to 0.95 agree, and no others."""
    rng, texts, planted = random.Random(8), {}, {}
    for i in range(400):
        n, share = rng.choice([55, 80, 120, 200]), rng.choice([0.8, 0.85, 0.9, 0.95])
        words = prose(rng, n).split()
        texts[i] = f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 60)}"
        other = changed(rng, words, share, "s" if i % 2 else "sssdi")
        planted[1000 + i] = len(other)
        texts[1000 + i] = f"{prose(rng, 50)} {' '.join(other)} {prose(rng, 50)}"
    got = covered(spark, texts)
    caught = [len(got.get(d, set()) & set(range(50, 50 + n))) >= 0.6 * n for d, n in planted.items()]
    assert sum(caught) / len(caught) >= 0.9
    assert not set(got) - set(planted)
    outside = sum(len(got[d] - set(range(46, 54 + planted[d]))) for d in got)
    assert outside <= 0.01 * sum(map(len, got.values()))


def test_long_and_uniform_texts(spark):
    word = "same " * 30_000
    long = unlike("long", 40_000)
    got = covered(spark, {1: word, 2: word + "end", 3: long, 4: "x " + long, 5: "ab " * 10 + "cd ef " * 5000, 6: "cd ef " * 4000})
    assert len(got[2]) >= 30_000 and got[4] == set(range(1, 40_001)) and len(got[6]) == 8000


def test_a_chain_gives_all_its_stretches():
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(1, 1 << 31, n).astype("<u4")
    first, middle, last = new(60), new(20), new(60)
    first_again = first.copy()
    first_again[30] = 0
    x, y = (np.concatenate([f, new(21), middle, new(21), last]) for f in (first, first_again))
    (run,) = chains.chain(*chains.equal_runs(x, y, -30, 30))
    found = chains.align(x, y, *(v[run] for v in chains.equal_runs(x, y, -30, 30)))
    assert [f[:2] for f in found] == [(0, 60), (122, 182)] and all(f[4] >= 0.8 for f in found)


def test_passages_whose_words_occurred_before_in_the_text(spark):
    f, g = unlike("f", 30), unlike("g", 25)
    texts = {1: f"{unlike(1, 40)} {f} {g} {unlike(2, 40)}", 2: f"{f} {unlike(3, 60)} {f} {g} {unlike(4, 9)}", 3: f"{f} {g} {unlike(5, 60)} {f} {g} {unlike(6, 9)}"}
    want, got = repeats(texts, chains.LEAST), covered(spark, texts)
    assert want[2] <= got.get(2, set()) and len(want[3]) == 110 and want[3] <= got.get(3, set())
