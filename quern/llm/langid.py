"""Language identification of texts and of the spans within them.

A word's script narrows the languages it can be of; among these, counts of
character n-grams give each language's share of belief in the word. A Viterbi
pass over the words, with a penalty for every change of language, labels spans;
a text's language is that of most of its letters in such spans.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE``
documents, shared out evenly over the languages and taken by a hash of the id, so
a rare language is learned at any size of the table. Of their features the
``FEATURES`` most frequent are kept, less those seen fewer than ``LEAST_SEEN``
times. Predictions read every whole text. A text without letters, or a null one,
is ``und`` with score 0; so is all text where no row is labelled. Words of a
script that no learned language uses favour none; of equal languages the first in
order counts. Repeated rows are judged alike.

A worker remembers scores of words up to ``MEMORY`` bytes and forgets them when
its task ends; longer words than ``LONGEST_KEPT`` are scored each time. A text
takes four bytes for each of its words and languages while it is labelled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import prepare, released

#: Labelled documents that a fit reads at most, but for the luck of the hash; features it keeps, and how often one must be seen.
SAMPLE, FEATURES, LEAST_SEEN = 12_000, 200_000, 3
#: Languages that a model learns, the most frequent ones; their shares of the sample are all that is broadcast.
LANGUAGES = 500
#: Cost of a change of language, in nats, and the belief spread evenly over a word's candidates.
SWITCH, DOUBT = 12.0, 0.05
#: Bytes of word scores that a worker keeps before it starts anew, what a word takes besides, characters of the longest kept.
MEMORY, ENTRY, LONGEST_KEPT = 64 << 20, 200, 48
#: First code point of a range and the script of the letters in it.
SCRIPTS = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Other"), (0xB80, "Tamil"), (0xC00, "Other"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other")]
_STARTS = [s for s, _ in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "lang string, score double, spans array<struct<lang:string,start:int,end:int>>"


def script(word: str) -> str:
    """The script of most of a word's letters; the first of equals."""
    if max(word) < "\u0370":
        return "Latin"
    return Counter(SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


def letters(token: str) -> str:
    if token.isalpha():
        return token
    return "".join(_LETTERS.findall(token))


def features(word: str) -> list[str]:
    edged = f"<{word}>"
    out = [edged[i : i + 3] for i in range(len(word))]
    if len(word) <= 6:
        out.append(f"={word}")
    return out


class Model:
    def __init__(self, languages: list[str], places: dict[str, int], logs: np.ndarray, scripts: dict[str, np.ndarray]):
        self.languages, self.places, self.logs, self.scripts = languages, places, logs, scripts
        self.any = np.ones(len(languages), bool)

    def beliefs(self, words: list[str]) -> np.ndarray:
        """Each language's share of belief in each word of letters: a row for each word."""
        n, get = len(self.languages), self.places.get
        may = np.array([self.scripts.get(script(w), self.any) for w in words])
        total = np.zeros((len(words), n))
        at = [[i for f in features(w) if (i := get(f)) is not None] for w in words]
        size = np.array([len(a) for a in at])
        if some := np.flatnonzero(size).tolist():
            flat = self.logs[np.concatenate([at[i] for i in some])]
            total[some] = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0)
        total[~may] = -np.inf
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share = (1 - DOUBT) * share / share.sum(axis=1, keepdims=True) + DOUBT * may / may.sum(axis=1, keepdims=True)
        return np.where(may, share, 1e-4)


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts, where each text's words end); words are lower-cased and free of white space."""
    rows = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = rows.flatten()
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(there)])[rows.offsets.to_numpy()[1:] - rows.offsets.to_numpy()[0]]
    coded = flat.filter(pa.array(there)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), ends


def fit(labelled: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from at most about ``sample`` of the rows that have a text and a language."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # The quota of a language is what is left when all smaller ones have theirs, shared evenly.
    order = Window.orderBy("n", "lang")
    shared = sizes.select("lang", "n", F.row_number().over(order).alias("place"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.count("*").over(Window.partitionBy()).alias("languages"))
    quota = F.max(F.least(F.col("n"), F.floor((F.lit(sample) - F.least(F.lit(sample), F.col("before"))) / (F.col("languages") - F.col("place") + 1)))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    shares = shared.select("lang", F.least(F.lit(1.0), quota / F.col("n")).alias("share"))
    rows = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, Counter] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            words, place, ends = tokens_of(batch.column(0))
            of = np.repeat(langs, np.diff(np.concatenate([[0], ends])))
            for lang in set(langs.tolist()):
                found = np.bincount(place[of == lang], minlength=len(words))
                seen = tokens.setdefault(lang, Counter())
                for i in np.flatnonzero(found).tolist():
                    seen[words[i]] += int(found[i])
        for lang, seen in tokens.items():
            totals: Counter = Counter()
            for token, times in seen.items():
                if word := letters(token):
                    totals["#" + script(word)] += times
                    for f in features(word):
                        totals[f] += times
            yield pa.RecordBatch.from_pydict({"feature": list(totals), "lang": [lang] * len(totals), "n": list(totals.values())}, schema=pa.schema([("feature", pa.string()), ("lang", pa.string()), ("n", pa.int64())]))

    counts = rows.select("text", "lang").mapInArrow(released(count), "feature string, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    counts = counts.where(f"n >= {LEAST_SEEN} or feature like '#%'").groupBy("feature").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("of"))
    counts = counts.orderBy(~F.col("feature").startswith("#"), F.desc("total"), "feature").limit(FEATURES)
    found = counts.select("feature", F.explode("of").alias("of")).select("feature", "of.lang", "of.n").toPandas()
    languages = sorted(found["lang"].unique())
    scripts: dict[str, np.ndarray] = {}
    marks = found[found["feature"].str.startswith("#")]
    per = marks.groupby("lang")["n"].sum()
    for name, lang, n in marks.itertuples(index=False):
        if n >= 0.01 * per[lang]:
            scripts.setdefault(name[1:], np.zeros(len(languages), bool))[languages.index(lang)] = True
    found = found[~found["feature"].str.startswith("#")]
    names = sorted(found["feature"].unique())
    places = {f: i for i, f in enumerate(names)}
    table = np.zeros((len(names), len(languages)))
    if len(names):
        at = {lang: i for i, lang in enumerate(languages)}
        table[found["feature"].map(places).to_numpy(), found["lang"].map(at).to_numpy()] = found["n"].to_numpy()
    whole = table.sum(axis=0) + 0.5 * (len(names) + 1)
    return Model(languages, places, np.log((table + 0.5) / whole).astype(np.float32), scripts)


def single(logs: np.ndarray, switch: float = SWITCH) -> int | None:
    """The language of a text in which no change can pay, else None.

    None pays if no stretch of words favours another language over the best one
    by more than ``switch``, nor a beginning and an end together: a path with
    changes gains no more than that in any of its parts, and pays as much for
    each change.
    """
    best = int(logs.sum(axis=0).argmax())
    gain = np.cumsum(logs - logs[:, [best]], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    most = max(gain[0].max(), (gain[1:] - low[:-1]).max(initial=0))
    return best if most <= switch and max(0, gain.max()) + (gain[-1] - low[-1]).max() <= switch else None


def paths(texts: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of languages through each text's per-word scores, where each change costs ``switch``.

    The texts go through the pass side by side, longest first, so that those
    that still have words are a beginning of the rows.
    """
    if not texts:
        return []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    logs = np.concatenate([texts[i] for i in order])
    back = np.zeros(logs.shape, np.int16)
    here = np.arange(logs.shape[1], dtype=np.int16)
    score = logs[start]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    for t in range(1, int(size[0])):
        n = active[t]
        top = score[:n].argmax(axis=1)
        least = score[np.arange(n), top] - switch
        change = score[:n] < least[:, None]
        at = start[:n] + t
        back[at] = np.where(change, top[:, None], here)
        score[:n] = np.where(change, least[:, None], score[:n]) + logs[at]
    path = np.zeros(len(logs), np.int64)
    path[start + size - 1] = score.argmax(axis=1)
    for t in range(int(size[0]) - 1, 0, -1):
        at = start[: active[t]] + t
        path[at - 1] = back[at, path[at]]
    out: list[np.ndarray] = [path] * len(texts)
    for i, a, n in zip(order, start.tolist(), size.tolist(), strict=True):
        out[i] = path[a : a + n]
    return out


class Labeller:
    """A task's model with the scores of words met lately."""

    def __init__(self, model: Model, memory: int = MEMORY):
        self.model, self.memory = model, memory
        self.room = max(1, memory // (ENTRY + 8 * len(model.languages)))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs, self.size = np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int32)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log shares of the languages, letters) of distinct words; those without letters favour none."""
        places = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))
        logs, size = np.zeros((len(words), len(self.model.languages)), np.float32), np.zeros(len(words), np.int64)
        known = np.flatnonzero(places >= 0)
        logs[known], size[known] = self.logs[places[known]], self.size[places[known]]
        fresh = np.flatnonzero(places < 0).tolist()
        spelled = [letters(words[i]) for i in fresh]
        some = [i for i, w in zip(fresh, spelled, strict=True) if w]
        if some:
            named = [w for w in spelled if w]
            logs[some] = np.log(self.model.beliefs(named))
            size[some] = [len(w) for w in named]
        kept = [i for i in fresh if len(words[i]) <= LONGEST_KEPT]
        if len(self.rows) + len(kept) > self.room:
            self.forget()
        kept = kept[: self.room]
        start = len(self.rows)
        if start + len(kept) > len(self.size):
            more = max(start + len(kept), min(self.room, 2 * len(self.size))) - len(self.size)
            self.logs = np.vstack([self.logs, np.zeros((more, self.logs.shape[1]), np.float32)])
            self.size = np.append(self.size, np.zeros(more, np.int32))
        self.logs[start : start + len(kept)], self.size[start : start + len(kept)] = logs[kept], size[kept]
        self.rows.update({words[i]: start + k for k, i in enumerate(kept)})
        return logs, size

    def label(self, texts: pa.Array | list[str | None]) -> list[dict]:
        n, none = len(texts), {"lang": "und", "score": 0.0, "spans": []}
        if not self.model.languages or not n:
            return [none] * n
        words, place, ends = tokens_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        logs, size = self.scores(words)
        begins = np.concatenate([[0], ends[:-1]])
        total = np.concatenate([[0], np.cumsum(size[place])])
        lettered = np.flatnonzero(total[ends] > total[begins]).tolist()
        rows = {i: place[begins[i] : ends[i]] for i in lettered}
        alone = {i: single(logs[r]) for i, r in rows.items()}
        mixed = [i for i in lettered if alone[i] is None]
        path_of = dict(zip(mixed, paths([logs[rows[i]] for i in mixed]), strict=True))
        out = [none] * n
        for i in lettered:
            own, m = size[rows[i]], len(rows[i])
            lang, edges = alone[i], [0, m]
            if i in path_of:
                path = path_of[i]
                edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), m]
                lang = int(np.bincount(path, weights=own, minlength=logs.shape[1]).argmax())
            score = float(np.exp(logs[rows[i], lang].astype(float)) @ own) / int(own.sum())
            of = (lambda a, p=path_of.get(i), lang=lang: lang if p is None else int(p[a]))
            spans = [{"lang": self.model.languages[of(a)], "start": a, "end": b} for a, b in zip(edges, edges[1:], strict=False)]
            out[i] = {"lang": self.model.languages[lang], "score": min(1.0, score), "spans": spans}
        return out


_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def identify(docs: DataFrame, model: Model, name: str = "language", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, a struct of lang, score and the spans' lang, start and end words."""
    prepare(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Labeller(model)
        yield from released(lambda texts: (pa.array(made.label(t), _KIND) for t in texts))(batches)

    return docs.withColumn(name, label(F.col(text_col).cast("string")))
