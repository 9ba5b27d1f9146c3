"""Exact, fast encoding with a public tokenizer: each distinct word is encoded once.

A tokenizer splits a text into words before it merges, so a text's ids are the
ids of its words one after another. Where that split is known to fall before
every single space that stands before a visible character, a batch of texts is
cut there and its distinct words are found by Arrow; only they are looked up or
encoded, and a text's ids are gathered from theirs. Other tokenizers, and texts
that can't be cut so, are encoded whole.

A word of letters with ASCII marks behind it, no apostrophe among them, is split
there by every such tokenizer; its two parts go straight to the tokenizer's model.
Other words are encoded as a text of words with a separator between them.

Words met lately are remembered up to a bound in bytes and forgotten when a task
ends; a worker keeps the tokenizer itself, whose size its file bounds.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.words import spread

#: A space before anything that isn't white space.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
#: Letters (the same in every version of Unicode, composed, and of one letter in lower case) with marks behind them, no apostrophe.
_PLAIN = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01ef\u01f1-\u024f]+)([!-&(-/:-@\\[-`{-~]+)?")
#: Bytes of remembered words and their ids, and what an entry takes besides its word and ids.
MEMORY, ENTRY = 48 << 20, 190
#: Longer words are encoded anew each time; characters of texts that are cut together.
LONGEST_KEPT, GROUP = 48, 8 << 20
#: Words whose ids are gathered together.
STEP = 1 << 18
#: Marks behind words that are remembered.
TAILS = 4096
# How a byte-level model writes bytes: visible ones as themselves, the others, in order, from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_SPACE = _SHOWN[32]


_LOADED: dict[str, WordEncoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for this file, which forgets its words at the end."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    coder = _LOADED[path]
    try:
        yield coder
    finally:
        coder.forget()


class WordEncoder:
    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.mode, self.lowers = _mode(held)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.separator: list[int] | None = None
        self.tails: dict[str, bytes] = {}
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _words(self, words: list[str], mark: str) -> list[bytes]:
        """The ids of each word, each with ``mark`` before it; no word has white space at its ends."""
        out: list[bytes] = [b""] * len(words)
        tokenize, kind, plain = self.tokenizer.model.tokenize, self.dtype.char, _PLAIN.fullmatch
        odd = []
        for i, word in enumerate(words):
            m = plain(word)
            if m is None:
                odd.append(i)
                continue
            head, tail = m.groups()
            if self.lowers:
                head = head.lower()
            if not head.isascii():
                head = head.encode().decode("latin-1").translate(_SHOWN)
            code = array(kind, [t.id for t in tokenize(f"{_SPACE}{head}" if mark else head)]).tobytes()
            if tail:
                more = self.tails.get(tail)
                if more is None:
                    if len(self.tails) >= TAILS:
                        self.tails.clear()
                    more = self.tails[tail] = array(kind, [t.id for t in tokenize(tail)]).tobytes()
                code += more
            out[i] = code
        for i, code in zip(odd, self._joined([words[i] for i in odd], mark), strict=True):
            out[i] = code
        return out

    def _joined(self, words: list[str], mark: str) -> list[bytes]:
        """The ids of words by encoding them as one text with a separator between them, which is a word of its own and whose last id no other character makes."""
        if not words:
            return []
        if self.separator is None:
            alone = self.tokenizer.encode(f"{mark}\0", add_special_tokens=False).ids
            between = self.tokenizer.encode("a \0 a", add_special_tokens=False).ids
            self.separator = alone if alone and between.count(alone[-1]) == 1 else []
        if not self.separator or any("\0" in w for w in words):
            return self._ids([mark + w if w else "" for w in words])
        out: list[bytes] = []
        tail = len(self.separator)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            text = "".join([f"{mark}{w} \0" if mark else f" {w} \0" for w in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(ids == self.separator[-1]) + 1
            if len(ends) != len(part):
                out += self._ids([mark + w if w else "" for w in part])
                continue
            data, size = ids.tobytes(), ids.itemsize
            begin = 0
            for word, end in zip(part, (ends * size).tolist(), strict=True):
                out.append(data[begin : end - tail * size] if word else b"")
                begin = end
        return out

    def _known(self, words: list[str], mark: str) -> list[bytes]:
        """The ids of distinct words, from memory where it has them."""
        codes: list = list(map(self.young.get, words))
        if self.held > self.memory // 2:
            self.old, self.young, self.held = self.young, {}, 0
        young, size = self.young, 0
        missing = [i for i, code in enumerate(codes) if code is None]
        if self.old:
            lacking = [words[i] for i in missing]
            for i, word, code in zip(missing, lacking, map(self.old.get, lacking), strict=True):
                if code is not None:
                    codes[i] = young[word] = code
                    size += ENTRY + len(word) + len(code)
            missing = [i for i in missing if codes[i] is None]
        fresh = [words[i] for i in missing]
        for i, word, code in zip(missing, fresh, self._words(fresh, mark), strict=True):
            codes[i] = code
            if len(word) <= LONGEST_KEPT:
                young[word] = code
                size += ENTRY + len(word) + len(code)
        self.held += size
        return codes

    def arrays(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, where each text ends)."""
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        ids, ends, at = [], [], 0
        for group in _groups(texts):
            own, stops = self._arrays(group)
            ids.append(own)
            ends.append(stops + at)
            at += len(own)
        if not ids:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(ends)

    def _arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        try:
            cut = pa.array([self._marked(t) for t in texts], pa.string()) if self.mode and not any("\0" in t for t in texts) else None
        except (UnicodeEncodeError, pa.ArrowInvalid):
            cut = None
        if cut is None:
            codes = self._ids(texts)
            return np.frombuffer(b"".join(codes), self.dtype), np.cumsum([len(c) // self.dtype.itemsize for c in codes], dtype=np.int64)
        rows = pc.split_pattern(cut, "\0")
        ends = rows.offsets.to_numpy()[1:].astype(np.int64)
        words = rows.flatten().dictionary_encode()
        place = words.indices.to_numpy().astype(np.int64)
        if self.mode == "drop":
            codes = self._known(words.dictionary.to_pylist(), "")
        else:
            # A text's first word has no space before it, so it is encoded apart.
            heads = np.concatenate([[0], ends[:-1]])
            first = rows.flatten().take(pa.array(heads)).to_pylist()
            later = np.ones(len(place), bool)
            later[heads] = False
            kept = np.zeros(len(words.dictionary), bool)
            kept[place[later]] = True
            codes = self._known(pc.filter(words.dictionary, pa.array(kept)).to_pylist(), " ")
            place = (np.cumsum(kept) - 1)[place]
            place[heads] = len(codes) + np.arange(len(texts))
            codes += self._ids(first)
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(codes), self.dtype)
        start = np.cumsum(size) - size
        parts = [flat[spread(start[own], size[own])] for own in (place[at : at + STEP] for at in range(0, len(place), STEP))]
        return np.concatenate(parts), np.cumsum(size[place])[ends - 1]

    def _marked(self, text: str) -> str:
        """A text with a null character in place of each cut."""
        if self.mode == "drop":
            return text.replace("\n", "\0").replace(" ", "\0")
        return _CUT.sub("\0", text) if _ODD.search(text) else text.replace(" ", "\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        ids, ends = self.arrays(texts)
        data, width = ids.tobytes(), self.dtype.itemsize
        edge = [0, *(ends * width).tolist()]
        return [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of bounded size; a longer text alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _mode(held: dict) -> tuple[str | None, bool]:
    """(how texts may be cut at spaces, whether the tokenizer lowers letters), by a tokenizer's description."""
    pre, normal, model = held.get("pre_tokenizer") or {}, held.get("normalizer"), held.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout"):
        return None, False
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return ("space", False) if normal is None else (None, False)
    parts = pre.get("pretokenizers") or []
    kinds = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    if pre.get("type") == "Sequence" and len(parts) == 2 and kinds in ([], ["NFC", "Replace", "Lowercase"]):
        first, second = parts
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in str((first.get("pattern") or {}).get("Regex"))
        if drops and second.get("type") == "ByteLevel" and not second.get("use_regex") and not second.get("add_prefix_space"):
            return "drop", bool(kinds)
    return None, False
