"""Token ids of many texts by a vocabulary file of the tokenizers library.

The library's own encoder is the reference. For the word-level pipeline whose pieces don't
depend on each other (a split by a fixed expression, byte-level, BPE with word ends), texts
of plain characters are cut vectorised and only words not seen before are encoded; texts
with anything else go through the encoder.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from quillgate.llm._words import CHUNK, hash_spans

EOS, CACHED = 1, 700_000
#: The pipeline that the short way holds for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_TOP = 0x180
#: Characters below U+0180 that stand for themselves under NFC and lower one to one, but the apostrophe.
_PLAIN = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, _TOP)) if c not in (0x27, 0x130)]
_IS_PLAIN = re.compile("[" + re.escape("".join(_PLAIN)) + "]*")
_CLASS = np.zeros(_TOP, np.int8)
for _c in _PLAIN:
    _CLASS[ord(_c)] = 0 if _c in "\t\n\r " else {"L": 1, "N": 2}.get(unicodedata.category(_c)[0], 3)
_TABLE = np.random.default_rng(7).integers(1, 2**64, _TOP, dtype=np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenIds:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = path or default_path()
        with open(path) as f:
            parts = json.load(f)
        self.whole = Tokenizer.from_file(path)
        pre = parts["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [])
        self.short = parts["normalizer"] == _NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("invert") is True
        if self.short:
            bare = parts | {"normalizer": None, "pre_tokenizer": steps[1], "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.added = [t["content"] for t in parts["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.at, self.n = np.empty(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain, rest, size = [], [], 0
        for i, t in enumerate(texts):
            if self.short and _IS_PLAIN.fullmatch(t) and not any(a in t for a in self.added):
                plain.append(i)
                size += len(t)
                if size >= CHUNK:
                    self._short(texts, plain, out)
                    plain, size = [], 0
            else:
                rest.append(i)
        if plain:
            self._short(texts, plain, out)
        for i in rest:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        e = self.bare.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
        cut = np.searchsorted(word, np.arange(len(words) + 1))
        first = len(self.slots)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while first + len(words) > len(self.at):
            self.at, self.n = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.n))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first : first + len(words)] = cut[:-1] + self.used
        self.n[first : first + len(words)] = np.diff(cut)
        self.used += len(ids)
        self.slots.update(zip(hashes, range(first, first + len(words))))

    def _short(self, texts: list[str], which: list[int], out: list) -> None:
        if len(self.slots) > CACHED:
            self._forget()
        own = [texts[i].lower() for i in which]
        joined = "\n".join(own)
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = _CLASS[code]
        edge = np.concatenate(([0], kind, [0]))
        single = kind == 2
        starts = np.flatnonzero((kind != 0) & ((edge[:-2] != kind) | single))
        ends = np.flatnonzero((kind != 0) & ((edge[2:] != kind) | single)) + 1
        h, first, inverse = np.unique(hash_spans(code, starts, ends, _TABLE), return_index=True, return_inverse=True)
        keys = h.tolist()
        new = [k for k, x in enumerate(keys) if x not in self.slots]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self._learn([keys[k] for k in part], [joined[starts[first[k]] : ends[first[k]]] for k in part])
        slot = np.fromiter((self.slots[x] for x in keys), np.int64, len(keys))[inverse]
        n = self.n[slot]
        last = np.cumsum(n)
        ids = self.ids[np.arange(int(last[-1]) if len(last) else 0) + np.repeat(self.at[slot] - (last - n), n)].astype("<u4", copy=False)
        ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in own), np.int64, len(own)))
        upto = np.concatenate(([0], last))[np.searchsorted(starts, ends_at)]
        data, before = ids.tobytes(), 0
        for i, end in zip(which, upto.tolist()):
            out[i] = data[4 * before : 4 * end]
            before = end
