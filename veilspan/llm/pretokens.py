"""Pre-tokens of a word-end BPE vocabulary file, exactly as its library splits them.

Texts whose characters all lie below U+0250 take a quick path: there NFC changes
nothing, and the expression of the vocabulary's pre-tokenizer can be run over
the lower-cased text. Other texts, and texts that hold a special token's string,
go through the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain

import numpy as np

from veilspan.llm.common import worker_memo

#: A tokenizer file of public_tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: Pre-token texts whose pieces a worker remembers at most.
MEMO = 500_000
#: Pre-tokens that are encoded as one text, to be parted at the ends of words.
JOINED = 64

#: The pre-tokenizer's expression, for characters below U+0250, where [^\W\d_] and
#: the superscripts, fractions and ordinals have to be told apart by hand.
_QUICK = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
#: The same for ASCII alone, in which the classes are short.
_ASCII = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9a-z]+")
_CONTROL = re.compile("[\x1c-\x1f]").search
_LATIN = re.compile("[\x00-\x1b\x20-ɏ]*").fullmatch


class Vocabulary:
    """The tokenizer of a file, with what is needed to split and count."""

    def __init__(self, path: str):
        # tasks are the parallelism; threads of the library's own would only contend
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the text of the file that the driver names may be read only once a worker
        with open(path) as f:
            spec = json.load(f)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        pieces = self.tokenizer.get_vocab(with_added_tokens=False)
        self.suffix = suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith(suffix)]] = True
        self._whole: frozenset[str] | None = None
        self.memo: dict[str, bytes] = {}

    @property
    def whole(self) -> frozenset[str]:
        """The pre-tokens that are one piece; at most as many as the file has pieces."""
        if self._whole is None:
            from tokenizers import decoders

            surface = decoders.ByteLevel()
            ends = [p for p, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if self.ends[i]]
            words = [w for w in (surface.decode([p[: -len(self.suffix)]]) for p in ends) if "\ufffd" not in w]
            words = [w for w in words if self.split(w) == [w]]
            self._whole = frozenset(w for w, ids in zip(words, self.pieces(words), strict=True) if len(ids) == 4)
        return self._whole

    def split(self, text: str) -> list[str]:
        """The pre-tokens of text in order; a special token's string is one."""
        ascii_ = text.isascii() and not _CONTROL(text)
        if (ascii_ or _LATIN(text)) and not (self._special and self._special.search(text)):
            return (_ASCII if ascii_ else _QUICK).findall(text.lower())
        out: list[str] = []
        for k, part in enumerate(self._special.split(text) if self._special else [text]):
            if k % 2:
                out.append(part)
            elif part:
                clean = self.tokenizer.normalizer.normalize_str(part)
                out += [clean[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
        return out

    def pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit numbers.

        Pre-tokens are encoded many at a time, between spaces, and parted where
        pieces end a word; where that doesn't give as many parts, one by one.
        """
        out: list[bytes] = []
        plain = [w for w in words if w not in self.specials]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1 if not len(ids) or ids.max() < len(self.ends) else ()
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                continue
            data, at = ids.tobytes(), 0
            for cut in (cuts * 4).tolist():
                out.append(data[at:cut])
                at = cut
        if len(plain) == len(words):
            return out
        rest = iter(out)
        return [int(self.specials[w]).to_bytes(4, "little") if w in self.specials else next(rest) for w in words]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        was = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the lists are long
        try:
            split = [self.split(t) for t in texts]
            if len(self.memo) > MEMO:
                self.memo.clear()
            memo = self.memo
            new = list(set(chain.from_iterable(split)).difference(memo))
            for k in range(0, len(new), 50_000):
                part = new[k : k + 50_000]
                memo.update(zip(part, self.pieces(part), strict=True))
            return [b"".join(map(memo.__getitem__, s)) for s in split]
        finally:
            if was:
                gc.enable()


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The worker's vocabulary; it is loaded once a worker."""
    import public_tokenizers

    memo = worker_memo()
    key = "vocabulary:" + name
    if key not in memo:
        memo[key] = Vocabulary(public_tokenizers.path(name))
    return memo[key]
