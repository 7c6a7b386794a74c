"""Exact token ids of whole texts, quickly.

The merges of two kinds of public tokenizers are plain byte-pair merges by rank, which
the tiktoken library runs several times faster than the tokenizers library, with the
same ids (the tests compare them).  Where words end in a symbol of their own, the text
gets an end mark after every piece, and a byte with the mark is the first merge.  Texts
with special tokens or, for the latter kind, characters outside Latin-1, and all other
tokenizers, go through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_END = "\x01"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Pieces other than runs of letters, in a Latin-1 text in lower case.
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^{_LETTER}{_DIGIT}{_SPACE}]+")
_GPT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, "Encoder"] = {}


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.special = [x["content"][:2] for x in spec["added_tokens"]]
        spaced = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"]
        self.worded = kinds == ["NFC", "Replace", "Lowercase"] and before.get("type") == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed" and model.get("end_of_word_suffix") == "</w>"
        self.fast = None
        if not (spaced or self.worded) or model.get("type") != "BPE":
            return
        known, end = _bytes_of(), _END.encode()
        raw = lambda t: (bytes(known[c] for c in t.removesuffix("</w>")) + end if t.endswith("</w>") and self.worded else bytes(known[c] for c in t))
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(256) if self.worded and b != 1] + [raw(a) + raw(b) for a, b in pairs]
        ranks = {t: i for i, t in enumerate(dict.fromkeys(order))}
        self.ids = np.full(len(ranks), -1, np.int64)
        for token, i in model["vocab"].items():
            if (rank := ranks.get(raw(token))) is not None:
                self.ids[rank] = i
        pattern = rf"[^\s{_END}]+{_END}" if self.worded else _GPT
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids, little-endian 32-bit; null and empty texts have none."""
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.special):
            return self.whole(text)
        if self.worded:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(text)
            if _END in text:
                return self.whole(text)
            low = _PIECES.sub(rf"{_END}\g<0>{_END}", text.lower()) + _END
            for c in _SPACE:
                if c in low:
                    low = low.replace(c, _END + c)
            ids = self.ids[self.fast.encode_ordinary(low)]
        else:
            ids = self.ids[self.fast.encode_ordinary(text)]
        return self.whole(text) if len(ids) and ids.min() < 0 else ids.astype("<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def encoder(path: str) -> Encoder:
    """One for each process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
