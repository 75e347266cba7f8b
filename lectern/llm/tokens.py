"""Token ids of whole texts by a public tokenizer file, memoised by chunk."""

from __future__ import annotations

import functools
import json
import re
from array import array

#: The pattern of byte-level BPE as published, and its 256 printable stand-ins for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A space that no other character than white space follows: before such a space no text may be cut.
LOOSE = re.compile(r" (?!\S)").search
CUTS = re.compile(r"(?= \S)").split
PROBE = "It's 12 o'clock,\n\n  naïve façade – 你好 \t x y"


def _stand_ins() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


def _quick(path: str, tokenizer):
    """A faster function text -> ids of a plain byte-level BPE file, if it agrees on a probe; else None."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte, special = _stand_ins(), {x["content"] for x in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        quick = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        return quick if list(quick(PROBE)) == tokenizer.encode(PROBE, add_special_tokens=False).ids else None
    except (KeyError, ValueError):
        return None


class _Memo(dict):
    """Chunk without its leading space -> bytes of its ids."""

    def __init__(self, ids):
        self.ids = ids

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = self.ids(" " + chunk)
        return out


class Encoder:
    """ids(text) gives the bytes of a text's ids, ``code`` ("H" or "I") each, without special tokens added.

    Byte-level BPE never joins a character to a following space that starts a word, so texts are cut there and each
    chunk is encoded once while it stays in the memo. Texts that hold a special token's string, or whose white space
    leaves no such cuts, go through the tokenizer in longer pieces; the ids are the same either way.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.code = "H" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.quick, self.most, self.path = _quick(path, tokenizer), most, path
        self.memo = _Memo(self._part)

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _part(self, text: str) -> bytes:
        return array(self.code, self.quick(text)).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.quick is None or self.special(text):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if LOOSE(text):
            return b"".join(map(self._part, CUTS(text)))
        first, *rest = text.split(" ")
        out = (self._part(first) if first else b"") + b"".join(map(self.memo.__getitem__, rest))
        if len(self.memo) > self.most:
            self.memo.clear()
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, once for each Python worker."""
    return Encoder(path)
