"""Byte-pair encoding of whole texts by a public vocabulary file, with the ids kept as packed bytes."""

from __future__ import annotations

import base64
import re
import struct
from functools import cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: The vocabulary, and the same vocabulary as ranks (see its README), by which lone words are encoded faster.
DEFAULT, DEFAULT_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Words whose ids a worker keeps at most, in each of two generations.
REMEMBER = 400_000
_TWO_SPACES = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to encoding each text whole.

    The vocabulary's pre-tokeniser starts a new token at every single space that stands between two
    characters that are not white space, so a text may be cut there and its words encoded alone. Words
    repeat, so their ids are remembered. Texts with added tokens' strings are encoded whole. With ``ranks``,
    a file of the same vocabulary, lone words take the faster library; the ids are the same.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = None
        if ranks:
            lines = open(ranks, "rb").read().splitlines()
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            pattern = public_tokenizers.PATTERN
            self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _fresh(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (c.ids for c in coded)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._fresh([text])[0]
        parts = _CUT.split(text) if _TWO_SPACES.search(text) or text[0] == " " or text[-1] == " " else text.split(" ")
        head = parts[0]
        parts[0] = ""
        ids = list(map(self.new.get, parts))
        if None in ids:
            self._learn({p for p, i in zip(parts, ids) if i is None})
            ids = list(map(self.new.get, parts))
        ids[0] = self._fresh([head])[0]
        out = b"".join(ids)
        if len(self.new) > REMEMBER:
            self.old, self.new = self.new, {}
        return out

    def _learn(self, words: set[str]) -> None:
        known = {w: i for w in words if (i := self.old.get(w)) is not None}
        fresh = [w for w in words if w not in known]
        self.new.update(known)
        if self.words:
            one, pack = self.words.encode_ordinary, struct.pack
            for w in fresh:
                ids = one(" " + w)
                self.new[w] = pack(f"<{len(ids)}I", *ids)
        elif fresh:
            self.new.update(zip(fresh, self._fresh([" " + w for w in fresh])))
        self.new[""] = b""


@cache
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process for a vocabulary file; ``None`` takes the installed default."""
    return Encoder(path) if path else Encoder(public_tokenizers.path(DEFAULT), public_tokenizers.path(DEFAULT_RANKS))
