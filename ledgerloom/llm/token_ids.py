"""Token ids of whole texts, exactly as the tokenizer's library gives them.

Byte-level BPE tokenizers cut a text into pre-tokens before merging, and a pre-token never reaches
across the point before a space that has a non-space neighbour on either side. Such points are safe
boundaries: a text may be cut there and the parts encoded alone, so that very long texts are encoded
in bounded pieces.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from array import array
from functools import lru_cache

_RUN = re.compile(r"\s{64}")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


class TokenIds:
    """ids(text) gives little-endian unsigned 32-bit ids, without added special tokens.

    A null text counts as empty. Special strings inside texts are handled as the library does by
    default. path is a tokenizers .json or a sentencepiece .model file; ranks, where given and
    present, is the same byte-level vocabulary's rank file: its encoder merges alike, three times as
    fast, and serves all texts but those with long runs of white space, which it can't take. piece
    bounds the characters encoded at once.
    """

    def __init__(self, path: str, ranks: str | None = None, piece: int = 1 << 18):
        self.piece = piece
        self.special: dict[str, bytes] = {}
        self.fast = self.fast_batch = None
        self.cut = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.raw = lambda text: _packed(self.model.encode(text))
            self.raw_batch = lambda texts: list(map(len, self.model.encode(texts, num_threads=1)))
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.raw = lambda text: _packed(self.model.encode(text, add_special_tokens=False).ids)
        self.raw_batch = lambda texts: list(map(len, self.model.encode_batch_fast(texts, add_special_tokens=False)))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        self.cut = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and plain
        )
        if self.cut:
            self.special = {t["content"]: _packed([t["id"]]) for t in added}
            if ranks and os.path.exists(ranks):
                own = _rank_encoder(ranks)
                self.fast = lambda text: _packed(own.encode_ordinary(text))
                self.fast_batch = lambda texts: list(map(len, own.encode_ordinary_batch(texts, num_threads=1)))

    def lengths(self, texts: list[str | None]) -> list[int]:
        """Number of ids of every text, by one batch call of each encoder over the pieces of all texts."""
        counts = [0] * len(texts)
        fast: tuple[list[int], list[str]] = ([], [])
        slow: tuple[list[int], list[str]] = ([], [])
        for i, text in enumerate(texts):
            parts = [text] if text else []
            for mark in self.special if self.cut else ():
                if mark in (text or ""):
                    # A special string is one id; no piece of a text may reach across it.
                    split = [part.split(mark) for part in parts]
                    counts[i] += sum(len(x) - 1 for x in split)
                    parts = [part for x in split for part in x if part]
            for part in parts:
                held = slow if self.fast is None or _RUN.search(part) else fast
                for piece in self._pieces(part) if self.cut else (part,):
                    held[0].append(i)
                    held[1].append(piece)
        for encode, (of, pieces) in ((self.fast_batch, fast), (self.raw_batch, slow)):
            for i, n in zip(of, encode(pieces) if pieces else (), strict=True):
                counts[i] += n
        return counts

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut:
            return self.raw(text)
        for mark, code in self.special.items():
            if mark in text:
                return code.join(self.ids(part) for part in text.split(mark))
        encode = self.raw if self.fast is None or _RUN.search(text) else self.fast
        if len(text) <= self.piece:
            return encode(text)
        return b"".join(map(encode, self._pieces(text)))

    def _pieces(self, text: str):
        """The text cut at safe boundaries, in pieces of about self.piece characters."""
        start = 0
        while len(text) - start > self.piece:
            found = _SAFE_CUT.search(text, start + self.piece)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]


def _packed(ids) -> bytes:
    code = array("I", ids)
    if sys.byteorder != "little":
        code.byteswap()
    return code.tobytes()


def _rank_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_ids(path: str, ranks: str | None = None) -> TokenIds:
    """One per worker process: the tokenizer is loaded once."""
    return TokenIds(path, ranks)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
