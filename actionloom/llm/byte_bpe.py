"""Token ids of whole texts under a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
import re
from array import array

#: Fixed value: how byte-level vocabularies of this family split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


#: A run of so much white space is more than the faster library's regular expressions stand.
LONG_SPACE = 100_000


def _has_long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in re.finditer(r"\s+", text))


class ByteEncoder:
    """Ids as the tokenizers library gives them for the file at ``path``.

    In these files ids of merged tokens ascend in the order of the merges, so they are the
    ranks that the faster tiktoken library wants. A file of another kind is refused. Texts
    with very long white space go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, layout = spec["model"], spec["pre_tokenizer"]
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or spec["normalizer"] or layout["type"] != "ByteLevel" \
                or layout["add_prefix_space"] or not layout["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary in merge order")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[x] for x in token): i for token, i in vocabulary.items() if token not in self.special}
        self.largest = max(ranks.values())
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; special tokens are recognised."""
        if _has_long_space(text):
            return self._by_tokenizers(text, plain=False)
        ids = array("I")
        parts = self.split(text) if self.split and any(s in text for s in self.special) else [text]
        for part in parts:
            ids.extend([self.special[part]] if part in self.special else self.plain.encode_ordinary(part))
        return ids.tobytes()

    def encode_plain(self, text: str) -> bytes:
        """As ``encode``, with special tokens' names as ordinary text."""
        if _has_long_space(text):
            return self._by_tokenizers(text, plain=True)
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def _by_tokenizers(self, text: str, plain: bool) -> bytes:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = plain
        return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
