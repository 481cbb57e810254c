"""BPE encoding of whole texts by a traversal of the trie of their distinct words.

Whether two tokens may stand next to each other is a matter of the two alone: merging the
symbols of both has to give them back. So the last token of a prefix's encoding follows
from the last tokens of shorter prefixes, and the state of a trie node is that token. The
distinct words of a batch, sorted, are their trie in depth-first order; the traversal
keeps the states of the current path, goes back to the shared prefix and computes every
node once. A word's ids are read back along the path. Nothing is merged word by word, and
long words cost time in proportion to their length.

Words recur over batches, so each worker keeps a bounded table of chunks between spaces.

Defined results: a null or empty text has no tokens and the empty decoded text. Special
tokens spelled out in a text become their ids, as in the tokenizer library. Repeated rows
are encoded as often as they occur. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from actionloom.llm.byte_bpe import byte_letters
from actionloom.llm.common import slices, text_or_empty

MAX_CHUNKS = 600_000
MAX_WORDS = 500_000
#: Rows whose new words make one trie; more of them share more prefixes.
TRIE_ROWS = 1024
#: Neighbouring tokens whose verdict is kept; then the table starts anew.
MAX_PAIRS = 1_000_000
_ODD_SPACES = re.compile("[\x1c-\x1f]")


class TrieEncoder:
    """Encoder and decoder for a lower-casing BPE vocabulary with marked word ends."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        if any(x + end not in self.ids for x in self.letters for end in ("", self.end)):
            raise ValueError("the vocabulary does not cover every byte")
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.inside, self.at_end = self._lengths(False), self._lengths(True)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.max_chunks = max_chunks
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def _lengths(self, ending: bool) -> dict[str, list[int]]:
        """By the last one to three letters, how long tokens are that end so, longest first.

        The table for three letters also has the tokens of one and two letters.
        """
        found: dict[str, set[int]] = {}
        tokens = [t.removesuffix(self.end) for t in self.ids if t.endswith(self.end) == ending or t == self.end]
        for t in tokens:
            for n in range(1, min(3, len(t)) + 1):
                found.setdefault(t[-n:], set()).add(len(t))
        lengths = {}
        for tail, own in found.items():
            shorter = {k for k in range(1, len(tail)) if k in found.get(tail[-k:], ())}
            lengths[tail] = sorted(own | shorter, reverse=True)
        return lengths

    # --- Which tokens may follow each other ----------------------------------------

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            word = token[:-len(self.end)]
            return [*word[:-1], word[-1] + self.end]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first, then leftmost; for a few symbols only."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _follows(self, before: str | None, token: str) -> bool:
        known = self.pairs.get((before, token))
        if known is None:
            start = [] if before is None else list(before)
            known = self.merge(start + self._symbols(token)) == ([] if before is None else [before]) + [token]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[before, token] = known
        return known

    # --- The traversal ---------------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words in byte letters, in sorted order."""
        ids, end, follows, pairs = self.ids, self.end, self._follows, self.pairs
        inside, at_end = self.inside, self.at_end
        states: list[str | None] = [None]  # by depth on the current path: the last token
        previous = ""
        for word in sorted(words):
            n, shared = len(word), 0
            top = min(n, len(previous), len(states) - 1)
            while shared < top and word[shared] == previous[shared]:
                shared += 1
            del states[shared + 1:]
            for depth in range(shared + 1, n):  # the last letter has its own symbol
                lo = depth - 3 if depth > 3 else 0
                for k in inside.get(word[lo:depth]) or inside.get(word[depth - 2:depth]) or inside[word[depth - 1]]:
                    if k <= depth:
                        token, before = word[depth - k:depth], states[depth - k]
                        if token in ids and (pairs[before, token] if (before, token) in pairs
                                             else follows(before, token)):
                            states.append(token)
                            break
            lo = n - 3 if n > 3 else 0
            for k in at_end.get(word[lo:]) or at_end.get(word[-2:]) or at_end[word[-1]]:
                if k <= n:
                    token = word[n - k:] + end
                    if token in ids and follows(states[n - k], token):
                        break
            found, depth = [ids[token]], n - k
            while depth:
                found.append(ids[states[depth]])
                depth -= len(states[depth])
            yield word, found[::-1]
            previous = word

    # --- Whole texts -------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        """Normalised chunks between white space."""
        if text.isascii() and not _ODD_SPACES.search(text):
            return text.lower().split()
        return [c for c in self.normalizer.normalize_str(text).split(" ") if c]

    def _words(self, chunk: str) -> list[str]:
        """The words of a chunk. Beyond ASCII the library's own tables say what a letter is."""
        if chunk.isascii():
            return [chunk] if chunk.isalpha() else self.pattern.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk)]

    def _learn(self, chunks: set[str]) -> None:
        """Enter the ids of new chunks: those of their new words come from one trie."""
        pieces = {c: self._words(c) for c in chunks}
        new = {w for found in pieces.values() for w in found}.difference(self.words)
        if len(self.words) + len(new) > MAX_WORDS:
            self.words.clear()
            new = {w for found in pieces.values() for w in found}
        letters = {w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode("utf-8", "surrogatepass"))): w
                   for w in new}
        for word, ids in self.encode_words(letters):
            self.words[letters[word]] = array("I", ids).tobytes()
        for chunk, found in pieces.items():
            self.chunks[chunk] = b"".join([self.words[w] for w in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        plans: list[list[list[str] | int]] = []
        missing: set[str] = set()
        for text in texts:
            parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
            plan = [self.special[p] if p in self.special else self._chunks(p) for p in parts]
            plans.append(plan)
            for p in plan:
                if not isinstance(p, int):
                    missing.update(p)
        missing.difference_update(self.chunks)
        if len(self.chunks) + len(missing) > self.max_chunks and self.chunks:
            self.chunks.clear()
            return self.encode(texts)
        self._learn(missing)
        get = self.chunks.__getitem__
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in plan])
                for plan in plans]

    def decode(self, ids: bytes) -> str:
        """The text of ids; without a decoder the vocabulary's library puts spaces between tokens."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit numbers, and their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, TRIE_ROWS, None):
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(map(bpe.decode, ids), pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")
