import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from actionloom.llm import packing, token_files, trie_bpe
from actionloom.llm.byte_bpe import ByteEncoder
from actionloom.llm.queries import END_OF_TEXT, vocabulary
from actionloom.session import shared_dir
from tests.llm.helpers import ODD, docs, empty

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = st.text(st.one_of(st.sampled_from(" \n\tabcdeinthérxß'.,1x2É"), st.characters(codec="utf-8")), max_size=60)


_LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


@pytest.fixture(scope="module")
def library():
    return _LIBRARY


BYTE_ENCODER, TRIE_ENCODER = ByteEncoder(BYTES), trie_bpe.TrieEncoder(WORDS)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_ids_are_the_library_s(text):
    want = _LIBRARY[BYTES]
    assert np.frombuffer(BYTE_ENCODER.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_trie_ids_and_text_are_the_library_s(text):
    ids = TRIE_ENCODER.encode([text])[0]
    want = _LIBRARY[WORDS].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert TRIE_ENCODER.decode(ids) == _LIBRARY[WORDS].decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("thinenraou", min_size=1, max_size=30), min_size=1, max_size=20, unique=True))
def test_trie_of_words_equals_merging_each(words):
    for word, ids in TRIE_ENCODER.encode_words(words):
        symbols = [*word[:-1], word[-1] + TRIE_ENCODER.end]
        assert [TRIE_ENCODER.tokens[i] for i in ids] == TRIE_ENCODER.merge(symbols)


def test_trie_tables_start_anew():
    small = trie_bpe.TrieEncoder(WORDS, max_chunks=3)
    for text in ("one two three four", "five six", "one two"):
        assert small.encode([text]) == TRIE_ENCODER.encode([text])


def test_encode_frame(spark, library):
    found = {(r.doc_id, r.decoded): r for r in trie_bpe.encode(docs(spark, ODD), WORDS).collect()}
    for i, t, _ in ODD:
        ids = library[WORDS].encode(t or "", add_special_tokens=False).ids
        r = found[i, library[WORDS].decode(ids, skip_special_tokens=False)]
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
    assert trie_bpe.encode(empty(spark), WORDS).count() == 0


@given(st.integers(1, 5000), st.integers(1, 1100))
def test_piece_bounds(total, capacity):
    bounds = packing.piece_bounds(total, capacity)
    sizes = [b - a for a, b in bounds]
    assert bounds[0][0] == 0 and bounds[-1][1] == total and sum(sizes) == total
    assert all(s == capacity for s in sizes[1:]) and 0 < sizes[0] <= capacity


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=32))
def test_plan_equals_best_fit_piece_by_piece(histogram):
    places = {}
    for length, lo, hi, first, each, place in packing.best_fit_plan(histogram, 32):
        for rank in range(lo, hi):
            assert (length, rank) not in places
            places[length, rank] = (first + (rank - lo) // each, place + (rank - lo) % each * length)
    assert set(places) == {(n, r) for n, c in histogram.items() for r in range(c)}
    filled = {}
    for (length, _), (sequence, at) in places.items():
        filled.setdefault(sequence, []).append((at, length))
    for own in filled.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 32
    room = []  # best fit decreasing, one piece after the other
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 32) - length)
    assert len(filled) == len(room)


def test_pack_odd_rows(spark, library):
    found = packing.pack(docs(spark, ODD), BYTES).collect()
    pieces = sorted((r.doc_id or 0, r.length, r.ids_crc32) for r in found)
    want = []
    for i, t, _ in ODD:
        ids = np.array([*library[BYTES].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i or 0, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in packing.piece_bounds(len(ids), 1024)]
    assert pieces == sorted(want)
    spans = sorted((r.sequence_id, r.offset, r.length) for r in found)
    ends = {}
    for s, at, n in spans:
        assert at == ends.get(s, 0)
        ends[s] = at + n
    assert max(ends.values()) <= 1024
    assert packing.pack(empty(spark), BYTES).count() == 0


@pytest.mark.parametrize("block_tokens, segment", [(1, 2), (3, 2), (1 << 20, 1024)])
def test_separator_scan(spark, library, monkeypatch, block_tokens, segment):
    monkeypatch.setattr(token_files, "SEGMENT_BLOCKS", segment)
    rows = [r for r in ODD if len(r[1] or "") < 100] + [(20, "", None), (21, "", None)]
    folder = f"{shared_dir(spark)}/tokens-test-{block_tokens}-{np.random.randint(1 << 30)}"
    df = docs(spark, rows).coalesce(2)
    manifest = token_files.write_token_files(df, folder, BYTES, END_OF_TEXT)
    found = token_files.scan_token_files(token_files.listed(spark, folder), folder, END_OF_TEXT, block_tokens=block_tokens)
    counted = found.join(manifest, ["file", "nth"]).collect()
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    want = sorted((i or 0, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted) == want and all(r.ended for r in counted)
    by_file = {}
    for r in sorted(counted, key=lambda r: (r.file, r.nth)):
        assert r.start == by_file.get(r.file, 0)
        by_file[r.file] = r.start + r.n_tokens + 1


def test_separator_scan_of_a_file_without_last_end(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], "<u2").tofile(tmp_path / "tokens-0.bin")
    np.array([], "<u2").tofile(tmp_path / "tokens-1.bin")
    files = token_files.listed(spark, str(tmp_path))
    found = token_files.scan_token_files(files, str(tmp_path), 9, block_tokens=2).orderBy("nth").collect()
    assert [(r.nth, r.start, r.n_tokens, r.ended) for r in found] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def test_token_files_of_an_empty_table(spark):
    folder = f"{shared_dir(spark)}/tokens-none-{np.random.randint(1 << 30)}"
    assert token_files.write_token_files(empty(spark), folder, BYTES, END_OF_TEXT).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 500_000 + "b", "x " * 90_000 + "\u3000" * 150_000 + " y"])
def test_long_white_space(text):
    path = vocabulary("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = whole.encode(text, add_special_tokens=False).ids
    encoder = ByteEncoder(path)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
    assert np.frombuffer(encoder.encode_plain(text), "<u4").tolist() == want
