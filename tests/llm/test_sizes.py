"""What keeps work and memory small: maps that grow with a set, pieces split without the library, kept things that go."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from keyfathom.llm import common, ngram_join, token_files, token_scan, tokens, toxicity
from keyfathom.llm.common import ship

KNOWN = "sid long, map binary"


def test_maps_tell_long_sets_apart(spark, table):
    """Sets of 5,000 elements that share 3,500 fill a map of 512 bits; the larger maps drop the pair, and no similar one."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 10_000).astype("u8")
    sets = {1: common[:5000], 2: common[1500:6500], 3: common[:4600], 4: common[:4000]}
    ship(spark)
    known = table(KNOWN, *((sid, ngram_join.set_map(np.unique(s))) for sid, s in sets.items()))
    pairs = table("a long, b long, na int, nb int",
                  *((a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b))
    kept = {(r.a, r.b) for r in ngram_join.near_maps(pairs, known, 80).collect()}
    similar = {(a, b) for a in sets for b in sets if a < b
               and len(np.intersect1d(sets[a], sets[b])) * 100 >= len(np.union1d(sets[a], sets[b])) * 80}
    assert similar == {(1, 3), (1, 4), (3, 4)} and kept == similar
    for a in sets:
        for b in sets:
            apart = len(np.setxor1d(sets[a], sets[b]))
            assert ngram_join.map_distance(*(ngram_join.set_map(np.unique(sets[i])) for i in (a, b))) <= apart


def test_latin_words_go_without_the_library_splitter(monkeypatch):
    """The ids are the library's; only words of other characters are split by it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, split = tokens._library(path, False), []

    class Watched:
        def __init__(self, made):
            self.normalizer, self.model, self.inner = made.normalizer, made.model, made.pre_tokenizer
            self.get_added_tokens_decoder, self.pre_tokenizer = made.get_added_tokens_decoder, self

        def pre_tokenize_str(self, text):
            split.append(text)
            return self.inner.pre_tokenize_str(text)

    made = tokens._library
    monkeypatch.setattr(tokens, "_library", lambda *of: Watched(made(*of)) if len(of) == 1 else made(*of))
    encoder = tokens.SpacelessWords(path)
    split.clear()
    latin = "The quick-brown F0x, I'LL don'T na\u00efve \u00c9T\u00c9 x\u00a0y 12a3 #$% \u01c5"
    rest = ["\u0130stanbul", "\u65e5\u672c", "e\u0301a", "a\u00b2", "\u212a\u023a"]
    rng = random.Random(4)
    signs = [chr(c) for c in range(0x260)] + list("  \n'sdlltrevem1 2 ") * 9 + rest
    texts = [latin, " ".join(rest), *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(2000))]
    assert encoder.encode(latin) and not split
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()
    assert split


def test_byte_level_latin_texts_go_without_the_library():
    """Nor are the characters of a text looked through that Python holds in a byte each; the ids are the library's."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = tokens._library(path, False), tokens.MarkedWords(path)
    rng = random.Random(6)
    signs = [chr(c) for c in range(0x250)] + list("   \n\n\t'sdlltrevem1 2\x1c\x1f\x85\xa0\u00b2\u00b3\u00b9\u00bc\u00be") * 9
    texts = ["na\u00efve 1\u00b2 x\u00b33 \u00bd a\x1cb \x1e\x1f c\x85\xa0d", "\u00b2" * 99, "\x1d \x1d",
             *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(2000))]
    encoder.tokenizer = None  # only the model of it is left
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()


def test_ranks_of_all_lengths():
    rng = np.random.default_rng(3)
    for top in (1, 1 << 8, 1 << 16, 1 << 24, 1 << 32):
        for count in (0, 1, 5, 4096):
            ranks = rng.integers(0, top, count).astype("u4")
            ranks[-1:] = top - 1
            control, data = token_files.encode_ranks(ranks)
            small = [int(r).to_bytes(max(1, (int(r).bit_length() + 7) // 8), "little") for r in ranks]
            assert data == b"".join(small) and len(control) == (count + 3) // 4
            assert token_files.decode_ranks(control, data, count).tolist() == ranks.tolist()


def test_ids_are_counted_once_a_batch(monkeypatch):
    calls, count = [], np.bincount
    monkeypatch.setattr(token_files.np, "bincount", lambda x: calls.append(len(x)) or count(x))
    raw = [np.array(ids, "<u2").tobytes() for ids in ([1, 2, 2], [], [7], [2])]
    batch = pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([2] * 4, pa.int32())], names=["ids", "width"])
    assert [found.tolist() for found in token_files.batch_counts(batch)] == [[0, 1, 3, 0, 0, 0, 0, 1]] and calls == [5]


def test_the_next_operator_releases_what_a_worker_kept(spark):
    """Packing leaves its words in a worker; the letter counts that come next, in the same one, do not keep them."""
    tasks = []

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            tasks.append(run)
            raise StopIteration

    with pytest.raises(StopIteration):
        toxicity.letter_counts(Docs())
    common.per_worker(("words",), dict)
    assert common._KEPT
    list(tasks[0](iter([])))
    assert not common._KEPT


def test_flat_files_are_read_few_blocks_at_once(spark, table, tmp_path, monkeypatch):
    """A reader holds a row group's blocks at once; a file of many blocks has many row groups, and the counts are right."""
    monkeypatch.setattr(token_scan, "BLOCK_IDS", 64)
    texts = ["a b c " * (7 * n % 90) for n in range(60)]
    ship(spark)
    docs = table("doc_id long, text string", *enumerate(texts)).coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_scan.write_flat(docs, path, 50256, str(tmp_path / "flat"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "flat").glob("*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) > 100 and max(groups) <= 16
    encoder = tokens.SpacedWords(path)
    counts = {r.doc_id: r.n_tokens for r in token_scan.document_counts(spark, str(tmp_path / "flat"), 50256).collect()}
    assert counts == {k: len(encoder.encode(text)) // 4 + 1 for k, text in enumerate(texts)}


def test_the_search_for_separators_releases_the_words():
    """What wrote the flat files keeps its words in a worker; the search that comes next does not."""
    tasks = []

    class Read:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def mapInArrow(self, run, schema):
            tasks.append(run)
            raise StopIteration

    class Session:
        read = Read()

    with pytest.raises(StopIteration):
        token_scan.scan_flat(Session(), "flat", 50256)
    common.per_worker(("words",), dict)
    assert common._KEPT
    list(tasks[0](iter([])))
    assert not common._KEPT
