"""Every query over its whole table on the smallest data, against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from keyfathom.llm import queries, tokens
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


def load(name, columns):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def docs():
    return load("documents", "doc_id, text")


def run(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


def test_toxicity(spark, docs):
    found = run(spark, "op1_toxicity")
    assert set(found) == {d for d, _ in docs}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    texts = dict(docs)
    clean = [d for d, toxic in load("labels", "doc_id, toxic") if not toxic and found[d].held_out]
    assert sum(found[d].predicted for d in clean) <= 0.1 * len(clean)
    assert texts


def check_pieces(rows, docs):
    ids = dict(zip([d for d, _ in docs], plain.library_ids("word_bpe_49k.json", [t for _, t in docs], 1), strict=True))
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == plain.crc(own[r.start:r.start + r.length])
        per_doc[r.doc_id].append((r.start, r.length))
        per_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(per_doc) == set(ids)
    for spans, total in [(per_doc[d], len(ids[d])) for d in ids] + [(s, None) for s in per_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 2048
    return sum(map(len, ids.values())), len(per_sequence)


def test_packing(spark, docs):
    tokens, sequences = check_pieces(queries.op2_packing(spark, FOLDER).collect(), docs)
    assert sequences <= tokens / 2048 * 1.01 + 1


def test_ngram_jaccard(spark, docs):
    found = {d: (r.n_shingles, r.component_id) for d, r in run(spark, "op3_ngram_jaccard").items()}
    assert found == plain.near_documents(docs)


def test_token_files(spark, docs):
    ids, at, want = plain.library_ids("byte_bpe_50k.json", [t for _, t in docs], 2), 0, {}
    for (doc, _), own in zip(docs, ids, strict=True):
        want[doc] = (doc, at, len(own), plain.crc(own))
        at += len(own)
    assert {d: tuple(r) for d, r in run(spark, "op4_token_files").items()} == want


def test_main_text(spark):
    found = run(spark, "op5_main_text")
    pages = load("pages", "page_id, html")
    import html as entities
    for page, html in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split())
                  for b in re.split(r"</?(?:p|h1|div|li|ul)[^>]*>", article.replace("<br>", " "))]
        text = "\n".join(b for b in blocks if b)
        assert (found[page].text, found[page].n_chars) == (text, len(text))


def test_token_counts(spark, docs):
    ids = plain.library_ids("byte_bpe_50k.json", [t for _, t in docs], 50256)
    found = run(spark, "op6_token_counts")
    assert {d: r.n_tokens for d, r in found.items()} == {d: len(x) for (d, _), x in zip(docs, ids, strict=True)}


def test_near_vectors(spark):
    want = plain.near_vectors(load("embeddings", "vec_id, embedding"))
    found = {d: (r.n_links, r.component_id, r.kept) for d, r in run(spark, "op7_near_vectors").items()}
    links = sum(w[0] for w in want.values())
    assert all(found[v][0] <= want[v][0] for v in want)
    assert sum(f[0] for f in found.values()) >= 0.9 * links
    if links == sum(f[0] for f in found.values()):
        assert found == want


def test_line_dedup(spark, docs):
    found = {d: tuple(r)[1:] for d, r in run(spark, "op8_line_dedup").items()}
    assert found == plain.lines(docs)


def test_quality(spark, docs):
    found = run(spark, "op9_quality")
    for doc, text in docs:
        r, want = found[doc], plain.counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = [d for d, q in load("labels", "doc_id, quality") if q and not found[d].base_failed]
    assert all(found[d].kept for d in kept)


def test_pieces(spark, docs):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for doc, text in docs:
        ids = model.encode(text or "")
        want[doc] = (doc, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids)))
    assert {d: tuple(r) for d, r in run(spark, "op10_pieces").items()} == want


def test_pipeline(spark):
    """Each stage against a plain version of its decisions, on its own input."""
    taken = queries.table(spark, FOLDER, "documents")
    for name, function in corpus_pipeline.STAGES:
        given = {r.doc_id: r.text for r in taken.collect()}
        result = queries_stage(function(spark, taken, FOLDER))
        if name == "packing":
            check_pieces(result.collect(), sorted(given.items()))
            continue
        assert result.columns == corpus_pipeline.COLUMNS
        left = {r.doc_id: r for r in result.collect()}
        if name == "quality rules":
            assert not any(plain.counts(r.text)[0] < 50 for r in left.values())
        elif name == "line dedup":
            want = plain.lines(sorted(given.items()))
            assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in left.items()} == {d: w[2] for d, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in left.values())
        elif name == "n-gram Jaccard join":
            assert set(left) == {d for d, (_, c) in plain.near_documents(sorted(given.items())).items() if d == c}
        else:
            assert set(left) < set(given)
        taken = result


def queries_stage(df):
    from keyfathom.llm.common import stage
    return stage(df, "test")


def test_byte_level_ids_equal_the_library():
    """Latin texts with gaps, signs and contractions, and texts that only the library splits."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokens.SpacedWords(path), tokens._library(path)
    assert encoder.plain
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x260)] + list("   \n\n\t''sdlltrevem1 2 日本😀я") * 6
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()


def test_word_cache_forgets_in_generations():
    made = []
    cache = tokens.WordCache(lambda w: made.append(w) or [len(w)], limit=3)
    words = [str(i) for i in range(30)] * 2 + ["7"] * 9
    assert np.frombuffer(cache.ids(words), "<u4").tolist() == [len(w) for w in words]
    assert len(cache) <= 3 and len(cache.old) <= 3 and len(made) <= 61
