"""The whole job: what an earlier version of an operator left out."""

from __future__ import annotations

import itertools
import random
import tempfile
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyfathom.llm import main_text, packing, pivots, quality, token_files, tokens, toxicity
from keyfathom.llm.common import ship
from tests.llm import plain


def cone(rng, n, dim, cosine):
    """Unit vectors around a common one, with this mean cosine between two of them."""
    center, noise = rng.normal(size=dim), rng.normal(size=(n, dim))
    unit = center / np.linalg.norm(center) + noise / np.sqrt(dim) * np.sqrt(1 / cosine - 1)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def test_every_link_of_a_dense_group(spark, monkeypatch):
    """A third of the rows in one near group, the rest scattered; also with cells cut into many blocks."""
    ship(spark)
    rng = np.random.default_rng(7)
    points = np.vstack([cone(rng, 1000, 64, 0.95), cone(rng, 60, 64, 0.97), rng.normal(size=(1940, 64))])
    points = points[rng.permutation(len(points))].astype("f4")
    unit = points.astype("f8") / np.linalg.norm(points.astype("f8"), axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert np.abs(cosine - 0.95).min() > 1e-12
    linked = cosine >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    root = pivots._trees(len(unit), *np.nonzero(linked))
    assert want.sum() > 100_000 and (want == 0).sum() > 1000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    for block in (pivots.BLOCK, 150):
        monkeypatch.setattr(pivots, "BLOCK", block)
        found = {r.vec_id: r for r in pivots.near_vectors(table).collect()}
        assert [found[i].n_links for i in range(len(unit))] == want.tolist()
        assert [found[i].component_id for i in range(len(unit))] == root.tolist()
        assert [found[i].kept for i in range(len(unit))] == (root == np.arange(len(unit))).tolist()


def texts_of(spark, table, pages):
    ship(spark)
    rows = table("page_id long, url string, html string", *((i, "http://a.b/x", html) for i, html in enumerate(pages)))
    return [r.text for r in main_text.main_texts(rows).orderBy("page_id").collect()]


def test_copies_are_no_template(spark, table):
    """Most pages of the host are one article; the template is what different articles share."""
    def page(k):
        return (f"<div class='top'><p>Home of all<p>All rights kept</div><article><h1>Title {k}</h1><p>First {k}.<p>Second {k}."
                f"<p>Third {k}.<p>Subscribe today</article>")

    own = [f"Title {k}\nFirst {k}.\nSecond {k}.\nThird {k}." for k in range(6)]
    only = texts_of(spark, table, [page(0)] * 40)
    assert only == [own[0] + "\nSubscribe today"] * 40
    mixed = texts_of(spark, table, [page(0)] * 95 + [page(k) for k in range(1, 6)])
    assert mixed == [own[0]] * 95 + own[1:]


def test_parts_of_an_article_stay(spark, table):
    page = ("<div id='search'>box</div><article><header class='entry-header'><h1>Head</h1></header><div class='post-header'>Line"
            "</div><h2 id='related-work'>Related</h2><section id='search'>Search</section><p id='notice-period'>Notice</p>"
            "<div class='share-price'>Price</div><h3 class='ad-hoc'>Ad hoc</h3><div class='ad-slot'>buy</div>"
            "<div class='comments'>me too</div></article>")
    assert texts_of(spark, table, [page]) == ["Head\nLine\nRelated\nSearch\nNotice\nPrice\nAd hoc"]


def test_special_tokens_as_the_library_has_them(spark, table):
    """Both queries' ids are those of an untouched tokenizer, and starts follow from them."""
    ship(spark)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|ENDOFTEXT|> y", "<|startoftext|>d  <|endoftext|>\n", "plain"]
    docs = table("doc_id long, text string", *enumerate(texts))
    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 2)):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        ids = [[*library.encode(t, add_special_tokens=False).ids, end] for t in texts]
        if end == 1:
            rows = packing.token_pieces(docs, path, end, 2048).orderBy("doc_id").collect()
            assert [(r.doc_tokens, r.ids_crc32) for r in rows] == [(len(x), plain.crc(x)) for x in ids]
        else:
            folder = tempfile.mkdtemp(prefix="run-")
            token_files.write_documents(docs, path, end, f"{folder}/files")
            rows = token_files.read_documents(spark, f"{folder}/files").orderBy("doc_id").collect()
            assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), plain.crc(x)) for x in ids]
            assert [r.start for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    # The scan for separators needs special tokens to be text.
    assert np.frombuffer(tokens.SpacedWords(path).encode(texts[0]), "<u4").tolist() == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]


def test_obfuscated_words_are_restored():
    """Letters learned from plain text; every way to hide a word gives the word again, plain words stay."""
    plain_text = ("you are an idiot and a stupid person they said to the good little boy in the letter we will all see a book "
                  "the idiot took the stupid apple from the hill and the idiots keep a stupid shop ") * 20
    counts = np.zeros(toxicity.SIZE ** toxicity.ORDER, "int64")
    c = np.concatenate([np.zeros(toxicity.ORDER - 1, "i8"), toxicity.codes(plain_text)])
    for k in range(len(c) - toxicity.ORDER + 1):
        counts[int(np.polyval(c[k:k + toxicity.ORDER], toxicity.SIZE))] += 1
    costs = toxicity.letter_model(counts)
    decoder = toxicity.Decoder(costs)
    for hidden, word in (("i_d_i_o_t", "idiot"), ("iddiot", "idiot"), ("idiioot", "idiot"), ("i  d  i  o  t", "idiot"),
                         ("i/d/i/o/t", "idiot"), ("i d ! o t", "idiot"), ("$ t u p 1 d", "stupid"),
                         ("s.t.u.p.!.d", "stupid"), ("1d10t", "idiot"), ("stuuupid", "stupid")):
        assert word in toxicity._WORD.findall(decoder.restore(f"you {hidden} person")), hidden
    assert decoder.restore("the good little boy will all see a book") == "the good little boy will all see a book"
    weights = {"idiot": 3.0}
    assert decoder.weight("you id iot person".split(), weights) == 3.0
    assert decoder.weight("the idiot took".split(), weights) == 3.0
    assert decoder.weight("the letter".split(), {"theletter": 3.0}) == 0.0


def test_null_groups_have_their_own_names(spark, table):
    rows = table("lang string, source string", ("en", None), (None, None))
    names = rows.select(quality._group("lang", "source"), quality._group("lang")).collect()
    assert len({n for row in names for n in row}) == 4


def cheapest_reading(decoder, noisy):
    """Least cost and its text over all paths of the lattice, one by one."""
    spaced = bool(toxicity._SPACED.fullmatch(noisy))
    noisy = toxicity._GAPS.sub(" ", noisy) if spaced else noisy
    lattice = []
    for i, symbol in enumerate(noisy):
        run = len(noisy[i:]) - len(noisy[i:].lstrip(symbol)) + len(noisy[:i]) - len(noisy[:i].rstrip(symbol))
        if symbol.isalpha():
            choices = [(symbol, 0.0)]
            if i and noisy[i - 1] == symbol:
                choices.append(("", toxicity.SQUEEZED if run > 2 else toxicity.UNDOUBLED))
        else:
            choices = [(c, toxicity.SUBSTITUTED) for c in toxicity.LEET.get(symbol, "")]
            if spaced and symbol == " ":
                choices.append(("", toxicity.SQUEEZED))
            elif symbol not in "0123456789":
                choices.append(("", toxicity.DROPPED))
            choices.append((" " if symbol in " ._-" else symbol, toxicity.KEPT + (1.0 if symbol.isdigit() else 0.5)))
        lattice.append(choices)
    paths = []
    for path in itertools.product(*lattice):
        text = "".join(letter for letter, _ in path)
        paths.append((decoder.cost(text) + sum(price for _, price in path), text))
    return min(paths)


def test_decoding_is_the_cheapest_of_all_readings():
    counts = np.random.default_rng(4).integers(0, 9, toxicity.SIZE ** toxicity.ORDER) ** 3
    decoder = toxicity.Decoder(toxicity.letter_model(counts))
    chance = random.Random(4)
    for _ in range(150):
        noisy = "".join(chance.choice("aabeilosst013$!") for _ in range(chance.randint(1, 7)))
        if chance.random() < 0.3:
            noisy = chance.choice([" ", ".", " - "]).join(noisy[:4])
        least, text = cheapest_reading(decoder, noisy)
        found = decoder._decode(noisy)
        assert found == text or cheapest_reading(decoder, noisy)[0] == pytest.approx(least), noisy


@pytest.mark.parametrize("text", ["0", "#", "$", "*", "(", "!", "a", "_", " ", "*-", "0 ", "aB3/", "ab. ", "a b "])
def test_long_runs_take_linear_time(text):
    decoder = toxicity.Decoder(toxicity.letter_model(np.ones(toxicity.SIZE ** toxicity.ORDER, "int64")))
    begin = time.process_time()
    decoder.restore(text * (200_000 // len(text)))
    assert time.process_time() - begin < 20  # a quadratic search took 20 s for a tenth


def test_no_evidence_stays_below_a_half(spark, table):
    ship(spark)
    labelled = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    labels = table("doc_id long, toxic int, quality int", *[(i, int(k < 19), 1) for k, i in enumerate(labelled[:20])])
    for words in ("one two", "bad thing"):
        docs = table("doc_id long, text string", *[(i, f"{words} {i}") for i in labelled[:20]], (200, ""), (201, None))
        rows = toxicity.score_toxicity(docs, labels).collect()
        assert all(r.score < 0.5 and r.predicted == 0 for r in rows if r.doc_id >= 200)
    pair = labels.where(f"doc_id IN ({labelled[0]}, {labelled[19]})")
    assert not any(r.predicted for r in toxicity.score_toxicity(docs, pair).collect())
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0
