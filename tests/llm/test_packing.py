import random
import zlib

import numpy as np
import pytest

from millrace.llm import packing

from .data import documents, frame, with_clashes

P = pytest.importorskip("public_tokenizers")


def test_words_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, runs = Tokenizer.from_file(path), packing.Runs(path)
    t.encode_special_tokens = True
    for text in ["Hello, WORLD's  123 naïve café x", "é àb ́x İstanbul ΣΑΣ", "a​b <|endoftext|> c\x1cd\x85e", "日本語 テスト　です 👍🏽", "'s don't we'll 'LL 't're a_b ***9.9" * 3, "\x00a ª²½ \xad ×÷ É\n\t\x0b"]:
        whole = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert runs.encode(text) == whole, text


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = documents()
    out = packing.pack(with_clashes(frame(spark, rows), "piece", "length", "rank", "sequence_id"), P.path("word_bpe_49k.json"), 512).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out}
    want, total = {}, 0
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[(i, k)] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(n for _, n in b) <= 512
    assert len(bins) <= -(-total // 512) + 2


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_uses_every_piece_once(seed):
    rng = random.Random(seed)
    h = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    bins = packing.best_two_fit(h, 100)
    used = {}
    for n, content in bins:
        assert sum(content) <= 100 and n > 0
        for x in content:
            used[x] = used.get(x, 0) + n
    assert used == h
    total = sum(n for n, _ in bins)
    bound = max(-(-sum(k * v for k, v in h.items()) // 100), sum(v for k, v in h.items() if k > 50))
    assert total <= 1.1 * bound + 2


def test_replacement_fits_more_tightly():
    # Greedy gives 60+30 with a gap of 10; 25+15 in place of 30 fill it.
    assert sorted(packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0][1]) == [15, 25, 60]


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0
