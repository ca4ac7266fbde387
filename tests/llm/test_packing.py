import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from headway.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, texts, length):
    """Each id once, sequences gapless, no padding; ``texts``: the multiset of (doc_id, text)."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    want = defaultdict(int)
    for i, text in texts:
        want[i] += len(ids_of(text))
    assert {i: sum(n for _, n, *_ in parts) for i, parts in documents.items()} == dict(want)
    for i, text in texts:
        if len([1 for j, _ in texts if j == i]) == 1:
            raw, at = np.array(ids_of(text), "<u4"), 0
            for start, n, crc, total in sorted(documents[i]):
                assert start == at and total == len(raw) and crc == zlib.crc32(raw[start : start + n].tobytes())
                at += n


def test_every_id_in_one_piece(spark, make_docs):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["transit", "Straße", "don't", "x1y2", "的", "<|endoftext|>", "　"]) for _ in range(rng.randint(0, 400)))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, " \t\n"), (903, "word " * 30_000), (904, "z" * 20_000), (None, "no id"), (905, "twice here"), (905, "twice here")]
    df = make_docs(texts).selectExpr("*", "1 as start", "2 as length", "3 as `a.b`")
    for params in ({"length": 64, "block": 8}, {}):
        got = packing.pack(df, PATH, **params).collect()
        check(got, texts, params.get("length", 4096))
    assert {tuple(r) for r in packing.pack(df, PATH).collect()} == {tuple(r) for r in got}
    for r in packing.pack(df.filter("doc_id < 5"), PATH, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert packing.pack(df.filter("false"), PATH).count() == 0


def test_words_encoded_once_give_the_ids_of_whole_texts():
    with open(PATH, encoding="utf-8") as f:
        e = packing.Encoder(f.read(), 2)
    rng = random.Random(8)
    marks = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", " ", " ", "'s", "'", "9", "ΑΣ", "σ", "İ", "ß", "<|endoftext|>", "<|startoftext|>", "<|", "한", "가", "!", "😀", "\x0b", "\x1c", "\x85", "​"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    for text, ids in zip(texts, e.encode(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == ids_of(text), repr(text)


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    docs = [packing.Piece(i, np.zeros(n, np.uint32), 0, n) for i, n in enumerate(np.minimum(rng.lognormal(5.5, 1.2, 2500).astype(int) + 1, 1500).tolist())]
    rooms = [4096] * (sum(p.length for p in docs) // 4096)
    packed, costs, rest = packing.balanced(docs, rooms, 1.0, 1 / 4096)
    assert all(sum(p.length for p in s) == 4096 for s in packed) and sum(p.length for p in rest) < 4096
    assert costs == pytest.approx([sum(p.length + p.length**2 / 4096 for p in s) for s in packed])
    # in the order of arrival, as a plain packer would cut them
    flat = np.concatenate([np.full(p.length, k) for k, p in enumerate(docs)])[: 4096 * len(rooms)].reshape(-1, 4096)
    plain = [sum(n + n**2 / 4096 for n in np.unique(s, return_counts=True)[1]) for s in flat]
    assert np.std(costs) < 0.2 * np.std(plain) and max(costs) < max(plain)


def test_powers():
    assert packing.powers(0) == [] and packing.powers(13) == [8, 4, 1]
