from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from folioscan.llm import packing

PATH = packing.tokenizer_files()[0]


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, ids):
    """Pieces cover each document once, fill sequences without gaps and carry the right ids."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(ids)
    for k, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[k])
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    return len(sequences)


def test_pieces_of_documents(documents):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r.doc_id: ids_of(tokenizer, r.text) for r in documents.collect()}
    rows = packing.pack(documents).collect()
    n, tokens = check(rows, ids), sum(map(len, ids.values()))
    assert n * packing.WINDOW - tokens <= max(packing.WINDOW, 0.01 * tokens)
    spread = packing.pack(documents.repartition(7)).collect()
    assert check(spread, ids) <= n + 5


def test_fast_ids_equal_the_tokenizers(documents):
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.encoder(*packing.tokenizer_files())
    odd = ["", " ", "a  b\n\n c\t", "<|endoftext|> x", "don't WE'LL 123 ½ é 😀 漢字 x", "x" * 3000, " " * 5000, "\n" * 300, "'s 's", "\x00\x7f"]
    for text in odd + [r.text for r in documents.collect()]:
        assert encoder.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packer_invariants():
    rng = np.random.default_rng(3)
    ids = {k: rng.integers(2, 50_000, int(n)).tolist() + [1] for k, n in enumerate([*rng.integers(0, 3000, 300), 2047, 2048, 4095, 0])}
    packer = packing.Packer(0)
    for k, x in ids.items():
        packer.add(k, np.array(x, "<u4"))
        assert len(packer.open) <= packing.OPEN_WINDOWS
    packer.close()
    from types import SimpleNamespace

    names = [x.split()[0] for x in packing.PIECES.split(", ")]
    rows = [SimpleNamespace(**dict(zip(names, r, strict=True))) for r in packer.rows]
    n = check(rows, ids)
    assert n <= sum(map(len, ids.values())) / packing.WINDOW * 1.01 + 1


def test_edges(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert len([r for r in rows if r.start == 0]) == odd.count()
    assert packing.pack(empty).count() == 0
