import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from grainmill.llm import packing
from grainmill.llm.common import as_bytes
from grainmill.llm.queries import tokenizer_path

from .helpers import docs, empty, rows


def test_round_trip(spark):
    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows())
    pieces = packing.pack(docs(spark).repartition(3), path, with_ids=True).cache()
    by_doc, by_seq = {}, {}
    for r in pieces.collect():
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        place = r.sequence_id * 2048 + r.offset - r.start
        by_doc.setdefault((place, r.doc_id, r.doc_tokens), []).append((r.start, list(r.ids)))
    texts = []
    for (_, _, n), own in by_doc.items():
        ids = [x for _, part in sorted(own) for x in part]
        assert len(ids) == n
        texts.append(ids)
    assert sorted(texts) == want
    for seq, own in by_seq.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or seq == max(by_seq)
    whole = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 2048 or (len(r.ids) == r.length and r.length & (r.length - 1) == 0) for r in whole)
    assert packing.pack(empty(spark), path).collect() == []


def test_words_encode_like_texts():
    path = tokenizer_path()
    words, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    for text in ["Don't  stop it's 12,345 naïve é \x1c odd\x85x <|endoftext|> ΑΣ Σ ß", "", "a\n\tb", *(t or "" for _, t, *_ in rows())]:
        got = np.frombuffer(words.encode(text.encode()), dtype=words.kind).tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_another_kind_of_tokenizer_takes_whole_texts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert packing.WordIds(tokenizer_path()).by_words and not packing.WordIds(path).by_words
    found = packing.pack(docs(spark), path, with_ids=True).where("start = 0").collect()
    want = {(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1][:5])) for i, t, *_ in rows()}
    assert {(r.doc_id, r.doc_tokens) for r in found} == {(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows()}
    assert all((r.doc_id, tuple(r.ids[:5])) in want for r in found if len(r.ids) >= 5)


def test_rows_encode_like_texts_and_words_are_learned_without_signs_and_numbers():
    path = tokenizer_path()
    words, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    atoms = ["a", "Bc", "é", "é", "́", "̸", "<", "=", "'", "'s", "'LL", "$", ",", ".", " ", "\n", "\x1c", "\xa0", "7", "½", "漢", "İ", "Σ", "|>", "<|"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(atoms, rng.integers(0, 12))) for _ in range(3000)]
    texts += ["x<|ENDOFTEXT|>y", "x<|endoftext|>y <|startoftext|>", "", "z" * 300]
    flat, at = as_bytes(pa.array([None, *texts], pa.string()))
    for run in (packing.RUN, 50, 1):
        packing_run, packing.RUN = packing.RUN, run
        try:
            found = [x for _, _, ids in words.encode_rows(flat, at, b"\x01\x00") for x in ids.to_pylist()]
        finally:
            packing.RUN = packing_run
        for text, got in zip(["", *texts], found, strict=True):
            assert np.frombuffer(got, words.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text
    assert words.encode(b"x<|ENDOFTEXT|>y") == np.array(tokenizer.encode("x<|ENDOFTEXT|>y", add_special_tokens=False).ids, words.kind).tobytes()
    words.known.clear()
    words.encode(" ".join(f"same$$${i} same### {'q' * 70}" for i in range(1000)).encode())
    assert sorted(words.known) == sorted([b"same", b"$$$", b"###", *(str(i).encode() for i in range(10))])
