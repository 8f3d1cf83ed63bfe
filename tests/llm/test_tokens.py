import hashlib
import random
import struct
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geolattice.llm import simple8b, token_counts, token_output, word_bpe

from . import fixtures

TEXTS = st.lists(st.sampled_from(list("aAbethin ' sS12é́ßΣİ中🙂\n\t\x00\x1f\x85\xa0　▁.,!-<|>") + ["<|endoftext|>", "the ", "ing", "  ", "▁▁"]), max_size=60).map("".join)


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")} | {"piece": sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))}


CODEC, PIECES, BYTES = word_bpe.Codec(read("word_bpe_49k.json")), token_counts.PieceCounter(read("piece_bpe_32k.model")), token_output.ByteLevelEncoder(read("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_like_the_libraries(library, texts):
    word, byte = library["word_bpe_49k.json"], library["byte_bpe_50k.json"]
    ids = CODEC.encode_batch(texts)
    assert ids == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert [CODEC.decode(i) for i in ids] == [word.decode(i, skip_special_tokens=False) for i in ids]
    assert [x.tolist() for x in BYTES.encode(texts)] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    assert PIECES.count(texts) == [len(library["piece"].encode(t)) for t in texts]


def test_caches_start_anew(library, monkeypatch):
    for module in (word_bpe, token_counts, token_output):
        monkeypatch.setattr(module, "REMEMBERED", 5)
    rnd = random.Random(1)
    for _ in range(5):
        texts = [fixtures.prose(rnd, 50) for _ in range(4)]
        assert CODEC.encode_batch(texts) == [e.ids for e in library["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
        assert PIECES.count(texts) == [len(x) for x in library["piece"].encode(texts)]
        assert [x.tolist() for x in BYTES.encode(texts)] == [e.ids for e in library["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False)]


def test_plain_chunks_need_no_library(library):
    rnd, tok = random.Random(3), library["word_bpe_49k.json"]
    plain = [chr(c) for c in [*range(33, 127), *range(192, 383)] if c not in (0xD7, 0xF7, 0x130)]
    texts = [*plain, "", *(c + "ab" + c for c in plain)]
    texts += ["".join(rnd.choices([*plain, *" ' ' \n\t\x0b\x0c", "'s", "'ll", "'re"], k=40)) for _ in range(500)]
    texts = [t for t in texts if "<|" not in t]
    codec = word_bpe.Codec(read("word_bpe_49k.json"))
    codec._pieces = None
    assert codec.encode_batch(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    codec = word_bpe.Codec(read("word_bpe_49k.json"))
    odd = ["<|endoftext|>", "İ", "́", " 中　x", "\x1c", "×"]
    mixed = [t + rnd.choice(odd) + u for t, u in zip(texts, texts[::-1], strict=True)]
    assert codec.encode_batch(mixed) == [e.ids for e in tok.encode_batch(mixed, add_special_tokens=False)]


def test_plain_chunks_are_split_once(library):
    rnd, tok = random.Random(4), library["byte_bpe_50k.json"]
    plain = [chr(c) for c in [*range(33, 127), *range(192, 383)] if c not in (0xD7, 0xF7)]
    draw = lambda n: "".join(rnd.choices([*plain, *"  \n''1a", "'s", " 'll", "'re", "...", "\n\n"], k=n))
    texts = [*plain, "", "\n\n", *("ab " + c + "ab1" + c for c in plain), *(draw(40) for _ in range(500))]
    mixed = [t + rnd.choice(["<|endoftext|>", "\u0301", " \u4e2d\u3000x", "\x1c", "\u00d7", "\x00", "\u00aa1"]) + u for t, u in zip(texts, texts[::-1], strict=True)]
    for some in (texts, mixed, texts + mixed):
        encoder = token_output.ByteLevelEncoder(read("byte_bpe_50k.json"))
        assert [x.tolist() for x in encoder.encode(some)] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
    encoder, asked = token_output.ByteLevelEncoder(read("byte_bpe_50k.json")), []
    library_ids = encoder._library
    encoder._library = lambda some: asked.extend(some) or library_ids(some)
    encoder.encode(["a word, a word. a word; x1 y1\nz1 é2 'word' word's"])
    assert len(asked) == len({*asked}) and not any("'word" in p or " " in p[1:] for p in asked)


def test_known_chunks_are_not_split_again(library, monkeypatch):
    rnd, tok = random.Random(5), library["byte_bpe_50k.json"]
    draw = lambda n: " ".join(rnd.choice("aé1,") + "".join(rnd.choices("abcdeéßž.,'19\n", k=rnd.randint(0, 5))) + rnd.choice("bß2.") for _ in range(n))
    texts = [draw(30) for _ in range(200)]
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    encoder = token_output.ByteLevelEncoder(read("byte_bpe_50k.json"))
    # Plain pre-tokens go to the library's model as they are: whole texts of them are not split by it.
    encoder.tok = types.SimpleNamespace(model=encoder.tok.model, encode_batch=lambda rest, **_: [pytest.fail("split") for _ in rest])
    assert [x.tolist() for x in encoder.encode(texts)] == ids
    monkeypatch.setattr(token_output, "_PLAIN", None)
    assert [x.tolist() for x in encoder.encode(texts[::-1])] == ids[::-1]


def test_known_parts():
    rnd, known, ids = random.Random(6), token_output.Known(lambda: 3000, ["stop"]), {"stop": [0xFFFFFFFF]}
    began = 0
    for _ in range(60):
        known.make_room()
        if len(known.parts) == 1:
            began, ids = began + 1, {"stop": ids["stop"]}
        parts = pa.array(sorted({rnd.choice(["stop", "", "\u4e2d"]), *("x" * rnd.randint(0, 60) for _ in range(9))}), pa.large_string())
        place = known.places(parts)
        assert [p >= 0 for p in place] == [p in ids for p in parts.to_pylist()]
        new = parts.filter(pa.array(place < 0))
        codes = [[rnd.randrange(60000) for _ in range(rnd.randint(0, 4))] for _ in new]
        place[place < 0] = known.learn(new, np.array([i for c in codes for i in c], "<u4"), np.array([*map(len, codes)], np.int64))
        ids |= zip(new.to_pylist(), codes, strict=True)
        got, ends = known.spread(place)
        assert [x.tolist() for x in np.split(got, ends[:-1])] == [ids[p] for p in parts.to_pylist()]
    assert began > 2


def test_first_values_decide():
    rnd = np.random.default_rng(7)
    for most in (2, 7, 12, 17, 65):
        bits = simple8b._widths_of(rnd.integers(0, 2**63, 4000, np.uint64) >> rnd.integers(64 - most, 64, 4000).astype(np.uint64))
        bits = np.concatenate([bits, np.full(9, 64, np.int8), np.zeros(int(simple8b.COUNTS.max()), np.int8)])
        near, start = simple8b._near(bits), np.arange(4009)
        chosen = simple8b._choose(bits, start)
        assert (near[start][near[start] >= 0] == chosen[near[start] >= 0]).all() and ((near[start] < 0) == ((chosen < 9) & (chosen > 0) | (chosen == 15))).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=3000), st.integers(0, 9))
def test_words_round_trip(ids, _):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = simple8b.pack(ids)
    assert (simple8b.unpack(words, offsets, escapes, len(ids)) == ids).all()
    for block in range(len(offsets) - 1):
        assert (simple8b.block_ids(words, offsets, escapes, len(ids), block) == ids[block * simple8b.BLOCK : (block + 1) * simple8b.BLOCK]).all()
    data = simple8b.write_shard(7, 8, [1, None, 3], np.array([0, len(ids), 0]), ids)
    part, shard, docs, lengths, again = simple8b.read_shard(data + token_output.END.encode())
    assert (part, shard, docs) == (7, 8, [1, None, 3]) and (again == ids).all() and lengths.sum() == len(ids)


def test_packing_is_dense():
    for value, per_word in ((0, 120), (1, 60), (4095, 5), (30000, 4), (50000, 3)):
        words, _, _ = simple8b.pack(np.full(1024, value, np.uint64))
        assert len(words) == -(-1024 // per_word)
    with pytest.raises(ValueError):
        simple8b.read_shard(b"\0" * 100)


def test_token_files(spark, tmp_path, library):
    docs, path = fixtures.odd_documents(spark), str(tmp_path / "t")
    token_output.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=9000)
    rows = token_output.with_starts(token_output.read_tokens(spark, path, with_ids=True)).orderBy("start").collect()
    assert len(list((tmp_path / "t").glob("part-*"))) >= 3
    expected = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    start = 0
    for row, (known, doc_id, _, text) in zip(rows, expected, strict=True):
        ids = [*library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id if known else None, start, len(ids)) and row.ids == ids
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    token_output.write_tokens(fixtures.no_documents(spark), str(tmp_path / "none"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_output.with_starts(token_output.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def test_encoding_of_tables(spark, library):
    docs, path = fixtures.odd_documents(spark), public_tokenizers.path("word_bpe_49k.json")
    texts = sorted(r.text or "" for r in docs.collect())
    tok = library["word_bpe_49k.json"]
    coded = word_bpe.encode(docs, path)
    got = sorted(coded.collect(), key=lambda r: r.text or "")
    assert [r.ids for r in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    again = {(r.text or ""): r.decoded for r in word_bpe.decode(coded, path).collect()}
    assert all(again[t] == tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts)
    digests = {r.doc_id: r for r in word_bpe.encode(docs.where("doc_id < 3 or doc_id = 8"), path, digests=True).collect()}
    ids = tok.encode(fixtures.ODD[8], add_special_tokens=False).ids
    assert digests[8].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digests[0].n_tokens == 0
    assert digests[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert word_bpe.encode(fixtures.no_documents(spark), path).count() == 0


def test_counts_of_tables(spark, library):
    docs = fixtures.odd_documents(spark)
    got = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=100).collect()
    exp = sorted((len((r.text or "").encode()), len(library["piece"].encode(r.text or ""))) for r in docs.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == exp and all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert "component_id" in got[0].asDict()
    assert token_counts.count_tokens(fixtures.no_documents(spark), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
