"""The encoder against the tokenizers library: corpus texts, odd Unicode, special strings, long words."""

import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldlore.llm import bpe, counts, queries, shared
from fieldlore.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, merge_table
from fieldlore.llm.counts import token_counts
from fieldlore.llm.records import frames, read_index, read_record, read_records, read_shuffled, unpack, write_records

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\t", "a", "Áḅ̇ c", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul I", "x\x1cy\x1f z", "a b c　d\x85e", "don't we'LL I'M 's",
    "<|endoftext|>", "hi<|startoftext|>there<|endoftext|><|endoftext", "😀👍🏽 fam 👨‍👩‍👧", "١٢٣ ½ ⅷ 一二三", "日本語のテキスト", "é ́x", "﻿bom​zero", "ﬁne ǅ",
    "!!!???###", "a" * 1000, "ab" * 700, "x" * 193 + " " + "th" * 97, "  two  spaces   ", "tab\tnew\nline\r\n", "\x00\x01",
]


def sample():
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id limit 300").fetchall()
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    return ODD + [r[0] for r in rows] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_matches_library(path):
    lib, own = Tokenizer.from_file(path), merge_table(path)
    texts = sample()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want
    own.words.clear(), own.words.old.clear()
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False), repr(text)


def test_every_code_point():
    """Only code points that Python's Unicode version has not assigned may be classed otherwise."""
    lib, own = Tokenizer.from_file(WORD), merge_table(WORD)
    known = [c for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [f"1{chr(c)}b!{chr(c)}!" for c in known]
    bad = [c for c, t, e in zip(known, texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(own.encode(t), "<u4").tolist() != e.ids]
    assert not bad, list(map(hex, bad[:20]))


def test_every_code_point_above():
    """The rest of the code points: CJK extensions G and H, tags, variation selectors, private planes."""
    lib, own = Tokenizer.from_file(WORD), merge_table(WORD)
    known = [c for c in range(0x30000, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    assert len(known) > 140_000 and known[-1] == 0x10FFFD
    texts = [f"1{chr(c)}b!{chr(c)}!" for c in known]
    bad = [c for c, t, e in zip(known, texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(own.encode(t), "<u4").tolist() != e.ids]
    assert not bad, list(map(hex, bad[:20]))


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (7, ODD[7], "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    lib = Tokenizer.from_file(WORD)
    want = sorted((i, hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), len(e)) for i, e in [(-1 if i is None else i, lib.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids_sha256, r.n_tokens) for r in bpe_round_trip(df, WORD).collect())
    assert got == want
    enc = bpe_encode(df.drop("ids"), WORD)
    assert {r.doc_id: r.decoded for r in bpe_decode(enc, WORD).collect()}[4] == lib.decode(lib.encode(ODD[4], add_special_tokens=False).ids, skip_special_tokens=False)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, BYTE, limit=2).collect()}
    assert counts[None] == (0, 0, False)
    assert counts[13] == (len(ODD[13].encode()), len(Tokenizer.from_file(BYTE).encode(ODD[13]).ids), True)
    assert bpe_round_trip(df.limit(0), WORD).collect() == [] and token_counts(df.limit(0), BYTE).collect() == []


@pytest.mark.parametrize("shards", [1, 5])
def test_records(spark, shards):
    rows = [(i * 3 % 41, t) for i, t in enumerate(ODD)] + [(None, None), (5, None), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder, manifest = write_records(df, WORD, 2, shards=shards)
    got = [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in read_records(spark, manifest, batch=4, ids=True).orderBy("start").collect()]
    lib = Tokenizer.from_file(WORD)
    want = sorted(((-1 if i is None else i, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows), key=lambda x: x[0])
    assert [-1 if g[0] is None else g[0] for g in got] == [w[0] for w in want]
    assert sorted((g[0] if g[0] is not None else -1, g[3]) for g in got) == sorted(want)
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    for _, path, records, _, _ in manifest:
        index = read_index(path.replace(".rec", ".idx"))
        assert len(index) == records
        for doc_id, place, n in index[::-1]:
            d, ids = read_record(path, int(place))
            assert len(ids) == n and (d is None or d == doc_id)


def test_counts(spark, monkeypatch):
    """Counts of odd and usual texts against the library, also where tables are small and hashes meet."""
    texts = sample()
    rows = [(i, t, 7) for i, t in enumerate([*texts, None, texts[60], texts[60]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(5)
    lib = Tokenizer.from_file(BYTE)
    want = {i: (len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows}
    assert {r.doc_id: tuple(r)[1:] for r in token_counts(df, BYTE, keep=["doc_id", "n_tokens"]).collect()} == want
    monkeypatch.setattr(counts, "SEEN", 100)
    table = counts.piece_table(df, BYTE, files=3)
    assert len(table.paths) == 3 and not table.odd
    monkeypatch.setattr(counts, "TABLE", 50)
    few = counts.Counts(table, BYTE)
    assert few.count([t for _, t, _ in rows]) == [want[i][1] for i, _, _ in rows]


def test_meeting_hashes(spark, monkeypatch):
    """Pre-tokens whose hash isn't theirs alone are kept in full."""
    texts = ["a bb ccc dddd ee", "zz yyyy", "a a a"]
    own = merge_table(BYTE)
    table = counts.PieceTable((None,), tuple((p.encode(), own.count_pieces([p])[0]) for p in {x for t in texts for x in own.pre_tokens(t)[0]}))
    lib = Tokenizer.from_file(BYTE)
    assert counts.Counts(table, BYTE).count(texts) == [len(lib.encode(t).ids) for t in texts]


def test_queries(spark):
    """The three queries over a whole small table against the library."""
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    ids = {i: word.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, sf).collect()}
    assert got == {i: (len(x), digest(np.array(x, "<u4").tobytes()), digest(word.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    start, want = 0, {}
    for i, _ in docs:
        want[i] = (start, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 2], "<u4").tobytes()))
        start += len(ids[i]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_records(spark, sf).collect()} == want
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, sf).collect()}
    assert got == {i: (len((t or "").encode()), n := len(byte.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in docs}


def test_very_long_texts(spark):
    texts = ["x" * 300_000 + " " + "ab " * 200_000, "é " * 150_000 + "\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    want = {i: word.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {r.doc_id: (list(r.ids), r.n_tokens) for r in bpe_round_trip(df, WORD, with_ids=True).collect()}
    assert got == {i: (x, len(x)) for i, x in want.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts(df, BYTE).collect()} == {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    _, manifest = write_records(df, WORD, 2)
    assert {r.doc_id: list(r.ids) for r in read_records(spark, manifest, ids=True).collect()} == {i: [*x, 2] for i, x in want.items()}


def test_shuffled_reads(spark, tmp_path):
    """Every record once, in an order that follows from the seed alone, from a mounted store and through one that gives byte ranges."""
    df = spark.createDataFrame([(i, f"word{i} " * (i % 7)) for i in range(200)], "doc_id bigint, text string")
    _, manifest = write_records(df, WORD, 2, shards=4)
    plain = {r.doc_id: list(r.ids) for r in read_records(spark, manifest, ids=True).collect()}
    orders = []
    for seed in (1, 1, 2):
        got = read_shuffled(spark, manifest, seed).orderBy("turn").collect()
        assert {r.doc_id: list(r.ids) for r in got} == plain and len(got) == 200
        orders.append([r.doc_id for r in got])
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    with pytest.raises(ValueError, match="index"):
        index = manifest[0][1].replace(".rec", ".idx")
        rows = read_index(index).copy()
        rows[0, 0] += 1
        shared.put(index, rows.tobytes())
        from fieldlore.llm.records import shard_records

        list(shard_records(manifest[0][1]))


def test_damage_is_seen():
    from fieldlore.llm.records import frame, pack

    data = frame(pack(1, np.arange(9, dtype="<u4"))) + frame(pack(2, np.array([70000], "<u4")))
    assert [unpack(p)[1].tolist() for p in frames(data)] == [list(range(9)), [70000]]
    for at in (2, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(frames(bytes(broken)))


def test_empty_records(spark):
    _, manifest = write_records(spark.createDataFrame([], "doc_id bigint, text string"), WORD, 2)
    assert manifest == [] and read_records(spark, manifest).collect() == []


def test_words_looked_up_at_once(monkeypatch):
    """A table of few words that is cleared again and again, texts cut at white space, words that share their first 16 bytes, and marks after letters whose lower case ends otherwise."""
    lib, own = Tokenizer.from_file(WORD), bpe.MergeTable(WORD, 5)
    assert own.short.limit == 10
    texts = [*sample(), "z0 aİ. İ, é. A. B,, C.", "a\0 a a\0\0 a", "a" * 15 + "b. " + "a" * 15 + "bc " + "a" * 15 + "b", "日本語日. 日本語日本 日本語日本語", " ".join(f"w{k}" for k in range(3000))]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for chars in (bpe.CHARS, 50):
        monkeypatch.setattr(bpe, "CHARS", chars)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want
    assert list(bpe.divided("ab cd  e", 2)) == ["ab", " cd", "  e"] and not list(bpe.divided("", 2))
