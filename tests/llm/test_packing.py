import zlib

import numpy as np
from tokenizers import Tokenizer

from fluxframe.llm.packing import Encoder, best_fit_decreasing, pack_documents, packing_query, sequences, tokenizer_path

SF = "/root/testdata/sf0.01"


def check(rows, texts, window=4096):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, by_seq = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for put in by_seq.values():
        at = 0
        for offset, length in sorted(put):
            assert offset == at
            at += length
        assert at <= window
    return len(by_seq), sum(r.length for r in rows)


def test_every_id_once_and_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, tokens = check(packing_query(spark, SF).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert n <= tokens / 4096 * 1.01 + 1


def test_odd_rows_and_sequences(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "Straße İstanbul ΣΑΣ ' s 's don't \x1c\x85\xa0  <|endoftext|> é", 5: "wörd " * 30_000, 6: "x"}
    df = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id bigint, text string, length int")
    packed = pack_documents(df)
    check(packed.collect(), texts)
    seqs = sequences(packed).collect()
    assert sum(s.n_tokens for s in seqs) == sum(len(s.ids) // 4 for s in seqs) == packed.groupBy().sum("length").first()[0]
    assert pack_documents(df.limit(0)).count() == 0
    assert pack_documents(df.filter("doc_id = 6").union(df.filter("doc_id = 6"))).count() == 2


def test_tightest_window_is_found():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400)
    where, offset = best_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fit = [r for r in room if r >= lengths[i]]
        if fit:
            room.remove(min(fit))
        left = (min(fit) if fit else 100) - lengths[i]
        room.append(left)
        want[i] = 100 - left - lengths[i]
    assert [want[i] for i in range(400)] == offset.tolist()
    assert max(np.bincount(where, weights=lengths)) <= 100


def test_small_cache_changes_nothing():
    texts = ["a b c d e f g", "h i j k", "a h z"]
    assert Encoder(tokenizer_path(), 3).ids(texts) == Encoder(tokenizer_path()).ids(texts)


def test_ids_of_every_code_point_are_the_tokenizers():
    known, own = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    texts = [f"{c} a{c}b {c}{c} {c.upper()}C{c.lower()} x{c.upper()} 1{c}2" for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"]
    texts += ["ŞƏHƏR", "Əliyev", "AZƏRBAYCAN", "Ɓauna", "Ɗan", "Ewe: Ɖe", "\U0001f600 x\U00010400y"]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for text, want, got in zip(part, known.encode_batch(part, add_special_tokens=False), own.ids(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, [hex(ord(x)) for x in text]


def test_another_tokenizer_file_gets_whole_texts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    own, tokenizer = Encoder(path), Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "  Two  spaces, CAPITALS\n\n", "xy " * 200_000]
    assert not own.splits and Encoder(tokenizer_path()).splits
    assert own.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
