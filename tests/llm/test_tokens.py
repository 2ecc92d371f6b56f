import random
import zlib

import numpy as np
import pytest

from tokenizers import Tokenizer

from stratalog.llm import packing, sstable, tokens
from stratalog.llm.queries import tokenizer_file
from stratalog.llm.tokens import ByteEncoder, WordEncoder

ODD = ["", "\n", " a", "a ", "a  b", "a\n\nb", "a\n", "\n\na\n \nb  c\t\td  ", "don't we'll 'sx", "x y z　w", "a\u0085b", "\x1cq r\x1d s", "é ̈a <|endoftext|> b", "ÀÉ ß İI ΑΣ", "x y  z"]


def odd_texts(n, seed):
    r = random.Random(seed)
    alphabet = " \n\t a'sB1éH\u0331×&² ́.,-|<>\x1c​中"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize(("cls", "name"), [(ByteEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_ids_are_the_library_s(cls, name):
    for limit in (10, 400_000):
        e, plain = cls(tokenizer_file(name), limit), Tokenizer.from_file(tokenizer_file(name))
        for seed in range(2):
            texts = odd_texts(1500, seed)
            want = [np.asarray(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
            assert list(e.encode(texts)) == want


@pytest.mark.parametrize(("cls", "name"), [(ByteEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_texts_longer_than_a_chunk(cls, name, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 300)
    monkeypatch.setattr(tokens, "_BLOCK", 7)
    texts = [" ".join(["Word, two.", "ÀÉ'llo!", "H\u0331 x"] * 40), "", "a<|endoftext|>b" * 50, "", ""]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(tokenizer_file(name)).encode_batch(texts, add_special_tokens=False)]
    assert list(cls(tokenizer_file(name)).encode(texts)) == want and list(cls(tokenizer_file(name)).encode([])) == []


def test_ids_too_large_for_a_shard_are_refused(tmp_path):
    w = sstable.Writer(open(tmp_path / "s", "wb"), 2)
    with pytest.raises(ValueError, match="70000"):
        w.add(1, (70_000).to_bytes(4, "little"))


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(150):
        capacity = r.choice([1, 7, 50, 64])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 150))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        moves, bins = packing.plan(histogram, capacity)
        fill = [[] for _ in range(bins)]
        for m in moves:
            for k in range(m.count):
                fill[m.first + k // m.each].append((m.offset + k % m.each * m.length, m.length))
        for b in fill:
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(n for b in fill for _, n in b) == sorted(lengths)
        assert sorted(capacity - sum(n for _, n in b) for b in fill) == slow_best_fit(lengths, capacity)


def test_cut():
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096) == [(0, 2048), (2048, 2048)] and packing.cut(3) == [(0, 3)] and packing.cut(0) == []


def rows_of(spark, n=60):
    texts = odd_texts(n, 8) + [None, "word " * 9000]
    rows = [(i * 3 - 20, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (1, "again", "x", 1), (1, "again", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int"), rows


def library_ids(name, text, end):
    e = WordEncoder(tokenizer_file(name))
    return np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_round_trip(spark):
    d, rows = rows_of(spark)
    pieces = packing.materialise(packing.tokenised_pieces(d, tokenizer_file("byte_bpe_50k.json")), "pieces")
    placed, bins = packing.pack(pieces)
    got = placed.collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(used) == bins
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(2048 - sum(n for _, n in p) for p in used.values()) == slow_best_fit([r["length"] for r in got], 2048)
    for i, t, *_ in rows:
        if i != 1:
            mine = sorted((r["start"], bytes(r["ids"])) for r in got if r["id"] == i)
            assert b"".join(x for _, x in mine) == library_ids("byte_bpe_50k.json", t, 0).tobytes()
    whole = packing.sequences(placed.filter("id <> 1"), pieces.filter("id <> 1"))
    assert sum(len(r["ids"]) for r in whole.collect()) == 4 * sum(r["length"] for r in got if r["id"] not in (None, 1))
    assert packing.pack_documents(d.limit(0), tokenizer_file("byte_bpe_50k.json")).collect() == []


def test_packing_refuses_what_no_sequence_takes(spark):
    with pytest.raises(Exception, match="no sequence takes"):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "id long, piece int, length long"), capacity=8)


def test_sstable_round_trip(spark):
    d, rows = rows_of(spark)
    manifest = sstable.write_shards(d.repartition(7), tokenizer_file("word_bpe_49k.json"), sstable.scratch(spark, "t"))
    back = sstable.read_shards(spark, manifest).collect()
    back.sort(key=lambda r: r["start"])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert [r["doc_id"] for r in back] == [r[0] for r in ordered]
    for got, (i, t, *_) in zip(back, ordered, strict=True):
        want = library_ids("word_bpe_49k.json", t, 1).tobytes() if i != 1 else bytes(got["ids"])
        assert got["start"] == at and bytes(got["ids"]) == want
        at += len(got["ids"]) // 4
    table = sstable.tokenised_table(d, tokenizer_file("word_bpe_49k.json")).collect()
    assert min(table, key=lambda r: r["start"])["doc_id"] is None
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in table) == sorted((str(r["doc_id"]), zlib.crc32(r["ids"])) for r in back)
    assert sstable.tokenised_table(d.limit(0), tokenizer_file("word_bpe_49k.json")).collect() == []


def test_sstable_lookup(tmp_path):
    r = random.Random(6)
    keys = sorted({r.randint(-(2**63), 2**63 - 1) for _ in range(900)} | {-(2**63), 2**63 - 1, 0, -1})
    want = {k: np.array([r.randrange(49_408) for _ in range(r.randint(0, 40))], "<u4").tobytes() for k in keys}
    path = tmp_path / "a.sst"
    w = sstable.Writer(open(path, "wb"), block=700)
    w.add(None, b"")
    for k in keys:
        w.add(k, want[k])
        if k == 0:
            for _ in range(60):
                w.add(k, want[k])
    with pytest.raises(ValueError, match="order"):
        w.add(5, b"")
    w.close()
    reader = sstable.Reader(open(path, "rb"))
    assert len(reader.index) > 20 and all(reader.get(k) == [want[k]] for k in keys if k) and reader.get(None) == [b""]
    assert reader.get(0) == [want[0]] * 61
    absent = [k for k in (r.randint(-(2**63), 2**63 - 1) for _ in range(2000)) if k not in want]
    assert all(reader.get(k) == [] for k in absent) and sum(map(reader.may_hold, absent)) < 0.05 * len(absent)
    damaged = bytearray(path.read_bytes())
    damaged[40] ^= 1
    (tmp_path / "b.sst").write_bytes(damaged)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(open(tmp_path / "b.sst", "rb")))


def test_a_worker_tokenises_by_portions(spark):
    import pyarrow as pa

    texts = ["é" * 40, "a" * 300, "", "b" * 99, "c", "d" * 30]
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array(texts)], names=["id", "text"])
    got = list(packing.portions(iter([batch, batch.slice(0, 0), batch.slice(3)]), "text", 100))
    assert [p["id"].to_pylist() for p in got] == [[0], [1], [2, 3, 4], [5], [3, 4], [5]]
    # with a null id beside them, ids beyond 2^53 once went through floats
    d = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c"), (-(2**53) - 1, None)], "doc_id long, text string").coalesce(1)
    rows = packing.tokenised_pieces(d, tokenizer_file("byte_bpe_50k.json")).collect()
    assert [r["id"] for r in rows] == [None, 2**60 + 1, -(2**53) - 1] and rows[2]["ids"] == bytearray(4)
