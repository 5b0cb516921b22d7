"""Token ids, BPE joins, packing and token files against the library, brute force and round trips."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sigspark.llm import bpe, packing, token_files
from sigspark.llm.tokenization import TextEncoder

ALPHABET = ["a", "B", "z", "'", "'s", " ", "  ", "\n", "\r", "\t", "1", "23", ",", "!", "é", "Ü", " ", " ", "中", "́",
            "😀", "—", "<|endoftext|>", "<|EndOfText|>", "\x85", "_", "İ", "ß", "\x00"]


def texts(seed, n, size):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe", "word_bpe"])
def test_column_encoding_equals_library(request, name):
    encoder = TextEncoder(request.getfixturevalue(name))
    rows = [*texts(1, 4000, 14), "", None]
    ids, off = encoder.encode_column(pa.array(rows))
    for i, t in enumerate(rows):
        assert ids[off[i]: off[i + 1]].tolist() == encoder.encode(t or "")


def test_join_equals_whole_encoding(byte_bpe):
    codec = bpe.worker_codec(byte_bpe)
    rnd = random.Random(3)
    for _ in range(400):
        data = bytes(rnd.choice(b"aehnt" + "é中".encode()) for _ in range(rnd.randint(2, 120)))
        cut = rnd.randint(0, len(data))
        assert codec.join(codec.encode(data[:cut]), codec.encode(data[cut:]), 1) == codec.encode(data)


def test_long_documents_by_tree(spark, byte_bpe):
    rnd = random.Random(4)
    rows = [("".join(rnd.choice("abcdeth") for _ in range(3000))), "a" * 4097, "the end " * 400 + "中文" * 900 + "!!'s" * 300,
            " " * 2000 + "x", "<|endoftext|>" + "b" * 2000, "", None, "a" * 4097]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    coded = bpe.encode_documents(df, byte_bpe, segment_bytes=200, leaf_bytes=16)
    got = {r.doc: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect()}
    encoder = TextEncoder(byte_bpe)
    assert got == {i: encoder.encode(t or "") for i, t in enumerate(rows)}
    back = {r.doc: r.text for r in bpe.decode_documents(coded, byte_bpe).collect()}
    assert back == {i: t or "" for i, t in enumerate(rows)}


def test_digests_on_odd_rows(odd_documents, byte_bpe):
    encoder = TextEncoder(byte_bpe)
    expected = []
    for r in odd_documents.collect():
        ids = encoder.encode(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(encoder.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(odd_documents, byte_bpe).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert bpe.digests(odd_documents.limit(0), byte_bpe).count() == 0


def least_bins(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i]:
                rooms[j] -= items[i]
                go(i + 1, rooms)
                rooms[j] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    items.sort(reverse=True)
    go(0, [])
    return best


def test_solver_against_exhaustive_search():
    rnd = random.Random(1)
    for _ in range(60):
        capacity = rnd.randint(10, 30)
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        counts = {a: items.count(a) for a in items}
        patterns = packing.solve(counts, capacity)
        used = {}
        for pattern, times in patterns:
            assert sum(a * k for a, k in pattern) <= capacity
            for a, k in pattern:
                used[a] = used.get(a, 0) + k * times
        assert used == counts
        assert sum(n for _, n in patterns) <= least_bins(items, capacity) + (len(items) > 7)


def test_solver_edges():
    assert packing.solve({}, 10) == []
    assert sum(n for _, n in packing.solve({10: 7, 5: 3}, 10)) == 9
    with pytest.raises(ValueError):
        packing.solve({11: 1}, 10)


def test_packed_pieces_cover_documents(odd_documents, byte_bpe):
    encoder = TextEncoder(byte_bpe)
    capacity = 64
    rows = packing.pack_documents(odd_documents, byte_bpe, capacity).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for r in odd_documents.collect():
        ids = [*encoder.encode(r.text or ""), 0]
        n = -(-len(ids) // capacity)
        head = len(ids) - (n - 1) * capacity
        bounds = [0, *(head + i * capacity for i in range(n))]
        expected += [(r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(((r.doc, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    assert packing.pack_documents(odd_documents.limit(0), byte_bpe).count() == 0


@pytest.mark.parametrize("block", [1, 100, 1024])
def test_blocks_round_trip(block):
    rng = np.random.default_rng(block)
    ids = np.concatenate([rng.integers(0, 300, 5000), rng.integers(0, 1 << 32, 70), np.full(600, 7), [0xFFFFFFFF]]).astype(np.uint32)
    file = token_files.TokenFile(token_files.write_file([5, None], np.array([5000, len(ids) - 5000]), ids, block))
    assert (file.ids() == ids).all()
    for a, b in ((0, 1), (99, 101), (4990, 5300), (len(ids) - 1, len(ids)), (5, 5)):
        assert (file.ids(a, b) == ids[a:b]).all()
    assert token_files.TokenFile(token_files.write_file([], np.zeros(0), np.zeros(0, np.uint32), block)).n_docs == 0


def test_token_files_in_id_order(spark, odd_documents, word_bpe):
    encoder = TextEncoder(word_bpe)
    path = token_files.write_token_files(odd_documents, word_bpe, 1, file_ids=500)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(odd_documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at = 0
    for r, o in zip(rows, got, strict=True):
        ids = [*encoder.encode(r.text or ""), 1]
        assert (o.doc, o.start, o.n_tokens) == (r.doc_id, at, len(ids))
        assert np.frombuffer(o.ids, "<u4").tolist() == ids
        at += len(ids)
