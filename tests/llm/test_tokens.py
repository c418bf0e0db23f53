"""Token ids against the tokenizer itself; files and packing as exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ixlake.llm.packing import Places, crc_behind, pack_documents, plan_groups, plan_patterns
from ixlake.llm.tokenfile import Segment, round_trip, write_segment
from ixlake.llm.tokens import encoder, tokenizer_path

EDGES = [
    None, "", "  \n", "Hello's world'll <|endoftext|>x <|ENDOFTEXT|>", "İstanbul ΑΣ ς ſt Ⱥx ŉ áb é. ﬁ 12345 don't. .,..",
    "日本語 ªº x　y z\x1cw áb é", "a" * 3000, "é" * 600 + ".", "Ça va? ÉTÉ! ß ẞ ĳ Ĳ µ", "x " * 5000, "😀" * 50,
]


@pytest.fixture(scope="module")
def ids_of():
    whole = Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_the_tokenizer(ids_of, all_docs):
    texts = EDGES + [r["text"] for r in all_docs.limit(60).collect()]
    starts, ids = encoder().encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == ids_of(text).tolist()
    assert encoder().encode(pa.array([], pa.string()))[1].tolist() == []


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("sizes", [[], [0], [1], [5, 0, 7], [100, 65_536, 3]])
def test_segment_round_trip(bits, sizes):
    random = np.random.default_rng(0)
    ids = random.integers(0, 2**32, sum(sizes), np.uint32)
    doc_ids = [None if i == 1 else i - 5 for i in range(len(sizes))]
    back = Segment(write_segment(doc_ids, np.array(sizes, np.int64), ids, bits, 1000))
    assert back.doc_ids == doc_ids and back.counts.tolist() == sizes
    assert (back.ids() == ids).all()
    if len(ids) > 1000:
        assert (back.block(1) == ids[1000:2000]).all()


def expected_tokens(rows, ids_of):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(ids_of, make_docs, tmp_path, bits):
    rows = [(100 - i, t) for i, t in enumerate(EDGES)]
    out = round_trip(make_docs(rows), str(tmp_path / "t"), bits=bits).collect()
    assert sorted(map(tuple, out)) == sorted(expected_tokens(rows, ids_of))


def test_token_files_of_documents(ids_of, all_docs):
    rows = [(r["doc_id"], r["text"]) for r in all_docs.collect()]
    assert sorted(map(tuple, round_trip(all_docs).collect())) == sorted(expected_tokens(rows, ids_of))


def test_token_files_edges(make_docs):
    assert round_trip(make_docs([])).count() == 0
    docs = make_docs([(None, "a"), (None, "a"), (3, "b"), (3, "b")]).selectExpr("*", "1 AS part", "2 AS payload")
    out = sorted(round_trip(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, None, 3, 3] and [r["start"] for r in out] == [0, 2, 4, 6]


def check_packed(rows, out, ids_of, most_padding):
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(ids_of(text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        copies = len(texts[doc_id])
        ids = texts[doc_id][0]
        found = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own)
        at, wanted = 0, []
        for start, length, _, _ in found[::copies]:
            assert start == at
            wanted += [(start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids))] * copies
            at += length
        assert at == len(ids) and wanted == found
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 2048 - at
    assert padding <= most_padding * 2048 * len(by_sequence)


def test_packing_documents(ids_of, all_docs):
    rows = [(r["doc_id"], r["text"]) for r in all_docs.collect()]
    check_packed(rows, pack_documents(all_docs).collect(), ids_of, 0.05)


def test_packing_edges(ids_of, make_docs):
    assert pack_documents(make_docs([])).count() == 0
    rows = list(enumerate(EDGES)) + [(1000 + i, "x " * (i * 13 % 2100)) for i in range(300)]
    rows += [(7000, "same words")] * 3 + [(None, "no id")]
    docs = make_docs(rows).selectExpr("*", "1 AS salt", "2 AS length", "3 AS start")
    check_packed(rows, pack_documents(docs).collect(), ids_of, 0.05)


def test_packing_one_hot_length(ids_of, make_docs):
    rows = [(i, "x " * 1499) for i in range(300)] + [(1000 + i, "x " * (i % 700)) for i in range(600)]
    check_packed(rows, pack_documents(make_docs(rows)).collect(), ids_of, 0.05)


@pytest.mark.parametrize("tokens", [1085, 1724])
def test_packing_a_hot_length_without_complements(ids_of, make_docs, tokens):
    text = "x " * (tokens - 2)
    text += "x" if len(ids_of(text)) < tokens else ""
    check_packed([(i, text) for i in range(600)], pack_documents(make_docs([(i, text) for i in range(600)])).collect(), ids_of, 0.02)


def test_checksum_of_the_ids_behind_a_cut():
    ids = np.random.default_rng(2).integers(0, 2**32, 2048, np.uint32)
    cuts = np.array([0, 16, 1024, 2032])
    before = np.array([zlib.crc32(ids[:c].tobytes()) for c in cuts])
    whole = np.full(len(cuts), zlib.crc32(ids.tobytes()))
    assert crc_behind(before, whole, 2048 - cuts).tolist() == [zlib.crc32(ids[c:].tobytes()) for c in cuts]


@pytest.mark.parametrize("top,hot", [(1, 0), (3, 4000), (500, 0), (0, 5000)])
def test_cut_plan_fills_every_place_once(top, hot):
    random = np.random.default_rng(top)
    histogram = random.integers(0, top + 1, 2049) * (random.random(2049) < 0.4)
    histogram[0] = 0
    histogram[1100] += hot
    places = Places(plan_groups(histogram))
    filled = defaultdict(list)
    for x in np.flatnonzero(histogram).tolist():
        ranks = np.arange(histogram[x])
        lengths = np.full(len(ranks), x)
        (sequence, offset), (cut, following) = places.of(lengths, ranks), places.cuts(lengths, ranks)
        for s, o, c, f in zip(sequence.tolist(), offset.tolist(), cut.tolist(), following.tolist(), strict=True):
            filled[s].append((o, c))
            if c < x:
                filled[f].append((0, x - c))
    assert len(filled) == places.sequences
    for own in filled.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at and size > 0
            at += size
        assert at <= 2048
    tokens = int((histogram * np.arange(2049)).sum())
    assert places.sequences * 2048 - tokens <= 0.01 * places.sequences * 2048 + 2 * 2048


def test_plan_uses_every_piece_once():
    random = np.random.default_rng(1)
    for top in (1, 3, 500):
        histogram = random.integers(0, top + 1, 2049) * (random.random(2049) < 0.4)
        histogram[0] = 0
        used = Counter()
        patterns = plan_patterns(histogram)
        for row, repeats in patterns:
            assert sum(row) <= 2048 and repeats > 0
            for x in row:
                used[x] += repeats
        assert all(used[x] == n for x, n in enumerate(histogram.tolist()))
        places, seen = Places(patterns), set()
        for x in np.flatnonzero(histogram).tolist():
            ranks = np.arange(histogram[x])
            sequence, offset = places.of(np.full(len(ranks), x), ranks)
            seen |= set(zip(sequence.tolist(), offset.tolist(), strict=True))
        assert len(seen) == histogram.sum()
