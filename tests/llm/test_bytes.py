"""Token files, byte-level BPE, suffix-array deduplication and string tiling."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tesserae.llm import byte_bpe, string_tiling, suffix_array, token_packing  # noqa: E402
from tesserae.llm import textbytes as tb  # noqa: E402

WORD_BPE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_packing_round_trip(bits, values):
    ids = np.array(values, np.uint32) & np.uint32((1 << bits) - 1)
    assert token_packing.unpack(token_packing.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    assert len(token_packing.pack(ids, bits)) == (len(ids) * bits + 7) // 8


def test_random_access():
    rng = np.random.default_rng(0)
    for bits in (1, 7, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 1000).astype(np.uint32)
        ends = np.sort(rng.integers(0, 1001, 9))
        ends = np.append(ends, 1000)
        reader = token_packing.Reader(io.BytesIO(token_packing.to_bytes(np.arange(10), ends, ids, bits, block_ids=64)))
        for a, b in ((0, 1000), (63, 65), (64, 64), (100, 700), (999, 1000)):
            assert reader.ids(a, b).tolist() == ids[a:b].tolist()
        assert [len(reader.document(i)) for i in range(10)] == np.diff(ends, prepend=0).tolist()


TRICKY = ["It's THE end... don't!!", "ÉCOLE école é İstanbul ΟΔΟΣ", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd", "12345 3.14", "!?.,;:", "x.", ".x", "'s 't", "中文，标点。", "a'. a<. İ. e\u0301. x%%% y###, z|> q-- '. ... %x% a.b."]


def test_words_encode_as_whole_texts():
    own = token_packing.WordEncoder(WORD_BPE)
    texts = [*TRICKY, "", " ".join(TRICKY), None]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    starts = [0, *ends[:-1]]
    for text, a, b in zip(texts, starts, ends):
        assert ids[a:b].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_other_spellings_of_special_tokens_are_text():
    own = token_packing.WordEncoder(WORD_BPE)
    texts = ["<|EndOfText|>a", "A<|STARTOFTEXT|>. <|endoftext|>A", "X<|endoftext|><|Endoftext|>..", "<|endoftext|>a"]
    ids, ends = own.encode(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_every_document(make, awkward, tmp_path):
    docs = make(awkward)
    manifest = token_packing.write_packed(docs, str(tmp_path), WORD_BPE, docs_per_file=4)
    assert manifest.count() > 1
    got = token_packing.read_packed(docs.sparkSession, str(tmp_path), manifest).orderBy("start").collect()
    own, start = token_packing.WordEncoder(WORD_BPE).tokenizer, 0
    key = lambda p: (p[0] is not None, p[0] or 0)
    assert len(got) == len(awkward)
    for row, (i, text) in zip(got, sorted(awkward, key=key)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (i, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_packing.packed_documents(make([]), WORD_BPE).count() == 0


def test_long_texts_split_safely():
    own = byte_bpe.codec(RANKS, P.PATTERN)
    for text in ["it's  a test \n\n of   spaces " * 40, "a" * 3000, " " * 3000 + "b", "don't 's 'll x" * 99, "   x y" * 99, *TRICKY]:
        for piece in (1, 7, 64):
            ids = own.encode(text, piece)
            assert ids.tolist() == own.encoding.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_rows(make, awkward):
    docs = make(awkward)
    found = byte_bpe.encoded(docs, RANKS, P.PATTERN, with_ids=True)
    got = sorted(((r.doc_id or -1), r.n_tokens, r.decoded_sha256) for r in found.collect())
    own = byte_bpe.codec(RANKS, P.PATTERN).encoding
    want = sorted((i or -1, len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in awkward)
    assert got == want
    back = byte_bpe.decoded(found, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in awkward)
    assert byte_bpe.encoded(make([]), RANKS, P.PATTERN).count() == 0


def brute_removed(docs, width):
    first = {}
    for i, t in docs:
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = True
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("split", [10**6, 3])
def test_removed_bytes(spark, make, split, monkeypatch):
    monkeypatch.setattr(suffix_array, "SPLIT_BLOCKS", split)
    rng = np.random.default_rng(split)
    pieces = ["".join(rng.choice(list("abç"), rng.integers(5, 60))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pieces, rng.integers(1, 8)))) for i in range(60)] + [(60, "a" * 300), (61, "a" * 290 + "b")]
    docs += [(62, docs[3][1]), (63, "z" + docs[4][1])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.deduplicated(make(docs), 24).collect()}
    assert got == brute_removed([(i, t.encode()) for i, t in docs], 24)


def test_repeats_are_maximal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        blocks = [bytes(rng.choice([97, 98], rng.integers(6, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        data = np.frombuffer(b"".join(blocks), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        length, places, offsets = suffix_array.maximal_repeats(data, bounds, 5)
        got = {(int(n), tuple(sorted(places[a:b].tolist()))) for n, a, b in zip(length, offsets[:-1], offsets[1:])}
        where = {}
        for k, b in enumerate(blocks):
            for p in range(len(b)):
                for e in range(p + 5, len(b) + 1):
                    where.setdefault(b[p:e], []).append((k, p))
        want = set()
        for s, at in where.items():
            left = {(k, p) if p == 0 else blocks[k][p - 1] for k, p in at}
            right = {(k, p) if p + len(s) == len(blocks[k]) else blocks[k][p + len(s)] for k, p in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(int(bounds[k]) + p for k, p in at))))
        assert got == want


def test_deduplication_of_awkward_rows(make, awkward):
    got = suffix_array.deduplicated(make(awkward), with_text=True).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r for r in got}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[5].n_removed == 0 and by[None].n_removed == 0
    assert by[11].n_removed == by[11].n_bytes and by[11].kept == "" and by[1].n_removed == 0
    assert suffix_array.deduplicated(make([])).count() == 0
    cut = suffix_array.without_repeats(make(awkward))
    assert cut.columns == make(awkward).columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[2].text is None and rows[11].text == "" and rows[11].n_chars == 0 and rows[7].text == awkward[8][1]


def brute_tiles(pattern, text, least):
    marked, used, total = [False] * len(pattern), [x == 0 for x in text], 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not marked[p + k] and not used[t + k]:
                    k += 1
                best = max(best, (k, p, t), key=lambda b: b[0])
        if best[0] < least:
            return total
        for i in range(best[0]):
            marked[best[1] + i] = used[best[2] + i] = True
        total += best[0]


def test_tiles_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(120):
        pattern = rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64)
        found = string_tiling.tiles(pattern, text, 3)
        assert sum(n for _, _, n in found) == brute_tiles(pattern.tolist(), text.tolist(), 3)
        assert all(pattern[p : p + n].tolist() == text[t : t + n].tolist() for p, t, n in found)


def test_reordered_passages_are_found(spark, make, awkward):
    item = "alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu! Nu xi omicron pi rho sigma."
    parts = ["nu xi omicron pi rho sigma", "ALPHA beta, gamma delta epsilon zeta", "eta theta iota kappa lambda mu"]
    docs = make([*awkward, (20, "before " + " between ".join(parts) + " after"), (21, "alpha beta gamma delta epsilon and nothing else"), (22, item)])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "too short")], "item_id long, text string")
    found = {r.doc_id: r for r in string_tiling.contaminated(docs, items).collect()}
    assert set(found) == {20, 21, 22}
    assert found[20].coverage == 1.0 and found[20].contaminated and found[22].contaminated and not found[21].contaminated
    left = {r.doc_id for r in string_tiling.without_contaminated(docs, items).collect()}
    assert 20 not in left and 22 not in left and {21, None, 2, 3, 5} <= left
    assert string_tiling.contaminated(make([]), items).count() == 0
    assert string_tiling.contaminated(docs, items.limit(0)).count() == 0


def test_items_without_an_id(spark, make):
    first, own = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    docs = make([(1, f"so {first} it is"), (2, f"so {own} it is"), (3, f"{own} {first}"), (4, "nothing of the kind at all here")])
    items = spark.createDataFrame([(7, first), (None, own), (None, None)], "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.contaminated) for r in string_tiling.contaminated(docs, items).collect()}
    assert found == {1: (7, True), 2: (None, True), 3: (7, True)}
    assert [r.doc_id for r in string_tiling.without_contaminated(docs, items).collect()] == [4]


def test_words_never_cross_documents():
    block = next(tb.blocks(pa.array(["ab", "cd ef", None, "", " g", "h"])))
    found = tb.words(block)
    assert [block.data[a:b].tobytes() for a, b in zip(found.start, found.end)] == [b"ab", b"cd", b"ef", b"g", b"h"]
    assert found.offsets.tolist() == [0, 1, 3, 3, 3, 4, 5]
