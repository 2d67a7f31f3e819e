"""Chat formatting, fill-in-the-middle and collocations against plain versions."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tesserae.llm import byte_bpe, chat_format, collocations, fill_middle, queries  # noqa: E402
from tesserae.llm import textbytes as tb  # noqa: E402

VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()
BITS = [*chat_format.MARKS, "<", "[", "\\", "\\\\", "s>", "/s>", "INST]", " a", "é", "\n", "<\\", "[\\/INST]"]


@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_hide_all_marks(text):
    hidden = chat_format.escaped(text)
    assert chat_format.unescaped(hidden) == text
    assert not any(mark in hidden for mark in chat_format.MARKS)


def test_masks_cover_the_assistant_alone():
    own = chat_format.template(*VOCABULARY)
    roles, texts = ["system", "user", "assistant", "assistant", "tool", "assistant"], ["s", "</s>u", "a</s>", "", "t[/ROLE]", "end"]
    ids, mask, ends = own.assemble(roles, texts)
    assert len(ids) == len(mask) == ends[-1] and set(mask.tolist()) == {0, 1}
    turns = list(own.turns(ids, mask))
    assert [(t[0], t[1]) for t in turns] == list(zip(roles, texts))
    assert [t[3] for t in turns] == ["", "", "a</s>", "", "", "end"]
    printed = "".join(t[2] for t in turns)
    assert printed == "<<SYS>>s<</SYS>><s>[INST]<\\/s>u[/INST]a<\\/s></s></s>[ROLE]tool[TEXT]t[\\/ROLE][/ROLE]end</s>"
    assert (ids[mask == 1] < own.first).all()


def chat_rows():
    long = "very long text, [INST] " * 30_000
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, None, "no role"), (2, None, "user", "no turn"), (3, 0, "tool", ""),
        (None, 1, "assistant", "x"), (None, 0, "user", "y"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"),
        (5, 0, "user", long), (5, 1, "assistant", long), (6, 0, "<s>", "[ROLE] in a role"), (7, 0, "assistant", "çà 😀 \x00</s>\\"), (8, 0, "", ""),
        (10, 0, "user", " " * 1_200_000 + "x"),
    ]
    return rows + [(9, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(3_000)]


def want_digests(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        turns[conv].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    for conv, found in turns.items():
        found.sort()
        loss = "".join(t for _, r, _, t in found if r == "assistant")
        yield conv, len(found), SHA("".join(f"{r}\n{t}\n" for _, r, _, t in found)), len(loss), SHA(loss)


@pytest.mark.parametrize("part_ids", [1 << 20, 50])
def test_chats(spark, part_ids):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, ids long").repartition(5)
    found = queries.stored(chat_format.formatted(df, *VOCABULARY, part_ids=part_ids), "chats")
    got = chat_format.digests(found, *VOCABULARY).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want_digests(rows))
    sizes = {r.conv_id: r.n for r in found.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert (sizes[9] > 5) == (part_ids == 50)
    turns = chat_format.read_turns(found, *VOCABULARY).orderBy("conv_id", "part", "place").collect()
    assert len(turns) == len(rows)
    printed = defaultdict(int)
    for t in turns:
        printed[t.conv_id] += len(t.printed)
    assert printed == {r.conv_id: r.formatted_chars for r in got}


def test_no_chats(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted(df, *VOCABULARY), *VOCABULARY).count() == 0


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def want_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = SHA(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 7, n).astype(np.uint8)
        matrix, at = fill_middle.WaveletMatrix(symbols), np.arange(n + 1)
        for s in range(7):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]


def test_fill_middle(make, awkward):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab é😀\n\t<"), rng.integers(0, 60))) for _ in range(400)]
    rows = [*awkward, *((100 + i, t) for i, t in enumerate(texts)), (2000, "a <P> b"), (2001, "<M>"), (2002, "é" * 70_000 + " ")]
    found = fill_middle.fill_middle(make(rows))
    assert Counter(map(tuple, found.collect())) == Counter(want_middle(i, t) for i, t in rows)
    back = found.select("doc_id", fill_middle.restored_text().alias("text")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(make([])).count() == 0


def test_marks_across_cuts_are_restored(make):
    rows = [(i, "<<P <P P> S><S <M>"[: i % 19] + " <P" * (i % 3) + "> x") for i in range(300)]
    found = fill_middle.fill_middle(make(rows), rate=100).select("doc_id", fill_middle.restored_text().alias("text"))
    assert Counter(map(tuple, found.collect())) == Counter(rows)


def want_phrases(rows, least, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {k: n for k, n in counts.items() if n >= least}
    covered = set()
    for (lang, words), n in frequent.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = words[i : i + m]
                if 100 * n >= 80 * frequent[lang, inner]:
                    covered.add((lang, inner))
    out = defaultdict(list)
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in covered:
            cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, totals[lang], -score


def phrase_rows():
    rng = np.random.default_rng(9)
    words = ["new", "York", "city", "the", "of", "é", "ß1", "a\x1cb", "end", "x"]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.integers(0, 30)):
            parts.append(rng.choice(["New York city", "of the", "a b c d", *words]))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \x0b", "? "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]))
        rows.append((["en", "fr", None, "und"][i % 4], "".join(parts)))
    return rows + [("en", None), ("en", ""), (None, " . "), ("en", "word " * 3000), ("fr", "no. stop" * 5000), ("xx", "rare words here")]


@pytest.mark.parametrize("least, ranked, top", [(30, 1 << 20, 2000), (3, 1 << 20, 2000), (3, 4, 2000), (5, 0, 20)])
def test_collocations(spark, least, ranked, top, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3_000)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 5, "p", 1) for r in rows], "lang string, text string, a long, phrase string, h long").repartition(3)
    found = collocations.collocations(df, min_count=least, ranked=ranked, bits=1 << 16, top=top)
    assert sorted(map(tuple, found.collect())) == sorted(want_phrases(rows, least, top))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_no_collocations(make):
    assert collocations.collocations(make([])).count() == 0
    assert collocations.collocations(make([(1, None), (2, "one two")])).count() == 0


def test_dense_and_sparse_tiles_count_alike():
    rng = np.random.default_rng(1)
    a, b = np.minimum(rng.geometric(0.01, 60_000), 900), rng.integers(0, 700, 60_000)
    want = Counter(zip(a.tolist(), b.tolist()))
    for dense in (1, 200, 5_000, 10**9):
        first, second, counts = collocations.count_tiles(a, b, 5, dense)
        assert len(first) == len(want) and dict(zip(zip(first.tolist(), second.tolist()), counts.tolist())) == want
    assert not len(collocations.count_tiles(a[:0], b[:0])[0])


def test_scores_are_exact(spark):
    a = 4_611_686_018_427_387_904
    row = spark.createDataFrame([(a, [a, a], [a + 1, a])], "a long, heads array<long>, tails array<long>").select(collocations.weakest_cut(2).alias("c")).first()
    assert row.c.score == 2_000_000 * a // (a + a + 1)


def test_long_runs_of_white_space():
    own = byte_bpe.codec(*VOCABULARY)
    for blank, after in itertools.product((" ", "\n", " \n", "\t", "　"), ("", "x", "\x1c")):
        for n in (byte_bpe.LONG_RUN - 1, byte_bpe.LONG_RUN + 1, 5_000):
            text = "ab " + (blank * n)[:n] + after
            for piece in (7, 1_001, 1 << 16):
                assert own.encode(text, piece).tolist() == own.encoding.encode_ordinary(text)
        text = "word " + (blank * 2_000_000)[:2_000_000] + after
        ids = own.encode(text)
        assert own.decode(ids) == text.encode()
        assert len(ids) <= len(text.encode())


def test_words_are_spelled_as_found():
    batch = pa.record_batch([pa.array(["en"]), pa.array(["Ab, çd\tEF. x"])], ["lang", "text"])
    (_, found), = collocations.sequences(batch)
    assert found.spelled(np.arange(4)).to_pylist() == ["ab", "çd", "ef", "x"]
    assert found.piece.tolist() == [1, 2, 2, 3] and tb.document_of(found.words.offsets).tolist() == [0] * 4
