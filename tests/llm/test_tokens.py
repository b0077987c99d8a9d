import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import byte_bpe, elias_fano, packing, token_files, tokenizer

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
TEXT = st.text(alphabet=st.sampled_from(list(" \n\t ab.'sé1漢 \x1ć-")), max_size=40)


def plain(path, text):
    return array("I", tokenizer.tokenizer(path).encode(text or "", add_special_tokens=False).ids).tobytes()


def test_pieces_give_the_ids_of_whole_texts(odd_texts):
    for text in odd_texts:
        assert tokenizer.spaced_encoder(BYTE)(text or "") == plain(BYTE, text), text
        assert tokenizer.word_encoder(WORD)(text or "") == plain(WORD, text), text


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_give_the_ids_of_any_text(text):
    assert tokenizer.spaced_encoder(BYTE)(text) == plain(BYTE, text)
    assert tokenizer.word_encoder(WORD)(text) == plain(WORD, text)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe.ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(spark, odd_documents, no_documents, tiktoken_encoding):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.encode_documents(odd_documents, path, P.PATTERN).collect()
    texts = {(r.doc_id): r.text for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == tiktoken_encoding.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert byte_bpe.encode_documents(no_documents, path, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_bpe_equals_tiktoken_on_any_text(tiktoken_encoding, text):
    ids = np.frombuffer(byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)(text), "<u4").tolist()
    assert ids == tiktoken_encoding.encode_ordinary(text)


def test_merge_takes_the_leftmost_least_pair():
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"aa": 3, b"ab": 4, b"aaa": 5}
    assert byte_bpe.merge(b"aaaaab", ranks) == [3, 3, 4]
    assert byte_bpe.merge(b"caac", ranks) == [2, 3, 2]


@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    data = elias_fano.encode(np.array(values, np.int64))
    read = elias_fano.EliasFano(data)
    assert read.all().tolist() == values and [read.select(i) for i in range(len(values))] == values
    assert len(read) == len(values)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 3000, 20_000))
    assert len(elias_fano.encode(values)) * 8 / len(values) < 2.6 + np.log2(1500) + 1


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_token_files_round_trip(spark, odd_documents, segment, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    files = token_files.write_token_files(odd_documents, BYTE, 2)
    found = sorted(token_files.read_token_files(files.read()).collect(), key=lambda r: r.start)
    rows = sorted(odd_documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    for got, row in zip(found, rows, strict=True):
        ids = plain(BYTE, row.text) + array("I", [2]).tobytes()
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    files.drop()


def test_token_files_of_nothing(no_documents):
    assert token_files.read_token_files(token_files.write_token_files(no_documents, BYTE, 2).read()).count() == 0


@pytest.mark.parametrize(("window", "block"), [(4096, 1 << 20), (128, 1000), (16, 64)])
def test_packing_covers_every_id_once(spark, odd_documents, window, block):
    rows = packing.pack_documents(odd_documents, WORD, 2, window=window, stride=min(window, 16), block=block).collect()
    texts = defaultdict(list)
    for r in odd_documents.collect():
        texts[r.doc_id].append(np.frombuffer(plain(WORD, r.text) + array("I", [2]).tobytes(), "<u4"))
    pieces = Counter()
    for r in rows:
        ids = texts[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    assert pieces == Counter({(d, i): len(copies) for d, copies in texts.items() for i in range(len(copies[0]))})
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    parts = defaultdict(list)
    for s, spans in windows.items():
        parts[s >> 32].append((s, sum(x[1] for x in spans)))
    if window == 4096:  # as few windows as nearly full ones would be
        assert all(len(part) <= -(-sum(size for _, size in part) // (0.98 * window)) for part in parts.values())


def test_packing_of_nothing(no_documents):
    assert packing.pack_documents(no_documents, WORD, 2).count() == 0


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 6)), min_size=1, max_size=9), st.integers(8, 14))
def test_plan_is_optimal(steps, window):
    positions, costs = np.cumsum([s for s, _ in steps]), np.array([c for _, c in steps])
    where = [0, *positions.tolist()]
    fee = dict(zip(where, [0, *costs.tolist()], strict=True))

    def total(stops):
        return sum(window - (b - a) + fee[b] for a, b in zip([0, *stops], stops, strict=False))

    best = None
    for mask in range(1 << (len(steps) - 1)):
        stops = [p for k, p in enumerate(where[1:-1]) if mask >> k & 1] + [where[-1]]
        if all(b - a <= window for a, b in zip([0, *stops], stops, strict=False)):
            best = total(stops) if best is None else min(best, total(stops))
    stops = packing.plan(positions, costs, window)
    assert stops[-1] == where[-1] and total(stops) == best


def test_no_session_setting_changes(spark, odd_documents):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    files = token_files.write_token_files(odd_documents, BYTE, 2)
    rows = token_files.read_token_files(files.read()).orderBy("start").collect()
    assert spark.conf.get(name) == before
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_a_word_encoders_cache_is_smaller_and_holds_its_bound():
    from weftline.llm import pieces

    few = pieces.WordEncoder(lambda piece: piece.encode(), entries=10)
    text = " ".join(f"w{k % 37}" for k in range(500))
    assert few(text) == text.replace(" ", "").encode()
    assert len(few.cache) <= 10 and len(few.cache.older) <= 10
    assert pieces.WordEncoder(lambda piece: piece.encode()).cache.entries < pieces.SpacedEncoder(lambda piece: piece.encode()).cache.entries


def test_packing_alone_keeps_more_words_than_behind_other_stages(spark, monkeypatch):
    from weftline.llm import pieces, registry

    asked = {}
    monkeypatch.setattr(registry.packing, "pack_documents", lambda *_, **more: asked.update(more))
    registry.op1_packing(spark, "/root/testdata/sf0.001")
    assert asked["entries"] == pieces.CACHE_ENTRIES
    encoder = tokenizer.word_encoder(WORD, asked["entries"])
    encoder("one two three")
    assert encoder.cache.entries == pieces.CACHE_ENTRIES and encoder.cache
    assert tokenizer.word_encoder(WORD) is encoder and encoder.cache.entries == pieces.WORD_ENTRIES and not encoder.cache
