"""Operators 3, 5 and 10 against the tokenisers' own libraries."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, empty, texts
from tidemark.llm import bytebpe, idfile, packing
from tidemark.llm.encoders import Dropped, Spaced

ODD = ["a  b\n\n c 0 1 x0y's I'll 　 x   y  ", "  ", "", "\x1c a \x1d", "ó é\n 12 ½ ٣ x٣ ​ q'", "<|endoftext|> a<|endoftext|> 0 0", "ÀÉ ǅ ſ K ΑΣ Σ", "a\r\n b\tc\x0b\x0cd \x85 e", "word, 0 next 00 '0' 's 'S 'T", " 0 0", "end.\nA B. c!\"", "x...y,,'s", "a\u3000  b \u2003 c\u2003\n d\xa0 e", "x <|endoftext|>.  <|startoftext|>y<|endoftext|>\n z<|endof text|>"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4")


def ranks():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})


@pytest.mark.parametrize("kind,name", [(Spaced, "byte_bpe_50k.json"), (Dropped, "word_bpe_49k.json")])
def test_chunks_give_the_library_ids(kind, name):
    own, lib = kind(P.path(name)), library(name)
    for text in [*ODD, *(t or "" for _, t in texts())]:
        assert own.ids(pa.array([text]))[0].tolist() == lib(text).tolist(), text
    together, bounds = own.ids(pa.array([None, *ODD, "", *ODD]), 7)
    want = [[7], *([*lib(x).tolist(), 7] for x in ODD), [7], *([*lib(x).tolist(), 7] for x in ODD)]
    assert [together[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sltremd 0½.,!\n\t é中🙂\x1c"), max_size=40))
def test_pre_tokens_by_scan(text):
    if not hasattr(test_pre_tokens_by_scan, "made"):
        test_pre_tokens_by_scan.made = (bytebpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken")), ranks())
    own, lib = test_pre_tokens_by_scan.made
    (ids, _), (ids2, _) = own.encode([text, text[::-1]])
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
    assert np.frombuffer(ids2, "<u4").tolist() == lib.encode_ordinary(text[::-1])
    assert own.decode(ids) == text.encode()


def test_long_pieces_merge_alike():
    own = bytebpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"))
    piece = (b"abacabadab" * 40)[:390]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    whole = own._merged_long(parts)
    assert np.frombuffer(whole, "<u4").tolist() == ranks().encode_ordinary(piece.decode())


def test_byte_bpe_query(spark):
    lib = ranks()
    want = sorted((str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts() for x in [lib.encode_ordinary(t or "")])
    got = bytebpe.encoded(spark, documents(spark), P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    full = bytebpe.encoded(spark, documents(spark), P.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)
    assert all(sum(r.token_bytes) == len((dict(texts())[r.doc_id] or "").encode()) for r in full.where("doc_id < 10").collect())
    assert bytebpe.encoded(spark, empty(spark), P.path("byte_bpe_multi_50k.tiktoken")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.data())
def test_bit_packing_round_trip(width, ids, data):
    ids = np.array([x % (1 << width) for x in ids], "<u4")
    block = idfile.pack_bits(ids, width)
    assert idfile.read_ids(block).tolist() == ids.tolist()
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert idfile.read_ids(block, first, count).tolist() == ids[first : first + count].tolist()


def test_width_and_errors():
    assert idfile.width_of(49408) == 16 and idfile.width_of(65537) == 17 and idfile.width_of(1) == 1
    with pytest.raises(ValueError):
        idfile.pack_bits(np.array([4], "<u4"), 2)
    with pytest.raises(IndexError):
        idfile.read_ids(idfile.pack_bits(np.array([1], "<u4"), 2), 0, 2)


def test_token_files(spark):
    lib = library("word_bpe_49k.json")
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in texts()), key=lambda r: r[:3])
    start, want = 0, []
    for _, _, t, i in rows:
        x = np.append(lib(t), np.uint32(1)).astype("<u4")
        want.append((str(i), start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    written = idfile.write(spark, documents(spark), P.path("word_bpe_49k.json"))
    got = sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in idfile.read_documents(written).collect())
    assert got == sorted(want)
    assert idfile.read_documents(idfile.write(spark, empty(spark), P.path("word_bpe_49k.json"))).count() == 0


def test_packing(spark):
    lib = library("byte_bpe_50k.json")
    ids = [(str(i), np.append(lib(t), np.uint32(0)).astype("<u4")) for i, t in texts()]
    want = []
    for i, x in ids:
        n = len(x)
        cut = [0, *range(n % 2048 or 2048, n + 1, 2048)] if n > 2048 else [0, n]
        want += [(i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    got = packing.packed(spark, documents(spark), P.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(spark, empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(3)
    counts = np.bincount(np.minimum(2048, r.geometric(1 / 500, 30_000)), minlength=2049)
    made, from_patterns = packing.plan(counts, 2048)
    used = np.zeros_like(counts)
    for held, k in made:
        assert sum(held) <= 2048
        for v in held:
            used[v] += k
    assert (used == counts).all()
    short = lambda rows: sum(k * len(held) for held, k in rows if held != (2048,))
    assert short(made[:from_patterns]) > 0.5 * short(made) and all(sum(held) == 2048 for held, _ in made[:from_patterns])
    assert sum(k for _, k in made) <= 1.01 * -(-int((counts * np.arange(2049)).sum()) // 2048)


def test_fit_decides():
    """Without the fit no pattern is used; with it most pieces come from patterns, each with a fitted count of a half or more, in no more sequences."""
    r = np.random.default_rng(7)
    counts = np.bincount(np.minimum(2048, r.geometric(1 / 700, 20_000)), minlength=2049)
    made, from_patterns = packing.plan(counts, 2048)
    bare, none = packing.plan(counts, 2048, lambda rows, left: np.zeros(len(rows)))
    bins = lambda rows: sum(k for _, k in rows)
    assert all(held == (2048,) for held, _ in bare[:none]) and bins(made) <= bins(bare)
    short = lambda rows: sum(k * len(held) for held, k in rows if held != (2048,))
    assert short(made[:from_patterns]) > 0.5 * short(made)
    rows = packing.patterns(np.where(np.arange(2049) < 2048 // packing.SPARE, 0, np.where(np.arange(2049) < 2048, counts, 0)), 2048)
    assert (rows.sum(1) == 2048).all()
    x = defaultdict(float)  # a multiset may be listed twice
    for row, v in zip(rows.tolist(), packing.fitted(rows, np.where(np.arange(2049) < 2048, counts, 0)).tolist(), strict=True):
        held = tuple(sorted((n for n in row if n), reverse=True))
        x[held] = max(x[held], v)
    assert all(x[held] >= 0.5 and k <= x[held] + 0.5 for held, k in made[:from_patterns] if held != (2048,))


def test_fit_is_a_least_squares_minimum():
    """Three patterns, by hand: the weighted minimum has no count that could move, and the one that is not needed stays at 0."""
    rows = np.array([[4, 4, 0, 0], [2, 6, 0, 0], [2, 2, 4, 0]])
    counts = np.zeros(9, np.int64)
    counts[[2, 4, 6]] = [10, 8, 10]
    x = packing.fitted(rows, counts, least=1e-6)
    assert x == pytest.approx([4, 10, 0], abs=1e-3)
    assert len(packing.fitted(np.zeros((0, 4), np.int64), counts)) == 0
