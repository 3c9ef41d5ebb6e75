"""Hashes of spans: no collisions by structure, the same at every length; texts beyond one block."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tests_support import brute_counts, prose, sets_of  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lexlake.llm import bpe, jaccard, packing, pretokens, quality, scan, token_files  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 1024, 2048, 4096])
def test_complements_differ(n):
    data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
    for values in (data, data.astype(np.uint32), scan.mix(data.astype(np.uint64))):
        a, b = scan.span_hashes(values, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_sections_agree():
    """A span has one hash wherever it lies, across sections too, and for each width of its values."""
    r = np.random.default_rng(1)
    own = r.integers(0, 256, scan.SECTION + 5000).astype(np.uint8)
    values = np.concatenate([own, r.integers(0, 256, 777).astype(np.uint8), own])
    starts, ends = np.array([0, len(own), len(own), len(own) + 777]), np.array([len(own), len(own), len(own) + 777, len(values)])
    h = scan.span_hashes(values, starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    assert (scan.span_hashes(values.astype(np.uint32), starts, ends) == h).all() and (scan.span_hashes(values.astype(np.uint64), starts, ends) == h).all()


TEXTS = [x for n in (1024, 2048) for w, c in [thue_morse(n)] for x in (w + "\n" + c, w + " x y z t " + c, c + " x y z t " + w, w, c)] + [prose(7, 400_000), "ab" * 700_000 + " tail"]


@pytest.fixture(scope="module")
def hard(spark):
    assert max(map(len, TEXTS)) > scan.BLOCK
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize(("path", "scheme"), [(BYTE, "byte"), (WORD, "word")])
def test_word_tables_are_exact(path, scheme):
    tokenizer, encoder = Tokenizer.from_file(path), pretokens.library_encoder(path, scheme)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for _ in range(2):  # the second time from the table
        assert [ids[at[k] : at[k + 1]].tolist() for i, j, ids, at in encoder.encode_blocks(pa.array(TEXTS)) for k in range(j - i)] == expected


def test_a_false_hit_is_seen():
    encoder = pretokens.PretokenEncoder(lambda found: [[ord(x[-1])] for x in found], "byte", {})
    first = next(encoder.encode_blocks(pa.array(["one two six"])))[2].tolist()
    encoder.entry[:] = encoder.entry[::-1]  # the table now leads to other words
    encoder.entry[encoder.keys > 0] = np.roll(encoder.entry[encoder.keys > 0], 1) * 0
    assert next(encoder.encode_blocks(pa.array(["one two six"])))[2].tolist() == first == [ord(x) for x in "eox"]


def test_operators(spark, hard):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    ids = [byte.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for r in bpe.bpe_round_trip(hard, BYTE).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest()
    for r in token_files.read_token_files(spark, token_files.write_token_files(hard, BYTE, end_id=2)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*ids[r.key], 2], "<u4").tobytes())
    ids = [np.array([*word.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in TEXTS]
    for r in packing.pack(hard, WORD).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for r in quality.quality_counts(hard).collect():
        assert tuple(r)[1:] == brute_counts(TEXTS[r.doc_id])
    for r in jaccard.jaccard_components(hard).collect():
        assert (r.n_shingles, r.component_id) == (len(sets_of(TEXTS[r.doc_id])), r.doc_id)


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_files_hold_large_ids(tmp_path, planes):
    """Ids beyond 16 bits come back; one beyond the largest is an error."""
    ids = np.array([0, 65_535, 65_536, 70_000, 4_000_000_000], "<u4")
    store = pa.fs.LocalFileSystem()
    writer = token_files.TokenFileWriter(store.open_output_stream(str(tmp_path / "a")), planes)
    for k in range(3):
        writer.add(np.array([k]), np.array([5]), ids)
    writer.close()
    with store.open_input_file(str(tmp_path / "a")) as source:
        assert [(k, at, x.tolist()) for k, at, x in token_files.TokenFileReader(source).documents()] == [(k, 5 * k, ids.tolist()) for k in range(3)]
    writer = token_files.TokenFileWriter(store.open_output_stream(str(tmp_path / "b")), planes, 65_536)
    writer.add(np.array([1]), np.array([3]), ids[:3])
    with pytest.raises(ValueError):
        writer.add(np.array([1]), np.array([1]), ids[3:4])


def test_token_files_roll_over(spark):
    """A large end id, several files a task, a null key: the same ids in the same order."""
    texts = [f"{k} {prose(k % 3, 3000)}" for k in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (7, texts[7])], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, BYTE, end_id=65_536, partitions=2, file_ids=500)
    assert manifest.count() > 4
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    byte = Tokenizer.from_file(BYTE)
    at = 0
    for r, (k, t) in zip(got, [(None, "x"), *((k, t) for k, t in enumerate(texts) for _ in range(1 + (k == 7)))], strict=True):
        ids = [*byte.encode(t, add_special_tokens=False).ids, 65_536]
        assert (r.key, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
