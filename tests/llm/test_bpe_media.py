import base64
import hashlib
import struct
import zlib

import pytest

from tidemark.llm import bpe, media

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [(1, "Hello  world's 12 é世界🙂\n\n x"), (2, ""), (3, None), (4, "a" * 30000), (5, "Hello  world's 12 é世界🙂\n\n x"), (5, "<|endoftext|>"), (None, "id is null"), (6, " \t\x1c\x85 ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_library(docs, library):
    got = sorted(map(tuple, bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    want = []
    for i, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_and_empty(spark, docs):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = bpe.decode(bpe.encode(docs, *args), *args).collect()
    assert sorted(bytes(r.data).decode() for r in got) == sorted(t or "" for _, t in TEXTS)
    assert bpe.encode(docs.limit(0), *args).count() == 0


def test_random_pieces_against_naive_merges(library):
    import random

    rnd = random.Random(5)
    v = bpe.Vocabulary.read(P.path("byte_bpe_50k.tiktoken"))
    pieces = [bytes(rnd.choice(b"abetion \xc3\xa9!") for _ in range(rnd.randint(2, 64))) for _ in range(400)]

    def naive(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            ranked = [(v.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            if not ranked or min(ranked)[0] == 1 << 60:
                return [v.ranks[x] for x in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    want = [naive(p) for p in pieces]
    assert bpe.merge_many(v, pieces) == want
    assert [bpe.merge_one(v, p) for p in pieces] == want


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_stored_texts(docs):
    rows = media.stored_texts(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = next((t for i, t in TEXTS if i == r.doc_id and len((t or "").encode()) == r.n_bytes))
        p = media.pad((t or "").encode())
        blob = media.wrap(p)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.codec) == (len(blob), hashlib.sha256(blob).hexdigest(), "raw")
        assert b"".join(blob[k.start : k.start + k.length] for k in r.keyframes[:1]) == p[:64]
    assert media.stored_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 64 * 255, 64 * 256, 64 * 257, 64 * 1000])
def test_container_round_trip(n):
    p = bytes(i * 7 % 256 for i in range(n))
    blob = media.wrap(p)
    (t,), error = media.inspect(blob)
    assert not error and media.read_samples(blob, t) == p and t.duration == n


def test_variable_sizes_many_chunks_and_no_sync_table():
    """A hand-made track: samples of 3, 5 and 2 bytes in two chunks with a gap between them."""
    data = b"AAABBBBB....CC"
    full, box = media.full, media.box
    head = 500
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))),
        full(b"stsz", struct.pack(">II3I", 0, 3, 3, 5, 2)),
        full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 2, 1, 1)),
        full(b"co64", struct.pack(">I2Q", 2, head, head + 12)),
    )
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 90000, 270000)), box(b"minf", stbl))))
    blob = moov + box(b"free", bytes(head - len(moov) - 16)) + box(b"mdat", data)
    (t,), error = media.inspect(blob)
    assert not error and (t.codec, t.timescale, t.duration) == ("avc1", 90000, 270000)
    assert media.read_samples(blob, t) == b"AAABBBBBCC"
    assert [x.tolist() for x in t.keyframes] == [[500, 503, 512], [3, 5, 2]]


def test_media_columns_of_faulty_files(spark):
    good = media.wrap(bytes(64 * 40))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:100])), (3, None), (4, bytearray(b"junk")), (5, bytearray(b""))], "id long, blob binary")
    rows = {r.id: r for r in media.media_columns(df, "blob", ["id"]).collect()}
    assert rows[1].error == "" and rows[1].n_samples == 40 and [k.length for k in rows[1].keyframes] == [64, 64, 64]
    assert rows[2].error and rows[4].error
    assert rows[3].codec is None and rows[3].error == "" and rows[5].n_samples == 0


def test_media_columns_of_all_tracks_fragments_and_compact_sizes(spark):
    """Sound first, then video with compact sizes and two fragments."""
    full, box = media.full, media.box

    def trak(number, handler, codec, *tables):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(78))), *tables)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 1000, 30)), full(b"hdlr", bytes(4), handler, bytes(12)), box(b"minf", stbl))
        return box(b"trak", full(b"tkhd", struct.pack(">4I", 0, 0, number, 0)), mdia)

    sizes = full(b"stz2", bytes(3), b"\x04", struct.pack(">I", 3), b"\x35\x20")
    video = trak(2, b"vide", b"avc1", sizes, full(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), full(b"stco", struct.pack(">2I", 1, 900)))
    moov = box(b"moov", trak(1, b"soun", b"mp4a"), video, box(b"mvex", full(b"trex", struct.pack(">5I", 2, 1, 10, 7, 0x10000))))
    tfhd = full(b"tfhd", struct.pack(">I", 2), flags=0x20000)
    one = box(b"moof", box(b"traf", tfhd, full(b"trun", struct.pack(">IiI", 2, 200, 0), flags=5), full(b"trun", struct.pack(">I2I", 1, 40, 9), flags=0x300)))
    blob = moov + one + box(b"mdat", bytes(400))
    (sound, picture), error = media.inspect(blob)
    start = len(moov) + 200
    assert error == "" and (sound.handler, sound.codec, len(sound.sizes)) == ("soun", "mp4a", 0)
    assert picture.sizes.tolist() == [3, 5, 2, 7, 7, 9] and picture.duration == 30 + 10 + 10 + 40
    assert picture.offsets.tolist() == [900, 903, 908, start, start + 7, start + 14]
    assert [x.tolist() for x in picture.keyframes] == [[900, 903, 908, start], [3, 5, 2, 7]]
    broken = moov + box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 9))))
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(broken)), (3, None)], "id long, blob binary")
    rows = {r.id: r for r in media.media_columns(df, "blob", ["id"]).collect()}
    assert [(t.handler, t.codec, t.n_samples, len(t.keyframes)) for t in rows[1].tracks] == [("soun", "mp4a", 0, 0), ("vide", "avc1", 6, 4)]
    assert rows[1].codec == "mp4a" and rows[1].error == "" and rows[2].error and rows[3].tracks == []
