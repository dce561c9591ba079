"""Media containers: round trips, files laid out by hand, broken files."""

import struct

import pytest

from quirefold.llm import media


def atom(kind, body=b""):
    return (len(body) + 8).to_bytes(4, "big") + kind.encode() + body


def ints(*values, width=4):
    return b"".join(v.to_bytes(width, "big") for v in values)


def trak(number, stbl, scale=600, handler="vide", entry=None):
    head = atom("tkhd", ints(0, 0, 0, number, 0, 0) + bytes(60))
    rest = atom("mdhd", ints(0, 0, 0, scale, 0, 0)) + atom("hdlr", ints(0, 0) + handler.encode() + bytes(13)) + atom("minf", atom("stbl", atom("stsd", ints(0, 1) + (entry or atom("avc1", bytes(8)))) + stbl))
    return atom("trak", head + atom("mdia", rest))


def tables(sizes, offsets, sync=None, per=1, step=20):
    out = atom("stsz", ints(0, 0, len(sizes), *sizes)) + atom("stco", ints(0, len(offsets), *offsets)) + atom("stsc", ints(0, 1, 1, per, 1)) + atom("stts", ints(0, 1, len(sizes), step))
    return out if sync is None else out + atom("stss", ints(0, len(sync), *sync))


EMPTY = atom("stsz", ints(0, 0, 0)) + atom("stco", ints(0, 0)) + atom("stsc", ints(0, 0)) + atom("stts", ints(0, 0))


@pytest.mark.parametrize("doc_id", range(20))
def test_round_trip(doc_id):
    for text in ("a", "one\ntwo\nthree\nfour\nfive", "x\n" * 40, "é漢" * 300):
        data = media.container(doc_id, text)
        (t,) = media.inspect(data)
        samples = [s.encode() + b"\n" for s in text.split("\n")]
        assert t["error"] is None and t["samples"] == len(samples) and t["duration"] == 40 * len(samples) / 1000
        want = list(range(0, len(samples), 1 if t["codec"] == "mp4a" else 4))
        assert [data[k["offset"] : k["offset"] + k["size"]] for k in t["keyframes"]] == [samples[i] for i in want]
        assert [k["sample"] for k in t["keyframes"]] == [i + 1 for i in want] and [k["seconds"] for k in t["keyframes"]] == [i * 40 / 1000 for i in want]
        assert media.inspect(data[:40])[0]["error"]


def test_two_tracks_by_hand():
    payload = b"AAAABBBBBBccD"
    at = 8
    data = atom("mdat", payload) + atom("free", b"x") + atom("moov", atom("mvhd", bytes(100)) + trak(1, tables([4, 6], [at, at + 4], [1])) + trak(2, tables([2, 1], [at + 10], None, 2, 300), 300, "soun", atom("mp4a", bytes(8))))
    v, s = media.inspect(data + bytes(3))
    assert (v["track"], v["kind"], v["codec"], v["samples"], v["duration"], v["error"]) == (1, "vide", "avc1", 2, 40 / 600, None)
    assert v["keyframes"] == [{"sample": 1, "offset": 8, "size": 4, "seconds": 0.0}]
    assert (s["kind"], s["codec"], s["duration"]) == ("soun", "mp4a", 2.0)
    assert s["keyframes"] == [{"sample": 1, "offset": 18, "size": 2, "seconds": 0.0}, {"sample": 2, "offset": 20, "size": 1, "seconds": 1.0}]


def test_one_broken_track_leaves_the_other():
    good = trak(7, tables([4], [8]))
    broken = trak(9, tables([4], [8]).replace(b"stsc", b"xxxx"))
    no_media = atom("trak", b"")
    rows = media.inspect(atom("mdat", b"AAAA") + atom("moov", broken + no_media + good))
    assert [r["track"] for r in rows] == [9, 2, 7] and [bool(r["error"]) for r in rows] == [True, True, False]
    assert rows[0]["codec"] == "avc1" and rows[0]["keyframes"] == [] and rows[2]["keyframes"][0]["offset"] == 8


def test_compact_sizes_and_encryption():
    stbl = tables([4, 6, 3], [8, 12, 18])
    plain = stbl[: stbl.index(b"stsz") - 4] + stbl[stbl.index(b"stco") - 4 :]
    for bits, packed in ((4, b"\x46\x30"), (8, b"\x04\x06\x03"), (16, ints(4, 6, 3, width=2))):
        entry = atom("encv", bytes(78) + atom("sinf", atom("frma", b"hvc1")))
        (t,) = media.inspect(atom("mdat", bytes(13)) + atom("moov", trak(1, atom("stz2", ints(0) + bytes([0, 0, 0, bits]) + ints(3) + packed) + plain, entry=entry)))
        assert t["error"] is None and t["codec"] == "hvc1" and [k["size"] for k in t["keyframes"]] == [4, 6, 3]


def test_fragments_by_hand():
    trex = atom("mvex", atom("trex", ints(0, 1, 1, 30, 5, 0x10000)) + atom("trex", ints(0, 2, 1, 100, 2, 0)))
    moov = atom("moov", trak(1, EMPTY, 300) + trak(2, EMPTY, 100, "soun") + trex)

    def moof(at):
        # track 1: default base is the fragment; first sample's flags say keyframe; three samples of default size. Track 2: explicit base, own sizes
        one = atom("traf", atom("tfhd", ints(0x20000, 1)) + atom("tfdt", ints(0, 600)) + atom("trun", ints(0x5, 3) + struct.pack(">i", at) + ints(0)))
        two = atom("traf", atom("tfhd", ints(0x1, 2) + ints(at + len(moov) + 15, width=8)) + atom("trun", ints(0x200, 2, 3, 4)) + atom("trun", ints(0x0, 1)))
        return atom("moof", atom("mfhd", ints(0, 1)) + one + two)

    at = len(moof(0)) + 8
    data = moov + moof(at) + atom("mdat", b"k1234p1234q1234aaabbbbcc")
    v, s = media.inspect(data)
    assert v["error"] is None and v["samples"] == 3 and v["duration"] == (600 + 90) / 300
    assert [(k["sample"], data[k["offset"] :][: k["size"]], k["seconds"]) for k in v["keyframes"]] == [(1, b"k1234", 2.0)]
    assert s["error"] is None and [data[k["offset"] :][: k["size"]] for k in s["keyframes"]] == [b"aaa", b"bbbb", b"cc"] and s["duration"] == 3.0
    cut = media.inspect(data[:-3])
    assert not cut[0]["error"] and "beyond the end" in cut[1]["error"]


def test_random_damage_never_raises():
    import random

    rng = random.Random(3)
    for doc_id in (0, 3, 7):
        data = media.container(doc_id, "one\ntwo\nthree\n" * 5)
        for _ in range(300):
            b = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(len(b))] = rng.choice((0, 1, 255, rng.randrange(256)))
            media.inspect(bytes(b[: rng.randrange(len(b))] if rng.random() < 0.3 else b))


def test_odd_rows(spark):
    one = media.container(1, "a\nb")
    df = spark.createDataFrame([(1, bytearray(one), "x"), (1, bytearray(one), "x"), (2, None, "x"), (3, bytearray(), "x"), (None, bytearray(b"junk junk junk"), "x")], "doc_id long, payload binary, track string")
    rows = media.media_columns(df).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["samples"]) for r in rows] == [(None, None), (1, 2), (1, 2)] and rows[0]["error"] and rows[1] == rows[2]
    assert media.media_columns(df.limit(0)).count() == 0
