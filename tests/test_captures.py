"""Framing by byte ranges against framing from the start."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.sources import captures as S
from tagloom.sources.llrp import capture_messages


def frame(draw, size, kind=1085):
    return kind.to_bytes(2, "big") + size.to_bytes(4, "big") + draw.randbytes(size - 6)


def noise(draw):
    """Ten bytes whose length field is out of range."""
    return draw.randbytes(2) + draw.choice([b"\x00\x00\x00\x05", b"\xff\xff\xff\xff", b"\x00\x10\x00\x01"]) + draw.randbytes(4)


def capture(seed, frames, sizes=(10, 300)):
    draw = random.Random(seed)
    parts = []
    for _ in range(frames):
        if draw.random() < 0.1:
            parts.append(noise(draw))
        # bodies full of small numbers look like headers at many places
        size = draw.randrange(*sizes)
        parts.append(frame(draw, size) if draw.random() < 0.5 else b"\x04\x3d" + size.to_bytes(4, "big") + bytes(
            draw.choice([0, 0, 0, 10, 12, 40]) for _ in range(size - 6)))
    return b"".join(parts)


def split(spark, folder, **options):
    rows = S.split_capture_files(spark, str(folder), **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.frame_no)):
        out.setdefault(r.path.rpartition("/")[2], []).append((r.frame_no, bytes(r.message), r.truncated))
    return out


def sequential(data):
    return [(n, message, cut) for n, (message, cut) in enumerate(capture_messages(data))]


@pytest.mark.parametrize("block", [37, 256, 4096, 1 << 20])
def test_frames_are_those_from_the_start(spark, tmp_path, block):
    files = {"a": capture(1, 200), "b": capture(2, 90)[:-7], "c": noise(random.Random(3)) * 40 + capture(4, 20), "d": b"", "e": b"\x00" * 9,
             "f": random.Random(5).randbytes(6000), "g": bytes(5000), "h": capture(6, 3, (2000, 5000)) + b"\x04\x3d\x00"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"no capture")
    assert split(spark, tmp_path, block_bytes=block, tasks=4) == {n: sequential(d) for n, d in files.items() if sequential(d)}


def test_one_file_and_its_blocks(spark, tmp_path):
    data = capture(8, 4000, (10, 2000))
    (tmp_path / "only.bin").write_bytes(data)
    assert split(spark, tmp_path / "only.bin", block_bytes=200_000) == {"only.bin": sequential(data)}
    spark.dataSource.register(S.CaptureBlocks)
    blocks = spark.read.format("capture_blocks").option("blockBytes", "200000").load(str(tmp_path))
    assert blocks.rdd.getNumPartitions() == blocks.count() == -(-len(data) // 200_000)
    assert blocks.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] == len(data)


def test_few_places_are_entered(spark, tmp_path):
    """What leaves a block of random bytes, or of frames that hold such, is a small part of the places at which one could enter."""
    draw = random.Random(9)
    for name, data in {"frames": b"".join(frame(draw, 200) for _ in range(16_000)), "random": draw.randbytes(3 << 20)}.items():
        path = tmp_path / name
        path.write_bytes(data)
        spark.dataSource.register(S.CaptureBlocks)
        blocks = spark.read.format("capture_blocks").option("blockBytes", str(3 << 19)).load(str(path))
        left = blocks.mapInArrow(S._leaving, "path string, size long, entry long").count()
        assert left <= 1000 * blocks.count()
