import struct
import zlib

import pytest

from pagewright.operators.layout import lines
from pagewright.sources import images


def png(width, height):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    pixels = b"".join(b"\0" + bytes((10, 20, 30)) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.png").write_bytes(png(3, 2))
    (tmp_path / "a.png").write_bytes(png(4, 5))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.png").write_bytes(png(1, 1))
    return str(tmp_path)


def test_folder(spark, folder):
    got = [(r.path.rsplit("/", 1)[1], r.width, r.height) for r in images.image_folder(spark, folder).orderBy("path").collect()]
    assert got == [("a.png", 4, 5), ("b.png", 3, 2)]
    assert images.image_folder(spark, folder, tolerant=False).where("height is null").count() == 1


def test_one_image(spark, folder):
    assert images.one_image(spark, folder + "/a.png").first().width == 4
    with pytest.raises(FileNotFoundError):
        images.one_image(spark, folder + "/broken.jpg")


def test_text_files(spark, tmp_path):
    frames = spark.createDataFrame([(1, "/in/a.png"), (2, "/in/b.png")], "frame_id int, path string")
    words = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "x"), (1, 2, 12, 0, 20, 10, "y")], "frame_id int, word_id int, x1 int, y1 int, x2 int, y2 int, text string")
    files = images.text_files(frames, lines(words))
    assert {(r.name, r.content, r.clash) for r in files.collect()} == {("a.txt", "x y\n", False), ("b.txt", "", False)}
    out = tmp_path / "out"
    out.mkdir()
    (out / "other.txt").write_text("stays")
    for _ in range(2):
        images.write_text_files(files, str(out))
        assert {p.name: p.read_text() for p in out.iterdir()} == {"a.txt": "x y\n", "b.txt": "", "other.txt": "stays"}
    clash = spark.createDataFrame([(1, "/in/a.png"), (2, "/in/a.jpg")], "frame_id int, path string")
    with pytest.raises(ValueError):
        images.write_text_files(images.text_files(clash, lines(words)), str(tmp_path / "no"))
