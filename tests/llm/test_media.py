import hashlib
import zipfile
import zlib
from collections import Counter

import pytest

from cellspark.llm import media
from cellspark.llm.common import shared_dir


def test_round_trip(docs, plain):
    got = Counter(tuple(r)[:5] for r in media.text_media(docs).collect())
    want = Counter()
    for d, t in plain:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[(d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert got == want


def test_ranges_cover_each_member_once(spark, docs):
    path = shared_dir(spark, "ranges")
    media.store_texts(docs, path)
    assert media.load_media(spark, path, rangeBytes="700").count() == docs.count()


def test_png_rejects_damage():
    good = media.to_png(b"x" * 384)
    assert media.from_png(good) == b"x" * 384
    with pytest.raises(ValueError):
        media.from_png(good[:50] + b"!" + good[51:])


def test_a_damaged_member_fails_alone(spark, tmp_path):
    path = str(tmp_path / "archives")
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(6)], "doc_id long, text string").coalesce(1)
    media.store_texts(df, path)
    (archive,) = (tmp_path / "archives").glob("*.zip")
    raw = bytearray(archive.read_bytes())
    raw[90] ^= 0xFF
    archive.write_bytes(raw)
    with pytest.raises(Exception, match="damaged member"):
        media.load_media(spark, path, tries="1").collect()
    rows = media.media_features(media.load_media(spark, path, tries="2", keepFailed="true")).collect()
    assert len(rows) == 6 and sum(r["payload_bytes"] is None for r in rows) == 1


def test_empty(no_docs):
    assert media.text_media(no_docs).count() == 0


class Flaky:
    """A file system whose reads come short, or fail, the first times."""

    def __init__(self, raw, short):
        self.raw, self.short, self.opened = raw, short, 0

    def open_input_file(self, path):
        self.opened += 1
        return self

    def read_at(self, n, at):
        if self.short:
            kind = self.short.pop()
            if kind == "error":
                raise OSError("lost")
            return self.raw[at : at + n][: -kind]
        return self.raw[at : at + n]

    def close(self):
        pass


@pytest.mark.parametrize(("short", "opened"), [([], 1), ([5], 2), ([1, 29], 3), (["error", 3, "error"], 4)])
def test_retries_of_one_member(tmp_path, short, opened):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("0_7_5.png", b"hello world" * 9)
        archive.writestr("1_8_5.png", b"other")
    files = Flaky(path.read_bytes(), short)
    reader = media.ArchiveReader("", {})
    first, second = zipfile.ZipFile(path).infolist()
    handles = media.Handles(files, "a.zip")
    assert reader.member(handles, first) == b"hello world" * 9 and files.opened == opened
    assert reader.member(handles, second) == b"other" and files.opened == opened


def test_names_of_file_systems():
    assert media.SCHEMES["s3a"] == "s3"
    assert media.file_system("file:///tmp/x")[1] == "/tmp/x"
