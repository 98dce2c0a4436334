import hashlib
import zipfile
import zlib
from pathlib import Path

import pytest

from tidewake.llm import media


def test_round_trip(spark):
    texts = [(1, "abc"), (1, "abc"), (2, None), (None, ""), (3, "é" * 288), (4, "word " * 90_000), (5, "x" * 577)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, media string").repartition(3)
    got = sorted(map(tuple, media.stored_documents(df).collect()), key=str)
    assert len(got) == len(texts)
    for doc_id, text in texts:
        raw = (text or "").encode()
        want = raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576))
        row = next(r for r in got if r[0] == doc_id and r[1] == len(raw))
        assert row[2] == len(want) and row[3] == hashlib.sha256(want).hexdigest() and row[4] == zlib.crc32(want[-32:])
    assert len({r for r in got if r[0] == 1}) == 1
    assert media.stored_documents(df.limit(0)).count() == 0


def test_ranges_meet_every_member_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(2)
    uri = f"file://{tmp_path}/a"
    made = media.write_archives(df, uri, archive_bytes=20_000)
    assert made.count() > 3
    rows = media.read_archives(spark, uri, range_bytes="3000", batch_bytes="2000").collect()
    assert sorted(int(r.member[:-4].split("_")[1]) for r in rows) == list(range(300))


def test_a_member_is_retried_alone(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5):
            z.writestr(f"{k}_{k}.png", media.encode_png(media.pad(b"%d" % k)))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "retries": "2"})
    whole, fails = media.read_member, []

    def flaky(f, info):
        if info.filename == "3_3.png" and len(fails) < 2:
            fails.append(1)
            raise OSError("gone")
        return whole(f, info)

    media.read_member = flaky
    try:
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5
    finally:
        media.read_member = whole
    data = bytearray(Path(path).read_bytes())
    data[60] ^= 255
    Path(path).write_bytes(data)
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))
