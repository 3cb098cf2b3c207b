import hashlib

from isopanel.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest string"


def rows():
    big = "<p>" + "é x" * 60 + "</p>"
    data = [(i, f"http://h{i % 7}.org/{i}", f"<html>{i % 5} " + "body text " * (i % 30) + "</html>", "z") for i in range(300)]
    data += [(1000 + i, None, big, None) for i in range(50)] + [(2000, "a\r\nb", None, None), (2001, "u", "", None), (2002, "u", "x" * 99, None), (2003, "u", "x" * 99, None), (2004, "u", "y" * 100, None), (2005, "u", "y" * 100, None)]
    data += [(2004, "u", "y" * 100, None), (2005, "u", "y" * 100, None), (None, "u", "y" * 100, None), (3000, "u", "long " * 300_000, None), (3001, "u", "a\r\n\r\nb", None)]
    return data


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), SCHEMA)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=3000)
    got = warc.read_archives(archives).collect()
    first = {}
    for i, _, html, _ in rows():
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html, _ in rows():
        data = (html or "").encode()
        refers = first.get(html) if first.get(html) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert archives.count() > 2
    for r in got[::25]:
        again = warc.read_record(r["path"], r["offset"], r["length"])
        assert again.headers["WARC-Payload-Digest"] == f"sha256:{r['payload_digest']}"
    data = open(archives.first()["path"].removeprefix("file://"), "rb").read(4)
    assert data == (0x184D2A5D).to_bytes(4, "little")


def test_nothing(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
