"""The catalogue over recorded answers and a transport that refuses at first; no network."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from curata.sources import connector as C

API = "https://catalogue.example/api"


def page(title, **more):
    data = f"bytes of {title}".encode()
    info = {"url": f"https://files.example/{title}", "descriptionurl": f"https://catalogue.example/{title}", "mime": "image/jpeg", "size": len(data), "width": 3, "height": 4, "sha1": hashlib.sha1(data).hexdigest(), "extmetadata": {"LicenseShortName": {"value": "<b>CC0</b>"}, "Artist": {"value": "A <i>B</i>"}}}
    return {"pageid": 7, "title": title, "imageinfo": [info | more], "categories": [{"title": "Category:X"}]}


def put(folder, url, body, status=200, **headers):
    (folder / C.recorded_name(url)).write_bytes(json.dumps({"status": status, "headers": headers}).encode() + b"\n" + body)


@pytest.fixture
def pages(tmp_path):
    """Ninety-five titles in three chunks; every tenth is missing, one is written otherwise at the source."""
    titles = [f"File:{i}.jpg" for i in range(95)]
    for at in range(0, 95, C.CHUNK):
        chunk = titles[at : at + C.CHUNK]
        found = [{"title": t, "missing": True} if t.endswith("0.jpg") else page("File:ONE.jpg" if t == "File:1.jpg" else t) for t in chunk]
        put(tmp_path, C.question(API, chunk), json.dumps({"query": {"normalized": [{"from": "File:1.jpg", "to": "File:ONE.jpg"}], "pages": found}}).encode())
    for t in (*titles, "File:ONE.jpg"):
        put(tmp_path, f"https://files.example/{t}", f"bytes of {t}".encode())
    return tmp_path, titles


def test_titles_are_described_by_chunks(spark, pages):
    folder, titles = str(pages[0]), pages[1]
    client = lambda: C.Client(C.recorded(folder), interval=0)
    df = C.describe(spark, [*titles, titles[3]], client, API)
    assert df.rdd.getNumPartitions() == 3
    got = {r.title: r for r in df.collect()}
    assert list(got) == titles and [t for t in titles if not got[t].found] == [t for t in titles if t.endswith("0.jpg")]
    r = got["File:1.jpg"]
    assert (r.license, r.artist, r.record_id, r.categories, r.width, r.mime) == ("CC0", "A B", "7", ["Category:X"], 3, "image/jpeg")
    assert C.describe(spark, [], client, API).count() == 0
    with pytest.raises(Exception, match="at most"):
        C.describe(spark, list(map(str, range(C.MOST + 1))), client, API).count()


def test_downloads_fail_row_by_row(spark, pages):
    folder = pages[0]
    put(folder, "https://files.example/File:4.jpg", b"x" * 500)
    put(folder, "https://files.example/File:5.jpg", b"other bytes")
    put(folder, "https://files.example/File:6.jpg", b"", status=410)
    put(folder, "https://files.example/File:8.jpg", b"bytes of File:7.jpg")
    where = str(folder)
    client = lambda: C.Client(C.recorded(where), interval=0)
    df = C.describe(spark, [f"File:{i}.jpg" for i in range(0, 40)], client, API).where("title IN ('File:2.jpg', 'File:4.jpg', 'File:5.jpg', 'File:6.jpg', 'File:7.jpg', 'File:8.jpg', 'File:10.jpg')")
    df = df.withColumn("checksum", F.when(F.col("title") == "File:8.jpg", F.concat(F.lit("sha1:"), F.sha1(F.lit("bytes of File:7.jpg")))).otherwise(F.col("checksum")))
    out = C.duplicates(C.download(df, client, 100), spark.createDataFrame([(hashlib.sha256(b"bytes of File:2.jpg").hexdigest(), "img_2")], "sha256 string, image_id string"))
    got = {r.title: r for r in out.collect()}
    assert bytes(got["File:7.jpg"].content) == b"bytes of File:7.jpg" and got["File:7.jpg"].problem is None and got["File:7.jpg"].n_bytes == 19
    assert [got[f"File:{i}.jpg"].content for i in (4, 5, 6, 10)] == [None] * 4
    assert "over 100 bytes" in got["File:4.jpg"].problem and "checksum" in got["File:5.jpg"].problem and "status 410" in got["File:6.jpg"].problem and got["File:10.jpg"].problem == "no url"
    assert {t: r.duplicate_of for t, r in got.items() if r.duplicate_of} == {"File:2.jpg": "img_2", "File:8.jpg": "File:7.jpg"}


def transport(*answers):
    left = list(answers)
    return lambda url, limit: left.pop(0)


def test_retries_and_caps():
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    client = lambda *answers, **more: C.Client(transport(*answers), sleep=sleep, clock=lambda: now[0], **more)
    c = client((429, {"retry-after": "7"}, b""), (503, {"retry-after": "soon"}, b""), (503, {"retry-after": "5000"}, b""), (200, {}, b"ok"), interval=2.0)
    assert c.get("u") == b"ok" and slept == [7.0, 60.0, 900.0]
    slept.clear()
    with pytest.raises(OSError, match="429"):
        client(*[(429, {"retry-after": "0"}, b"")] * 4, interval=2.0).get("u")
    assert slept == [2.0, 2.0, 2.0]  # told to hurry, it keeps its interval
    slept.clear()
    c = client((200, {}, b"a"), (200, {}, b"b"), interval=2.0)
    assert c.get("u") + c.get("v") == b"ab" and slept == [2.0]
    with pytest.raises(OSError, match="404"):
        client((404, {}, b"")).get("u")
    for answer in ((200, {"content-length": "11"}, b""), (200, {}, b"x" * 11)):
        with pytest.raises(C.TooLarge):
            client(answer).get("u", 10)
    assert client((200, {"content-length": "10"}, b"x" * 10)).get("u", 10) == b"x" * 10
