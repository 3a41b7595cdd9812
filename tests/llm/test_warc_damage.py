"""Records are valid and unique, and damage is noticed."""

import re

import pytest
from pyspark.errors import PythonException

from codeloom.llm import warc

PAGE = "<p>" + "text of a page " * 20 + "</p>"


def test_heads_have_dates_and_unique_ids(spark):
    rows = [(i % 3, f"http://h/{i % 3}", PAGE) for i in range(9)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    heads = [x.partition(b"\r\n\r\n")[0].decode() for r in manifest.collect() for x in warc.records_of(r["archive"])]
    ids = [re.search(r"^WARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>\r$", h, re.M)[1] for h in heads]
    assert len(heads) == 9 == len(set(ids))
    assert all(re.search(r"^WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r$", h, re.M) for h in heads)
    revisits = [h for h in heads if "WARC-Type: revisit" in h]
    assert len(revisits) == 6 and all("WARC-Refers-To-Target-URI: http://h/0\r" in h and "X-Refers-To-Page-ID: 0\r" in h for h in revisits)


def test_a_changed_payload_is_not_intact():
    import hashlib

    data = warc.record(1, "u", PAGE.encode(), len(PAGE), hashlib.sha256(PAGE.encode()).hexdigest(), None, None, "2024-01-01T00:00:00Z")
    assert warc.parse(data)["intact"]
    changed = data.replace(b"text of", b"next of", 1)
    assert not warc.parse(changed)["intact"] and warc.parse(changed)["payload_digest"] == hashlib.sha256(PAGE.replace("text of", "next of", 1).encode()).hexdigest()
    assert not warc.parse(data[:-1])["intact"]


def test_a_flipped_byte_fails_the_read(spark):
    manifest = warc.write_archives(spark.createDataFrame([(i, "u", f"{PAGE}{i}") for i in range(5)], "page_id long, url string, html string").coalesce(1))
    path = manifest.first()["archive"].removeprefix("file:")
    while path.startswith("//"):
        path = path[1:]
    data = bytearray(open(path, "rb").read())
    data[-20] ^= 0x10
    open(path, "wb").write(data)
    with pytest.raises(PythonException):
        warc.read_archives(manifest).collect()
