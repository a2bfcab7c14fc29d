import hashlib
import struct

import pytest

from doclog.llm import warc

HTML = "<html><body>" + "some words in a page " * 20 + "{}</body></html>"


def rows():
    out = [(k, f"http://h{k % 3}/p{k}", HTML.format(k % 40)) for k in [*range(120), *range(1000, 1330)]]
    return out + [(200, None, None), (201, "http://x\r\nInjected: 1", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "x" * 100), (205, "u", "x" * 100), (205, "u", "é" * 200_000), (206, "u", "y" * 99), (207, "u", "y" * 99), (None, "u", "no id")]


def want():
    data = [(i, (h or "").encode()) for i, _, h in rows() if i is not None]
    out = []
    for i, h in data:
        first = min(j for j, g in data if g == h)
        again = len(h) >= 100 and first < i
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [8 << 20, 20_000])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc.records, "__defaults__", (size,))
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "1 payload", "2 first", "3 refers_to", "4 n")
    found = warc.round_trip(pages)
    got = [(int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in found.collect()]
    assert sorted(got, key=str) == want()
    whole = {(r.page_id, hashlib.sha256(r.payload).hexdigest()) for r in warc.with_payloads(found).collect()}
    assert whole == {(str(i), d) for i, _, d, _, _ in want()}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def one_archive():
    import io

    out = io.BytesIO()
    data = [{"page_id": k, "url": "u", "payload": HTML.format(k).encode(), "payload_digest": hashlib.sha256(HTML.format(k).encode()).hexdigest(), "payload_bytes": len(HTML.format(k).encode()), "record_type": "response", "refers_to": None} for k in range(450)]
    warc.archive(iter(data), out)
    return out.getvalue(), data


def test_archive_has_dictionary_and_a_frame_for_each_record():
    raw, data = one_archive()
    assert raw[:4] == warc.DICTIONARY_MAGIC and struct.unpack("<I", raw[4:8])[0] > 0
    found = [warc.parse_record(r) for _, r in warc.frames(raw)]
    assert [r["payload"] for r in found] == [d["payload"] for d in data]


def test_broken_archives_raise():
    raw, _ = one_archive()
    record = next(iter(warc.frames(raw)))[1]
    for bad in (b"", raw[8:], raw[:-5], raw + b"junk", raw[:4] + b"\xff\xff\xff\x7f" + raw[8:]):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for bad in (record[:-1], record + b"x", record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: ", b"Content-Length: 1"), record.replace(b"some words", b"same words"), record.replace(b"WARC-Type", b"WARC-Tpye")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
