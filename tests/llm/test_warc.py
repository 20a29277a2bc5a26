import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, `payload` string, seq int, `URL2` string").repartition(3)


BIG = "<html>" + "é" * 60 + "</html>"
ROWS = ([(i, f"https://Host{i % 3}.Example.com:80/p/{i % 4}?q={i % 2}#frag", BIG if i % 5 else f"{BIG}{i}") for i in range(40)]
        + [(100, None, None), (101, "", ""), (102, "http://a b.com/\r\nWARC/1.1", "short"), (103, "http://x.org", "short"), (104, "mailto:x", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 9\r\n\r\n" * 9),
           (105, "http://x.org", "z" * 200_000), (None, "http://null.id/", BIG), (106, "http://x.org", "a" * 99), (107, "http://x.org", "a" * 99), (108, "u", "b" * 100), (109, "u", "b" * 100), (109, "u", "b" * 100)])


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if i is not None and len(raw) >= 100 and first[h] != i else None
        out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to] += 1
    return out


def test_round_trip_and_order(spark):
    ts = F.timestamp_seconds(F.lit(10 ** 9) - F.coalesce("id", F.lit(0)))
    index = warc.archive_and_index(pages(spark, ROWS), "page_id", "url", "html", ts).collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == want(ROWS)
    order = [(r.url_key, r.ts, r.id is not None, r.id or 0) for r in index]
    assert order == sorted(order)
    assert {r.url_key for r in index if r.id == 0} == {"com,example,host0)/p/0?q=0"}


def test_archives_are_plain_warc(spark, tmp_dir):
    caps = warc.captures(pages(spark, ROWS), "page_id", "url", "html")
    warc.write_archives(caps.coalesce(2), f"{tmp_dir}/w", records_per_file=10)
    import glob

    files = glob.glob(f"{tmp_dir}/w/*.gz")
    assert len(files) >= len(ROWS) / 10
    n = 0
    for f in files:
        data = gzip.open(f).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        with open(f, "rb") as raw:
            for headers, block, offset in warc.read_records(raw.read()):
                assert data[offset:offset + 8] == b"WARC/1.1" and len(block) == int(headers["content-length"])
                n += 1
    assert n == len(ROWS)


def test_damage_is_an_error():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b, _ in warc.read_records(gzip.compress(good) + gzip.compress(good))] == [b"abc", b"abc"]
    for bad in (good[:-2], good.replace(b"3", b"2"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.read_records(gzip.compress(bad)))
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(good)[:-9]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 30))) for _ in range(k)]
    got = [(runs[r][i], r, i) for r, i in warc.LoserTree(runs)]
    assert got == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))


def test_empty_table(spark):
    assert warc.archive_and_index(pages(spark, []), "page_id", "url", "html").count() == 0
