"""Vector codes, clustering and url filters against plain loops: nulls, ties, repeats, long and odd rows, empty tables, odd columns."""

from __future__ import annotations

import random
from hashlib import sha256
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import centroids, codes, urls
from seqspark.llm.integers import limit, squared

ROWS = "vec_id long, embedding array<double>, label string"


def vectors(n, width, seed=0, spread=0.3, near=None):
    """Vectors around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(near or 6, width))
    x = middle[rng.integers(len(middle), size=n)] + spread * rng.normal(size=(n, width))
    x[n // 2 : n // 2 + 5] = x[0]
    return x


def odd(df):
    """Further columns with names that are used inside."""
    for name in ("m", "n", "part", "key", "of", "cluster", "h", "listed", "copy", "ids"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows_of(x, ids=None):
    return [(int(i), [float(v) for v in r], ("a", "b", None)[i % 3]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]


def plain_codes(rows, parts, entries, rounds, scale):
    """(codes, errors, books) by full search in whole numbers."""
    kept = [(i, [floor(scale * v) for v in e], lab) for i, e, lab in rows if e is not None and all(v is not None and isfinite(v) for v in e)]
    width = -(-max(1, *(len(m) for _, m, _ in kept)) // parts) * parts
    kept = [(i, m + [0] * (width - len(m)), lab) for i, m, lab in kept]
    first = {}
    for i, m, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2]):
        first.setdefault(i, m)
    starts, w = [first[i] for i in sorted(first)][:entries], width // parts
    cut = lambda m, p: m[p * w : (p + 1) * w]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(m, p) for m in starts] for p in range(parts)]
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (distance(cut(m, p), books[p][e]), e)) for p in range(parts)] for _, m, _ in kept]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(m, p) for (_, m, _), a in zip(kept, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    errors = [sum(distance(cut(m, p), books[p][a[p]]) for p in range(parts)) for (_, m, _), a in zip(kept, at, strict=True)]
    return kept, at, errors, books


def check_codes(spark, rows, schema=ROWS, parts=4, entries=8, rounds=4, scale=1024, **more):
    kept, at, errors, books = plain_codes(rows, parts, entries, rounds, scale)
    got = codes.encode_vectors(odd(spark.createDataFrame(rows, schema).repartition(3)), parts=parts, entries=entries, rounds=rounds, scale=scale, **more).collect()
    labels = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    digest = sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    want = [(i, "".join(f"{e:02x}" for e in a), e, labels[lab], digest) for (i, _, lab), a, e in zip(kept, at, errors, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("chunk_bytes", [1 << 10, 2 << 20])
def test_codes_equal_full_search(spark, chunk_bytes):
    check_codes(spark, rows_of(vectors(150, 16)), chunk_bytes=chunk_bytes)


def test_codes_of_odd_rows(spark):
    x = rows_of(vectors(40, 8, 1))
    more = [(100, None, "a"), (101, [1.0, None] * 4, "a"), (102, [float("nan")] * 8, "b"), (103, [float("inf")] * 8, "b"), (None, [0.5] * 8, None), (None, [0.5] * 8, None), (3, [-9.0] * 8, "a"), (3, [-9.0] * 8, "a")]
    check_codes(spark, x + more + [(200, [], "c"), (201, [0.0] * 3, "c"), (202, [-0.0001] * 8, "c")])
    check_codes(spark, [(i, [1.0, 2.0, 3.0, 4.0], "a") for i in range(9)], entries=4)  # ties everywhere
    check_codes(spark, [(7, [0.25] * 4, None)], entries=256)
    check_codes(spark, [(i, [float(i)] * 3000, "a") for i in range(4)], entries=2, chunk_bytes=1 << 12)  # long vectors


def test_codes_without_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    for df in (empty, spark.createDataFrame([(1, None, "a"), (None, [1.0], "a")], ROWS)):
        got = codes.encode_vectors(df)
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_take_any_label_and_component_type(spark):
    rows = [(i, [i, -i, i % 3, 1], i % 2) for i in range(20)]
    got = {r["vec_id"]: r for r in codes.encode_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<int>, label long"), entries=4).collect()}
    _, at, errors, _ = plain_codes([(i, [float(v) for v in e], lab) for i, e, lab in rows], 4, 4, 4, 1024)
    assert [(got[i]["code"], got[i]["error"]) for i in range(20)] == [("".join(f"{e:02x}" for e in a), e) for a, e in zip(at, errors, strict=True)]


def test_heaps_spare_parts_and_stay_exact():
    """After small moves only few parts are looked at, and all assignments are those of a full search."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * vectors(3000, 16, 3, 0.05, 40)).astype(np.int32)
    books = x[rng.choice(3000, 40, False)].astype(np.int64).reshape(40, 4, 4).transpose(1, 0, 2).copy()
    chunk, drift = codes.Chunk(x), np.zeros((4, 40))
    looked = [chunk.settle_into(books, drift)]
    for _ in range(4):
        flat = [h.flat() for h in chunk.heaps]
        chunk = codes.Chunk(x, [codes.Heaps.stored(*f) for f in flat])  # as written and read back
        for h in chunk.heaps:  # heaps still
            assert all(h_[(i - 1) // 2] <= h_[i] for h_ in h.heaps for i in range(1, len(h_)))
        moved = books + rng.integers(-6, 7, books.shape)
        drift = drift + np.stack([codes.drifts(a, b) for a, b in zip(books, moved, strict=True)])
        books = moved
        looked.append(chunk.settle_into(books, drift))
        full = np.stack([squared(x[:, 4 * p : 4 * p + 4], books[p]).argmin(1) for p in range(4)], axis=1)
        assert (chunk.codes() == full).all()
    assert looked[0] == 12000 and max(looked[1:]) < 6000


def test_squared_distances_are_exact_beyond_doubles():
    rng = np.random.default_rng(5)
    most = limit(16)
    x, c = rng.integers(-most, most, (20, 16)), rng.integers(-most, most, (7, 16))
    assert squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]


def check_clusters(spark, rows, width, k=5, rounds=3, scale=64, schema=ROWS):
    kept = [(i, [floor(scale * v) for v in e]) for i, e, *_ in rows if e is not None and len(e) == width and all(v is not None and isfinite(v) for v in e)]
    first = {}
    for i, m in sorted(r for r in kept if r[0] is not None):
        first.setdefault(i, m)
    middle = [first[i] for i in sorted(first, key=lambda i: sha256(f"1:{i}".encode()).hexdigest())][:k]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((distance(m, c), e) for e, c in enumerate(middle)) for _, m in kept]
    for _ in range(rounds):
        at = assign()
        for e in range(len(middle)):
            if own := [m for (_, m), (_, a) in zip(kept, at, strict=True) if a == e]:
                middle[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    by = {e: sum(d for d, a in at if a == e) for e in range(len(middle))}
    want = [(i, e, d, by[e], sum(by.values()), sha256(",".join(map(str, middle[e])).encode()).hexdigest()) for (i, _), (d, e) in zip(kept, at, strict=True)]
    got = centroids.cluster_vectors(odd(spark.createDataFrame(rows, schema).repartition(3)), width=width, k=k, rounds=rounds, scale=scale).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_clusters_equal_full_search(spark):
    check_clusters(spark, rows_of(vectors(150, 16)), 16)
    check_clusters(spark, rows_of(vectors(60, 5, 4)), 5, k=16)  # fewer components than segments


def test_clusters_of_odd_rows(spark):
    x = rows_of(vectors(40, 8, 1))
    more = [(100, None, "a"), (101, [1.0, None] * 4, "a"), (102, [float("nan")] * 8, "b"), (103, [float("inf")] * 8, "b"), (None, [0.5] * 8, None), (3, [-9.0] * 8, "a"), (3, [-9.0] * 8, "a"), (200, [], "c"), (201, [0.0] * 3, "c"), (202, [1.0] * 9, "c")]
    check_clusters(spark, x + more, 8, k=7)
    check_clusters(spark, [(i, [0.5] * 8, "a") for i in range(9)], 8)  # ties everywhere: all go to the first
    check_clusters(spark, [(i, [float(i % 5)] * 4000, "a") for i in range(8)], 4000, k=3)  # long vectors
    for df in (spark.createDataFrame([], ROWS), spark.createDataFrame([(1, None, "a"), (None, [1.0] * 64, "a"), (2, [1.0], "a")], ROWS)):
        got = centroids.cluster_vectors(df)
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_segment_norms_bound_and_prune():
    x = np.floor(64 * vectors(2000, 64, 6, 0.15, 16)).astype(np.int64)
    c = x[:16]
    norms = centroids.segment_norms(x, 8)
    full = squared(x, c)
    assert (centroids.lower_bounds(norms, centroids.segment_norms(c, 8)) <= full).all()
    at, best, taken = centroids.nearest(x, norms, c, 8)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all() and taken < 2000 * 16 / 2


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def plain_verdict(host, path, listed, rules=urls.RULES):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[1], best[2]) if best else (None, "block" if host + path in listed and host + path else "allow")


PAGES = [
    None, "", "no mark", "http://", "://x", "HTTP://WWW.Example.NET/en/1?q#f", "http://example.net/en", "http://example.net/EN/", "http://badexample.net/en/", "http://net", "http://net/", "http://.net/", "http://a.org/fr/", "http://org/fr/x",
    "http://aorg/fr/", "http://a.example.com/de/?x", "http://a.example.com?/de/", "http://a.example.com#/de/", "x://y://z/p", "http://ÄÖ.com/É", "http://ünï.com/a\nb?c", "http://h.com/" + "p" * 200_000, "a" * 200_000, "http://" + "h." * 50_000 + "com", "http://dup.com/a", "http://dup.com/a",
]


@pytest.mark.parametrize("most_bytes", [1 << 18, 0], ids=["in the plan", "joined"])
def test_urls_equal_plain_rules(spark, most_bytes):
    rng = random.Random(1)
    data = PAGES + [f"https://{rng.choice('abcde')}{k % 7}.example.{rng.choice(('com', 'net', 'org', 'io'))}/{rng.choice(('en', 'de', 'fr'))}/{k}" for k in range(400)]
    keys = ["".join(plain_url(u)) for u in data]
    listed = set(rng.sample(keys, 90)) | {"not/here", "dup.com/a", "ünï.com/a\nb", "h.com/" + "p" * 200_000}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(data)] + [(None, "http://dup.com/a")], "page_id long, url string").repartition(3)
    given = spark.createDataFrame([(k,) for k in [*listed, *listed, "", None]], "key string")
    got = urls.judge_urls(odd(pages), given, part_keys=20, most_bytes=most_bytes).collect()
    assert len(got) == len(data) + 1
    for r in got:
        host, path = plain_url(data[r["page_id"]] if r["page_id"] is not None else "http://dup.com/a")
        rule, verdict = plain_verdict(host, path, listed)
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == (host, path, rule, verdict, host + path in listed and host + path != "")


def test_urls_without_rows_or_list(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert urls.judge_urls(pages.limit(0), none).collect() == [] == urls.judge_urls(pages.limit(0), spark.createDataFrame([("a",)], "key string")).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, none).collect()} == {1: (None, "allow"), 2: ("net/", "block")}
    every = spark.createDataFrame([("a.com/x",), ("b.net/",)], "key string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, every, rules=()).collect()} == {1: "block", 2: "block"}


@pytest.mark.parametrize("share", [0.01, 0.3, 0.9])
def test_cascades_have_no_errors_and_few_bits(spark, share):
    n = 20_000
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < int(1000 * share)).alias("listed"))
    held = urls.cascade(keys)
    assert len(held.bits) > 1 and held.held is not None
    assert held.member(keys, "told").where("told <> listed").count() == 0
    listed = keys.where("listed").count()
    assert 8 * sum(map(len, held.held)) < 24 * max(listed, n - listed if share > 0.5 else listed)
