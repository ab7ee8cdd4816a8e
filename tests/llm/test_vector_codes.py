"""Vector codes against plain whole-number Python."""

import hashlib
import math

import numpy as np
from corpora import with_clashes

from tillscope.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, codes, width):
    most, part = 1 << vector_codes.bits_allowed(width), width // codes.parts
    kept = sorted(((i is None, i or 0, np.clip([math.floor(codes.scale * float(np.float32(x))) for x in v], -most, most).tolist() + [0] * (width - len(v)), y) for i, v, y in rows if usable(v)),
                  key=lambda r: (r[0], r[1], np.array(r[2], "<i4").tobytes()))
    cut = [[x[p * part : (p + 1) * part] for p in range(codes.parts)] for _, _, x, _ in kept]
    books = [[c[p] for c in cut[: codes.entries]] for p in range(codes.parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(codes.rounds):
        for p, book in enumerate(books):
            mine = {}
            for c in cut:
                mine.setdefault(near(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(col) // len(mine[e]) for col in zip(*mine[e], strict=True)] if e in mine else old for e, old in enumerate(book)]
    out, sums = [], {}
    for (none, i, _, y), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(codes.parts)]
        out.append((None if none else i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), y))
        sums[y] = sums.get(y, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[y], digest) for i, c, e, y in out), key=str)


def rows(seed=3, n=120, d=10):
    rng = np.random.default_rng(seed)
    some = [(i, rng.normal(size=d).tolist(), i % 3) for i in range(n)]
    some += [(500 + i, some[4][1], None) for i in range(40)]  # copies of one vector
    some += [(700, None, 1), (701, [None] * d, 1), (702, [float("nan")] * d, 1), (703, [float("-inf")] * d, 1), (704, [0.0] * d, 1), (None, [0.5] * d, 2), (705, [], 2), (706, [0.25] * 4, 2)]
    return some + [(707, [3e38, -3e38] * (d // 2), 2), (9, some[9][1], 0), (9, some[8][1], 0)]


def test_codes_equal_brute_force(spark):
    df = with_clashes(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    for codes in (vector_codes.Codes(entries=7), vector_codes.Codes(entries=5, parts=3, rounds=2, scale=16), vector_codes.Codes()):
        found = vector_codes.compress(df, codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
        width = -(-10 // codes.parts) * codes.parts
        assert sorted(map(tuple, found), key=str) == brute(rows(), codes, width)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0, 3.0, 4.0], None), (1, [], 5)], SCHEMA)
    assert sorted(r["code"] for r in vector_codes.compress(df).collect()) == ["00000000", "01010101"]
    assert vector_codes.compress(spark.createDataFrame([(1, [], 5), (2, [], 5)], SCHEMA)).select("code", "error").distinct().collect() == [("00000000", 0)]
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 5)], SCHEMA)).count() == 0


def test_limb_products_are_exact():
    rng = np.random.default_rng(4)
    for bits, d in ((5, 1), (20, 16), (27, 64), (28, 3)):
        a, b = (rng.integers(-(1 << bits), (1 << bits) + 1, (9, d)) for _ in range(2))
        a[0], b[0], a[1] = 1 << bits, 1 << bits, -(1 << bits)
        exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        for width in (None, 6, 11):
            assert vector_codes.products(a, b, width).tolist() == exact
    assert vector_codes.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_the_first_of_equally_near_entries():
    book = np.array([[4], [0], [0], [4]])
    assert [x.tolist() for x in vector_codes.nearest(np.array([[2], [1], [3], [-1]]), book)] == [[0, 1, 0, 1], [4, 1, 1, 1]]
