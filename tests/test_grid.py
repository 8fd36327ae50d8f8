"""Range joins by cells, sweeps and tiled clusters against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import grid, layout
from tests.test_drafts import slow_merge

BOX = "page int, id int, x0 double, y0 double, x1 double, y1 double"


def random_boxes(seed, n, pages=2, first=0):
    """Boxes from points to as wide as the page, on both sides of zero, some touching."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.randrange(-200, 200), rng.randrange(-200, 200), rng.choice([0, 0, 1, 7, 16, 90, 400]), rng.choice([0, 0, 2, 16, 33, 400])
        rows.append((rng.randrange(pages), first + i, float(x), float(y), float(x + w), float(y + h)))
    return rows


def touch(a, b, gap=0.0):
    return a[0] == b[0] and a[2] <= b[4] + gap and b[2] <= a[4] + gap and a[3] <= b[5] + gap and b[3] <= a[5] + gap


def side(spark, rows, p):
    return layout.renamed(spark.createDataFrame(rows, BOX), p, ["page"])


def test_each_meeting_pair_once(spark):
    a, b = random_boxes(1, 120), random_boxes(2, 150)
    odd = [(0, 900, None, 0.0, 1.0, 1.0), (0, 901, 10.0, 0.0, -10.0, 1.0), (7, 902, 0.0, 0.0, 1.0, 1.0)]
    got = [(r.a_id, r.b_id) for r in grid.meeting(side(spark, a + odd, "a_"), side(spark, b + odd[:2], "b_"), ["page"]).collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in a for y in b if touch(x, y)) and len(got) > 300


def test_words_and_owners(spark):
    boxes, items = random_boxes(3, 200), random_boxes(4, 400)
    d, i = spark.createDataFrame(boxes, BOX), spark.createDataFrame(items, BOX)
    centre = lambda a: (a[0], 0, *([(a[2] + a[4]) / 2, (a[3] + a[5]) / 2] * 2))
    want = sorted((a[1], b[1]) for a in boxes for b in items if touch(centre(a), b))
    got = layout.words_in_region(d, i, ["page"])
    assert sorted((r.w_id, r.i_id) for r in got.collect()) == want and len(want) > 60
    assert got.columns == ["page", "w_id", *(f"w_{s}" for s in layout.SIDES), "i_id", *(f"i_{s}" for s in layout.SIDES)]

    def part(a, b):
        size = (a[4] - a[2]) * (a[5] - a[3])
        return a[0] == b[0] and size and max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3])) / size

    for least in (0.5, 0.1):
        owners = {a[1]: [b[1] for b in items if part(a, b) and part(a, b) >= least] for a in boxes}
        got = {r.id: (r.owners, r.owner) for r in layout.owner_of_box(d, i, ["page"], "id", "id", least).collect()}
        assert got == {a: (len(o), min(o)) for a, o in owners.items() if o} and len(got) > 5


def test_nearest_marker(spark):
    rng = random.Random(5)
    words = [(rng.randrange(3), i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(200)] + [(0, 999, None, 1.0)]
    markers = [(rng.randrange(2), 1000 - i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(60)] + [(0, 2000, 1.0, None)]
    got = layout.nearest_marker(spark.createDataFrame(words, "page int, word_id int, x double, y double"), spark.createDataFrame(markers, "page int, marker_id int, mx double, my double"), ["page"])
    want = []
    for p, w, x, y in words[:-1]:
        left = [(abs(my - y), -mx, m) for q, m, mx, my in markers[:-1] if q == p and mx <= x]
        want += [(p, w, min(left)[2])] if left else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_item_at(spark):
    rng = random.Random(6)
    items = [(p, i, rng.randrange(3), x0, y0, x1, y1) for p, i, x0, y0, x1, y1 in random_boxes(7, 60)]
    points = [(rng.randrange(3), i, float(rng.randrange(-220, 420)), float(rng.randrange(-220, 420))) for i in range(300)] + [(0, 999, None, 1.0)]
    got = layout.item_at(spark.createDataFrame(points, "page int, point_id int, x double, y double"), spark.createDataFrame(items, "page int, item_id int, col int, x0 double, y0 double, x1 double, y1 double"), ["page"])
    want = []
    for p, k, x, y in points:
        high = [(not i[3] <= x <= i[5], i[2], i[4], i[1]) for i in items if x is not None and i[0] == p and i[4] <= y <= i[6]]
        want.append((p, k, min(high)[3], not min(high)[0]) if high else (p, k, None, None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_page_of_many_boxes_makes_no_pairs_of_all(spark):
    """200,000 words and 40,000 cells of a table on one page: all pairs would be eight thousand million."""
    n, wide = 200_000, 200
    at = lambda c, k: ((F.col("id") * k) % (wide * 10)).cast("double").alias(c)
    words = spark.range(n).select(F.lit(1).alias("page"), "id", at("x0", 7919), at("y0", 104729)).withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})
    cells = spark.range(wide * wide).select(F.lit(1).alias("page"), "id", (F.col("id") % wide * 10.0).alias("x0"), (F.floor(F.col("id") / wide) * 10.0).alias("y0")).withColumns({"x1": F.col("x0") + 9, "y1": F.col("y0") + 9})
    found = layout.words_in_region(words, cells, ["page"])
    inside = (F.col("x0") % 10 + 0.5 <= 9) & (F.col("y0") % 10 + 0.5 <= 9)
    assert found.count() == words.where(inside).count() > 100_000
    own = (F.floor(F.col("w_y0") / 10) * wide + F.floor(F.col("w_x0") / 10)).cast("long")
    assert found.where(F.col("i_id") != own).count() == 0


def merged(rows, gap):
    return sorted((p, *m) for p in {r[0] for r in rows} for m in slow_merge([tuple(r[2:]) for r in rows if r[0] == p], gap))


@pytest.mark.parametrize("tile", [5, 40, 20_000])
def test_clusters_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(layout, "TILE", tile)
    rng = random.Random(8)
    rows = [(p, i, x, y, x + rng.random() * 25, y + rng.random() * 25) for p, i, x, y, *_ in random_boxes(9, 150, 3)]
    rows += [(9, 1000 + i, 5.0, 5.0, 6.0, 6.0) for i in range(30)]  # a heap of equal boxes
    d = spark.createDataFrame(rows + [(0, -1, None, 0.0, 1.0, 1.0)], BOX)
    for gap in (0.0, 6.0):
        got = sorted(map(tuple, layout.box_clusters(d, "page", gap).collect()))
        assert [[round(x, 9) for x in g] for g in got] == [[round(x, 9) for x in m] for m in merged(rows, gap)]
    assert layout.box_clusters(d.limit(0), "page").count() == 0


def figures(images, strokes, sizes, gap):
    """The whole operator by loops."""
    out = []
    for page, (width, height) in sizes.items():
        wide = lambda b: (b[2] - b[0], b[3] - b[1])
        large = lambda b: min(wide(b)) >= 25
        fits = lambda b: wide(b)[0] * wide(b)[1] <= width * height * 0.45  # noqa: B023, E731
        own = [tuple(b[2:]) for b in images if b[0] == page]
        pictures = sorted((m for m in slow_merge([b for b in own if min(wide(b)) >= 4], gap) if large(m)), key=lambda m: (m[1], m[0]))
        lines = [tuple(b[2:]) for b in strokes if b[0] == page]
        frame = lambda b: wide(b)[0] >= 0.95 * width and wide(b)[1] < 4 or wide(b)[1] >= 0.95 * height and wide(b)[0] < 4  # noqa: B023, E731
        drawn = [m for m in slow_merge([b for b in lines if not frame(b) and max(wide(b)) >= 2], gap) if m[4] >= 4 and large(m) and fits(m)]
        home = {}
        for k, d in enumerate(drawn):
            met = [i for i, p in enumerate(pictures) if d[0] < p[2] and p[0] < d[2] and d[1] < p[3] and p[1] < d[3]]
            if met:
                home.setdefault(met[0], []).append(k)
        found = []
        for i, p in enumerate(pictures):
            parts = [p, *(drawn[k] for k in home.get(i, []))]
            found.append((*(min(b[s] for b in parts) for s in (0, 1)), *(max(b[s] for b in parts) for s in (2, 3)), "image"))
        found = [f for f in found if fits(f)] + [(*d[:4], "vector") for k, d in enumerate(drawn) if not any(k in h for h in home.values())]
        found.sort(key=lambda f: (f[0] > width / 2, f[1], f[0], f[4]))
        out += [(page, *f, n) for n, f in enumerate(found, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_figures_like_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(layout, "TILE", 12)
    rng = random.Random(seed)

    def boxes(n, most):
        for i in range(n):
            x, y = rng.randrange(560), rng.randrange(760)
            yield (i % 2, i, float(x), float(y), float(x + rng.randrange(most)), float(y + rng.randrange(most)))

    images, strokes = list(boxes(24, 90)), list(boxes(160, 40)) + [(0, 500, 0.0, 10.0, 600.0, 11.0), (1, 501, 5.0, 0.0, 6.0, 800.0)]
    sizes = {0: (600.0, 800.0), 1: (600.0, 800.0)}
    page = spark.createDataFrame([(p, *s) for p, s in sizes.items()], "page int, width double, height double")
    plain = lambda rows: spark.createDataFrame(rows, BOX).select("page", *layout.SIDES)
    got = layout.figure_regions(plain(images), plain(strokes), page, "page", 5.0)
    assert sorted(str(tuple(r)) for r in got.collect()) == figures(images, strokes, sizes, 5.0) and got.count() > 4
