"""Moran's I on a grid against NumPy; a planted gradient and noise."""

import numpy as np

from patchwright.operators import spatial


def plain(cells):
    """I of {(x, y): v} by all pairs."""
    v = np.array(list(cells.values()))
    z = v - v.mean()
    at = {p: k for k, p in enumerate(cells)}
    links = [(at[x, y], at[x + dx, y + dy]) for x, y in cells for dx, dy in ((1, 0), (0, 1)) if (x + dx, y + dy) in at]
    return len(v), len(links), len(v) / len(links) * sum(z[i] * z[j] for i, j in links) / (z**2).sum()


def test_gradient_noise_and_odd_places(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name, f in {"gradient": lambda x, y: x + y + 0.1 * rng.normal(), "noise": lambda x, y: rng.normal(), "board": lambda x, y: (x + y) % 2 + 0.01 * rng.normal()}.items():
        cells = {(x, y): float(f(x, y)) for x in range(12) for y in range(12) if rng.random() < 0.9}
        want[name] = plain(cells)
        rows += [(name, x, y, v) for (x, y), v in cells.items()]
    rows += [("gradient", 3, None, 9.0), ("gradient", 3, 3, None), ("lone", 0, 0, 1.0), ("flat", 0, 0, 2.0), ("flat", 0, 1, 2.0), ("apart", 0, 0, 1.0), ("apart", 5, 5, 2.0), (None, 0, 0, 1.0), (None, 1, 0, 3.0)]
    x, y = next((x, y) for n, x, y, _ in rows if n == "noise")
    twice = rows + [("noise", x, y, next(v for n, a, b, v in rows if (n, a, b) == ("noise", x, y)))]  # the same place again: the mean
    schema = "tile string, gx int, gy int, v double"
    df = spark.createDataFrame(twice, schema)
    for block in (4096, 30):
        monkeypatch.setattr(spatial, "BLOCK", block)
        got = {r.tile: r for r in spatial.morans_grid(df.repartition(5), ["tile"], "v").collect()}
        assert set(got) == {"gradient", "noise", "board", "lone", "flat", "apart", None}
        for name, (n, links, i) in want.items():
            assert (got[name].n, got[name].links) == (n, links) and abs(got[name].moran - i) < 1e-8
            assert abs(got[name].expected + 1 / (n - 1)) < 1e-12
        assert got["gradient"].p == 0.01 and 0.05 < got["noise"].p and got["board"].p == 1.0
        assert [got[k].moran for k in ("lone", "flat", "apart")] == [None] * 3 and got["lone"].p is None and got["lone"].expected is None
        assert got[None].links == 1 and abs(got[None].moran + 2.0 / 1 / 2) < 1e-9
    assert spatial.morans_grid(df.limit(0), ["tile"], "v").count() == 0
