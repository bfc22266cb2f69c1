"""Raster operators against plain NumPy loops, and their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import pixels as X
from pixelmill.operators import frames as FR, resize as R, sharpen as S, tiling as T
from pixelmill.plans import prepare as PR

SCHEMA = "image_id long, c int, y int, h int, v array<double>"


def rows(spark, *images):
    """Raster rows of arrays [channels, h, w]."""
    data = [
        (i, c, y, img.shape[1], [float(a) for a in img[c, y]])
        for i, img in enumerate(images) for c in range(img.shape[0]) for y in range(img.shape[1])
    ]
    return spark.createDataFrame(data, SCHEMA)


def arrays(df):
    """Back to arrays by image_id."""
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[(r.c, r.y)] = r.v
        assert r.h > r.y
    return {
        i: np.array([[cells[c, y] for y in sorted({k[1] for k in cells})] for c in sorted({k[0] for k in cells})])
        for i, cells in out.items()
    }


def picture(channels, h, w, seed=0):
    return np.random.default_rng(seed).random((channels, h, w))


def padded(img, r):
    """Mirrored without repeating the edge, also for sides of one pixel."""
    for axis in (1, 2):
        n = img.shape[axis]
        index = np.arange(-r, n + r)
        index = np.zeros_like(index) if n == 1 else np.abs((index + (n - 1)) % (2 * (n - 1)) - (n - 1))
        img = np.take(img, index, axis=axis)
    return img


def slow_cas(img, amount, diagonals):
    p, out = padded(img, 1), np.empty_like(img)
    for c, y, x in np.ndindex(img.shape):
        win = p[c, y:y + 3, x:x + 3]
        used = win.ravel() if diagonals else np.array([win[0, 1], win[1, 0], win[1, 1], win[1, 2], win[2, 1]])
        low, high = used.min(), used.max()
        amp = np.sqrt(max(0.0, min(low, (2 if diagonals else 1) - high) / (high + 1e-6)))
        w = -amp * (amount * (0.2 - 0.125) + 0.125)
        near = win[0, 1] + win[1, 0] + win[1, 2] + win[2, 1]
        out[c, y, x] = min(1.0, max(0.0, (near * w + win[1, 1]) / (1 + 4 * w)))
    return out


def slow_adaptive(img, strength, overshoot, anime):
    """One pixel at a time, straight from the published formula."""
    p, out = padded(img, 3), np.empty_like(img)
    light, dark = (0.334, 0.5) if overshoot else (0.167, 0.25)
    luma = lambda t: 0.299 * t[0] + 0.587 * t[1] + 0.114 * t[2]
    diamond = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if abs(dy) + abs(dx) <= 3]
    assert len(diamond) == 25
    kind = {0: 1.38, 1: 1.15, 2: 0.92}
    for y in range(img.shape[1]):
        for x in range(img.shape[2]):
            at = lambda dy, dx: p[:, y + 3 + dy, x + 3 + dx]
            mid = at(0, 0)
            ring = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            blur = sum(at(*o) * (4, 2, 1)[abs(o[0]) + abs(o[1])] for o in ring) / 16
            comp = min(1.0, max(0.0, 0.266666681 + 0.9 * 2 ** (blur.sum() * -7.4 / 3)))
            e = sum(kind[abs(o[0]) + abs(o[1])] * abs(blur - at(*o)) for o in ring)
            e = e + sum(0.23 * abs(blur - at(*o)) for o in ((2, 0), (-2, 0), (0, 2), (0, -2)))
            edge = np.sqrt((e ** 2).sum()) * comp
            ys = sorted(luma(at(*o)) for o in diamond)
            c0 = luma(mid)
            lap = sum(luma(at(*o)) for o in ring if o != (0, 0)) / 8
            diff = (c0 - lap) * strength / (strength * 0.5 * edge ** 3.5 + 0.625)
            top, low = (max(ys[-2], c0) * 3 + ys[-1]) / 4, (min(ys[1], c0) * 3 + ys[0]) / 4
            reach = min(abs(top - c0), abs(c0 - low)) + 0.003
            lim = min(reach, 0.1 * (1 - 0.056) + reach * 0.056)
            t = abs(diff) / (lim + 1e-6)
            soft = min(1.0, t * (27 + t * t) / (27 + 9 * t * t)) * lim
            if diff > 0:
                diff = 0.0 if anime else light * abs(diff) + (1 - light) * soft
            else:
                diff = -(dark * abs(diff) + (1 - dark) * soft)
            cut = min(1.0, max(0.0, c0 + diff)) - c0
            sat = (c0 + max(cut * 0.9, cut) * 1.03 + 0.03) / (c0 + 0.03)
            out[:, y, x] = np.clip(c0 + (cut * 3 + diff) / 4 + (mid - c0) * sat, 0, 1)
    return out


@pytest.mark.parametrize("diagonals", [True, False])
def test_cas(spark, diagonals):
    images = [picture(3, h, w, h * 100 + w) for h, w in ((1, 1), (1, 5), (5, 1), (7, 9), (150, 3), (65, 2))]
    got = arrays(S.cas_sharpen(rows(spark, *images), 0.6, diagonals))
    for i, img in enumerate(images):
        assert np.allclose(got[i], slow_cas(img, 0.6, diagonals), atol=1e-12)
    assert not np.allclose(got[3], slow_cas(images[3], 0.61, diagonals), atol=1e-12)


@pytest.mark.parametrize("overshoot,anime", [(False, False), (True, True)])
def test_adaptive(spark, overshoot, anime):
    images = [picture(3, h, w, h + w) for h, w in ((1, 1), (2, 4), (7, 9), (66, 3))]
    got = arrays(S.adaptive_sharpen(rows(spark, *images), 0.8, overshoot, anime))
    for i, img in enumerate(images):
        assert np.allclose(got[i], slow_adaptive(img, 0.8, overshoot, anime), atol=1e-12)
    grey = picture(1, 6, 5)
    want = slow_adaptive(np.repeat(grey, 3, axis=0), 0.8, overshoot, anime)[:1]
    assert np.allclose(arrays(S.adaptive_sharpen(rows(spark, grey), 0.8, overshoot, anime))[0], want, atol=1e-12)


def test_sharpen_leaves_flat_and_alpha(spark):
    img = np.concatenate([np.full((3, 8, 8), 0.4), picture(1, 8, 8)])
    for out in (S.cas_sharpen(rows(spark, img)), S.adaptive_sharpen(rows(spark, img))):
        got = arrays(out)[0]
        assert np.allclose(got[3], img[3]) and np.allclose(got[:3], 0.4)
    df = rows(spark, img)
    assert S.cas_sharpen(df, 0) is df and S.adaptive_sharpen(df, -1) is df


def lacking(df, *gone):
    """Without the rows (image, channel, y) that `gone` names; every second one of them stays as a row without values."""
    for k, (i, c, y) in enumerate(gone):
        here = F.expr(f"image_id = {i} AND c = {c} AND y = {y}")
        df = df.where(~here) if k % 2 else df.withColumn("v", F.when(~here, F.col("v")))
    return df


def values(df):
    return {(r.image_id, r.c, r.y): r.v for r in df.collect() if r.v is not None}


def test_cas_of_a_picture_that_lacks_rows(spark):
    """Rows that lack give none, are no neighbour's least or largest value and nothing in its sum; other rows are as before."""
    img = picture(4, 70, 5, 3)
    gone = [(0, 0, 69), (0, 0, 68), (0, 0, 30), (0, 0, 31), (0, 1, 3), (0, 3, 4)]
    got, whole = values(S.cas_sharpen(lacking(rows(spark, img), *gone), 0.6)), values(S.cas_sharpen(rows(spark, img), 0.6))
    assert whole.keys() - got.keys() == set(gone) and len(whole) == 280
    near = {(0, c, y + d) for _, c, y in gone if c < 3 for d in (-1, 1)}
    assert all(np.allclose(got[k], whole[k], atol=1e-12) == (k not in near) for k in got)
    used = padded(img, 1)[0, 67:70]  # the last row that is there, and the two above and below it
    for x in range(5):
        seen = used[:2, x:x + 3]
        amp = np.sqrt(max(0.0, min(seen.min(), 2 - seen.max()) / (seen.max() + 1e-6)))
        w = -amp * (0.6 * (1 / 5 - 1 / 8) + 1 / 8)
        cross = used[0, x + 1] + used[1, x] + used[1, x + 2]
        assert np.isclose(got[0, 0, 67][x], np.clip((cross * w + used[1, x + 1]) / (1 + 4 * w), 0, 1), atol=1e-12)


def test_adaptive_of_a_picture_that_lacks_channels_and_rows(spark):
    """A channel that lacks counts as 0, a row that lacks as the row beside it; neither is made up."""
    img = picture(4, 9, 6, 5)
    for lost in range(3):
        gone = [(0, lost, y) for y in range(9)]
        got = values(S.adaptive_sharpen(lacking(rows(spark, img), *gone), 0.8))
        zero = img.copy()
        zero[lost] = 0.0
        want = values(S.adaptive_sharpen(rows(spark, zero), 0.8))
        assert want.keys() - got.keys() == set(gone) and all(np.allclose(got[k], want[k], atol=1e-12) for k in got)
    flat = np.full((3, 9, 6), 0.4)
    got = values(S.adaptive_sharpen(lacking(rows(spark, flat), *[(0, c, y) for c in range(3) for y in (4, 5, 8)]), 0.8))
    assert len(got) == 18 and np.allclose([*got.values()], 0.4)
    alone = values(S.cas_sharpen(lacking(rows(spark, picture(1, 2, 3)), (0, 0, 0), (0, 0, 0)), 0.6))
    assert alone.keys() == {(0, 0, 1)}
    assert not values(S.cas_sharpen(rows(spark, picture(1, 1, 3)).withColumn("v", F.lit(None).cast("array<double>"))))


def slow_resize(img, nh, nw, kernel, radius):
    def one(data, new):
        old = data.shape[0]
        if old == new:
            return data
        scale = new / old
        reach = radius / scale if scale < 1 else radius
        out = np.zeros((new,) + data.shape[1:])
        for i in range(new):
            at = (i + 0.5) / scale - 0.5
            ks = range(int(np.floor(at - reach)), int(np.ceil(at + reach)) + 1)
            ws = [kernel(abs(at - k) / reach) for k in ks]
            for k, w in zip(ks, ws):
                if w / sum(ws) > 0:
                    out[i] += w / sum(ws) * data[min(old - 1, max(0, k))]
        return out

    return np.stack([np.clip(one(one(c, nh).T, nw).T, 0, 1) for c in img])


def _hermite(a):
    return (2 * a - 3) * a * a + 1 if a <= 1 else 0.0


def _lanczos(a):
    return 1.0 if a < 1e-8 else 3 * np.sin(np.pi * a) * np.sin(np.pi * a / 3) / (np.pi * a) ** 2 if a < 3 else 0.0


@pytest.mark.parametrize("size", [(1, 1), (5, 3), (20, 33), (9, 7), (40, 2)])
def test_resize(spark, size):
    img = picture(2, 9, 7)
    for name, fn, radius in (("hermite", _hermite, 1), ("lanczos", _lanczos, 3)):
        got = arrays(R.resize(rows(spark, img), F.lit(size[1]), F.lit(size[0]), name))[0]
        assert got.shape[1:] == size
        assert np.allclose(got, slow_resize(img, *size, fn, radius), atol=1e-12)


def test_resize_kernel_of_a_user_and_unknown(spark):
    R.register_kernel("box", lambda x: (np.abs(x) <= 0.5).astype(float), 1.0)
    img = np.full((1, 6, 6), 0.3)
    assert np.allclose(arrays(R.resize(rows(spark, img), F.lit(3), F.lit(4), "box"))[0], 0.3)
    with pytest.raises(ValueError):
        R.resize(rows(spark, img), F.lit(3), F.lit(4), "bicubic")


def test_weights_sum_to_one(spark):
    sizes = spark.createDataFrame([(o, n) for o in (1, 2, 7, 50) for n in (1, 3, 50, 99)], "old_n int, new_n int")
    sums = R.resize_weights(sizes, "hermite").groupBy("old_n", "new_n", "o").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_tile_grid_follows_the_loop(spark):
    sizes = [(i, 1 + i * 37 % 900, 1 + i * 91 % 700) for i in range(60)]
    got = T.tile_grid(spark.createDataFrame(sizes, "image_id long, w int, h int"), 200, 130, 9, align=True).collect()
    have = {(r.image_id, r.tile_no): (r.x0, r.y0, r.tw, r.th) for r in got}
    want = {}
    for i, w, h in sizes:
        no, y = 0, 0
        while True:
            x = 0
            while True:
                want[i, no] = (x, y, min(192, w - x), min(128, h - y))
                no, x = no + 1, x + 192 - 18
                if x >= w or x + 9 >= w:
                    break
            y += 128 - 18
            if y >= h or y + 9 >= h:
                break
    assert have == want


def test_tiles_that_never_end_are_an_error(spark):
    images = spark.createDataFrame([(1, 9, 9)], "image_id long, w int, h int")
    for tile, overlap in ((64, 32), (63, 1)):
        with pytest.raises(ValueError):
            T.tile_grid(images, tile, tile, overlap)


def test_blend_is_identity_inside_and_zero_at_feathered_edge(spark):
    img = picture(4, 21, 37)
    doubled = img.repeat(2, axis=1).repeat(2, axis=2)
    plain = arrays(T.upscale(rows(spark, img), 2, None, 16, 12, 3, align=False))[0]
    assert np.allclose(plain, doubled)
    edge = arrays(T.upscale(rows(spark, img), 2, None, 16, 12, 3, align=False, feather_edges=True))[0]
    assert np.allclose(edge[:, 1:-1, 1:-1], doubled[:, 1:-1, 1:-1])
    assert (edge[:, 0] == 0).all() and (edge[:, :, -1] == 0).all()
    whole = arrays(T.upscale(rows(spark, img), 2, None, 64, 64, 3, feather_edges=True))[0]
    assert np.allclose(whole, doubled)


def test_model_gets_three_channels_and_padded_tiles(spark):
    def load():
        def model(batch):
            assert batch.shape[1] == 3 and batch.shape[2] % 8 == 0 and batch.shape[3] % 8 == 0
            return batch.repeat(2, axis=2).repeat(2, axis=3) * 1.5
        return model

    from pixelmill.operators.inference import infer_tiles

    img = picture(4, 9, 10)
    out = T.blend_tiles(infer_tiles(T.tile_rows(rows(spark, img), 8, 8, 2), load, 2, pad_to=8), 16, 16, 4)
    want = np.clip(img.repeat(2, axis=1).repeat(2, axis=2) * 1.5, 0, 1)
    assert np.allclose(arrays(out)[0], want, atol=1e-6)


@pytest.mark.parametrize("h,w", [(1, 1), (1, 6), (3, 5), (8, 8), (9, 2)])
def test_padding(spark, h, w):
    img = picture(1, h, w)
    r = max(-h % 8, -w % 8)
    want = padded(img, r)[:, r:r + h + (-h % 8), r:r + w + (-w % 8)]
    assert np.allclose(arrays(T.pad_to_multiple(rows(spark, img), 8))[0], want)


def test_bad_values_to_bytes(spark):
    values = [float("nan"), float("inf"), float("-inf"), -0.1, 1.1, 255.0, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.to_uint8(F.col("v"))).collect()] == [0, 255, 0, 0, 255, 255, 127]


def test_signature_equals_slow_thumbnail(spark):
    img = picture(3, 20, 24)
    full = lambda a: np.sinc(a) * np.sinc(a / 3) if a < 3 else 0.0

    def one(data, new):
        old, out = data.shape[0], np.zeros((16,) + data.shape[1:])
        scale = new / old
        for i in range(new):
            at, reach = (i + 0.5) / scale - 0.5, 3 / scale
            ks = range(int(np.floor(at - reach)), int(np.ceil(at + reach)) + 1)
            ws = np.array([full(abs(at - k) * scale) for k in ks])
            out[i] = sum(w * data[min(old - 1, max(0, k))] for k, w in zip(ks, ws / ws.sum()))
        return out

    small = np.stack([np.clip(one(one(c, 16).T, 16).T, 0, 1) for c in img])
    grey = (0.299 * small[0] + 0.587 * small[1] + 0.114 * small[2]) * 255
    sig = FR.frame_signature(rows(spark, img)).collect()[0].sig
    assert sig == "".join(f"{int(a):02X}" for a in grey.ravel())


def test_prepare_chain(spark):
    img = picture(4, 40, 30)
    recipe = PR.Recipe(prescale=PR.Scaling("2x", kernel="hermite"), scale=2, tile=(12, 12), overlap=2, align=False,
                       custom=PR.Scaling("width", width=24, kernel="hermite"), sharpen=0.5)
    got = arrays(PR.prepare(rows(spark, img), recipe))[0]
    half = slow_resize(img, 20, 15, _hermite, 1)
    want = slow_resize(half.repeat(2, axis=1).repeat(2, axis=2), 32, 24, _hermite, 1)
    want[:3] = slow_cas(want[:3], 0.5, True)
    assert np.allclose(got, want, atol=1e-10)


def test_animation_finds_its_own_repeats(spark):
    """Frames whose 8-bit values are equal are one frame, without a given signature."""
    a, b = picture(3, 20, 24), picture(3, 20, 24) * 0.5
    pictures = [a, a + 1e-6, b, b, a]
    rasters = rows(spark, *pictures)
    frames = spark.createDataFrame([(1, k, 10, k) for k in range(5)], "anim_id long, frame_no long, duration_ms int, image_id long")
    merged, out = PR.upscale_animation(frames, rasters, PR.Recipe())
    assert sorted((r.frame_no, r.n_frames, r.duration_ms) for r in merged.collect()) == [(0, 2, 20), (2, 2, 20), (4, 1, 10)]
    assert {r.image_id for r in out.select("image_id").collect()} == {0, 2, 4}


def test_animation_stats_tell_alpha_and_frames_before_merging(spark):
    from pixelmill.operators import frames as FR

    rows = [(1, 0, 10, "a", False), (1, 1, 10, "a", True), (1, 2, 10, "b", False), (2, 0, 10, "a", False), (2, 1, 10, "a", None)]
    frames = spark.createDataFrame(rows, "anim_id long, frame_no long, duration_ms int, sig string, alpha boolean")
    found = FR.animation_stats(FR.merge_islands(frames)).collect()
    assert sorted((r.anim_id, r.n_kept, r.n_dropped, r.n_frames, r.any_alpha) for r in found) == [(1, 2, 1, 3, True), (2, 1, 1, 2, False)]


def test_raw_video_files_equal_a_loop(spark, tmp_path):
    """Frames with gaps in their numbers, animations of several sizes, with and without alpha."""
    from pixelmill.operators import frames as FR
    from pixelmill.sources import sinks as SK

    rng = np.random.default_rng(4)
    shapes = {"a/b": (5, 3, [0, 2, 3]), "c": (1, 1, [7]), "d": (40, 8, list(range(0, 30, 2)))}
    pictures = {(k, n): rng.integers(0, 256, (4, h, w)) for k, (h, w, numbers) in shapes.items() for n in numbers}
    rows = [(k, n, y, *(p[c, y].tolist() for c in range(4))) for (k, n), p in pictures.items() for y in range(p.shape[1])]
    frames = spark.createDataFrame([(k, n, 30 + n) for k, n in pictures], "anim_id string, frame_no long, duration_ms int")
    table = spark.createDataFrame(rows, "anim_id string, frame_no long, y int, r array<int>, g array<int>, b array<int>, a array<int>").repartition(5)
    for alpha in (True, False):
        folder = tmp_path / str(alpha)
        parts = FR.y4m_parts(frames, table, alpha)
        assert parts.agg(F.max(F.length("bytes"))).first()[0] < 60  # a header or a row, never a frame
        SK.write_y4m(parts, f"file://{folder}")
        assert sorted(p.name for p in folder.iterdir()) == ["a%2Fb.y4m", "c.y4m", "d.y4m"]
        for k, (h, w, numbers) in shapes.items():
            rate = int(sum(30 + n for n in numbers) / len(numbers))
            want = f"YUV4MPEG2 W{w} H{h} F1000:{rate} Ip A1:1 C444{'alpha' if alpha else ''}\n".encode()
            for n in numbers:
                r, g, b, a = pictures[k, n].astype(float)
                planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.169 * r - 0.331 * g + 0.5 * b + 128, 0.5 * r - 0.419 * g - 0.081 * b + 128] + [a] * alpha
                want += b"FRAME\n" + b"".join(np.floor(np.clip(p, 0, 255)).astype(np.uint8).tobytes() for p in planes)
            assert (folder / k.replace("/", "%2F")).with_suffix(".y4m").read_bytes() == want if k != "a/b" else (folder / "a%2Fb.y4m").read_bytes() == want
    broken = parts.where("NOT (anim_id = 'd' AND part[0] = 4 AND part[1] = 1 AND part[2] = 3)")
    with pytest.raises(Exception, match="where a part begins"):
        SK.write_y4m(broken, f"file://{tmp_path}/broken")
    assert not list((tmp_path / "broken").glob("*.y4m"))


def test_raw_video_of_rows_that_lack_channels(spark, tmp_path):
    """The file keeps its size: a channel that lacks is 0, alpha is opaque, a row without colour is black."""
    from pixelmill.operators import frames as FR
    from pixelmill.sources import sinks as SK

    table = spark.createDataFrame(
        [(1, 0, 0, [10, 20], None, [30, 40], None), (1, 0, 1, None, None, None, [7, 8]), (1, 1, 0, None, [50, 60], None, [9, 9]), (1, 1, 1, None, None, None, None)],
        "anim_id long, frame_no long, y int, r array<int>, g array<int>, b array<int>, a array<int>",
    )
    frames = spark.createDataFrame([(1, 0, 40), (1, 1, 40)], "anim_id long, frame_no long, duration_ms int")
    SK.write_y4m(FR.y4m_parts(frames, table, True), f"file://{tmp_path}/out")
    want = b"YUV4MPEG2 W2 H2 F1000:40 Ip A1:1 C444alpha\n"
    for planes, alpha in ((((10, 0, 30), (20, 0, 40), (0, 0, 0), (0, 0, 0)), (255, 255, 7, 8)), (((0, 50, 0), (0, 60, 0), (0, 0, 0), (0, 0, 0)), (9, 9, 255, 255))):
        r, g, b = np.array(planes, float).T
        made = [0.299 * r + 0.587 * g + 0.114 * b, -0.169 * r - 0.331 * g + 0.5 * b + 128, 0.5 * r - 0.419 * g - 0.081 * b + 128]
        want += b"FRAME\n" + b"".join(np.floor(np.clip(p, 0, 255)).astype(np.uint8).tobytes() for p in made) + bytes(alpha)
    assert (tmp_path / "out" / "1.y4m").read_bytes() == want


def slow_median_cut(counts, colors):
    """Boxes as lists of ((r, g, b), n); the code's order is the colours' order."""
    boxes = [sorted(counts.items())]
    pixels = lambda box: sum(n for _, n in box) if len(box) > 1 else 0
    while len(boxes) < colors and max(map(pixels, boxes)) > 0:
        k = max(range(len(boxes)), key=lambda i: (pixels(boxes[i]), -i))
        wide = [max(c[j] for c, _ in boxes[k]) - min(c[j] for c, _ in boxes[k]) for j in range(3)]
        box, seen, cut = sorted(boxes[k], key=lambda e: (e[0][wide.index(max(wide))], e[0])), 0, 0
        while 2 * seen < pixels(box):
            seen, cut = seen + box[cut][1], cut + 1
        cut = min(cut, len(box) - 1)
        boxes[k] = box[:cut]
        boxes.append(box[cut:])
    out = {}
    for k, box in enumerate(boxes):
        total = sum(n for _, n in box)
        mean = tuple(sum((c[j] * 8 + 4) * n for c, n in box) // total for j in range(3))
        out.update({c: (n, k, *mean) for c, n in box})
    return out


@pytest.mark.parametrize("colors", [1, 2, 7, 256])
def test_adaptive_palette_equals_a_loop(spark, colors):
    from collections import Counter
    from pixelmill.operators import colors as CO

    rng = np.random.default_rng(colors)
    pictures = {1: rng.random((4, 20, 30)), 2: np.repeat(rng.random((4, 1, 1)), 9, 2), 3: rng.random((3, 16, 16)) ** 3, 4: np.round(rng.random((4, 12, 12)) * 2) / 2}
    rows_ = [(i, c, y, p.shape[1], p[c, y].tolist()) for i, p in pictures.items() for c in range(len(p)) for y in range(p.shape[1])]
    df = spark.createDataFrame(rows_, "image_id long, c int, y int, h int, v array<double>").repartition(4)
    got = {i: {} for i in pictures}
    for r in CO.adaptive_palette(df, colors).collect():
        got[r.image_id][r.color >> 10, r.color >> 5 & 31, r.color & 31] = (r.n, r.entry, r.r, r.g, r.b)
    for i, p in pictures.items():
        eight = np.floor(p * 255).astype(int)
        rgb = eight[:3].astype(float)
        if len(p) == 4:
            alpha = eight[3] / 255.0
            rgb = np.floor(rgb * alpha + (1.0 - alpha) * 255.0)
        counts = Counter(zip(*(x.ravel().tolist() for x in rgb.astype(int) >> 3)))
        assert got[i] == slow_median_cut(counts, colors)
        assert len({e[1] for e in got[i].values()}) == min(colors, len(counts))
