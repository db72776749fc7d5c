"""Values worked out by hand, properties, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwright import schema
from patchwright.functions import ids, labels, raster
from patchwright.operators import audit, features, metrics, ml, quality, sampling, splits, stats
from patchwright.sources import archive, config, tables, tiff


def pred(spark, y, s, **more):
    return spark.createDataFrame([(a, b, *more.values()) for a, b in zip(y, s, strict=True)], ["true_label", "score", *more])


def one(df):
    return df.first().asDict()


def test_average_precision_with_ties(spark):
    r = one(metrics.ranking(pred(spark, [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.4, 0.1]), []))
    assert r["ap"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3) and r["auroc"] == pytest.approx(7 / 9)
    t = one(metrics.tune_threshold(pred(spark, [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.4, 0.1]), [], 0.5))
    assert (t["threshold"], t["val_f1"]) == (0.4, pytest.approx(0.75))


def test_undefined_metrics_are_null(spark):
    none, every = pred(spark, [0, 0], [0.2, 0.1]), pred(spark, [1, 1], [0.2, 0.1])
    assert one(metrics.ranking(none, []))["ap"] is None and one(metrics.ranking(none, []))["auroc"] is None
    r = one(metrics.ranking(every, []))
    assert r["ap"] == 1 and r["auroc"] is None
    t = one(metrics.tune_threshold(none, [], 0.5))
    assert (t["threshold"], t["val_f1"]) == (0.5, 0.0)


def test_average_precision_is_not_the_trapezoid(spark, small):
    items = tables.parquet(spark, f"{small}/lineitem.parquet", ["l_returnflag", "l_discount"])
    r = one(metrics.ranking(items.select((F.col("l_returnflag") == "R").cast("int").alias("true_label"), F.col("l_discount").alias("score")), []))
    assert r["ap"] == pytest.approx(0.328978, abs=1e-6) and r["auroc"] == pytest.approx(0.498560, abs=1e-6)


def test_metric_properties(spark):
    p = tables.synthetic_predictions(spark, 400, 3).cache()
    base = {r["class"]: r for r in metrics.ranking(p, ["class"]).collect()}
    turned = {r["class"]: r for r in metrics.ranking(p.withColumn("score", 1 - F.col("score")), ["class"]).collect()}
    twice = {r["class"]: r for r in metrics.ranking(p.withColumn("w", F.lit(3)), ["class"], weight="w").collect()}
    assert base[0]["ap"] == 1 and base[0]["auroc"] is None
    for k in (1, 2):
        assert 0 < base[k]["ap"] <= 1
        assert turned[k]["auroc"] == pytest.approx(1 - base[k]["auroc"])
        assert twice[k]["ap"] == pytest.approx(base[k]["ap"])


def test_clustered_interval_is_wider(spark):
    rng = np.random.default_rng(1)
    rows = []
    for tile in range(20):
        effect = rng.normal(0, 0.3)
        for k in range(30):
            y = int(rng.random() < 0.4 + effect)
            rows.append((f"t{tile}", f"{tile}-{k}", 0, y, round(float(y * 0.3 + rng.normal(0, 0.3)), 2)))
    p = spark.createDataFrame(rows, "tile string, patch string, class int, true_label int, score double")
    width = lambda by: (lambda r: r["ap_macro_high"] - r["ap_macro_low"])(one(sampling.interval(sampling.bootstrap_many(p, by, 200, 5), [])))
    assert width("tile") > width("patch")


def test_wilcoxon_goldens(spark):
    d = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "d double")
    assert one(stats.wilcoxon(d(range(1, 11)), "d"))["p_value"] == pytest.approx(0.001953125)
    r = one(stats.wilcoxon(d([1, 2, 3, 4, -5, 6, 7, 8, 9, 10]), "d"))
    assert r["statistic"] == 5 and r["p_value"] == pytest.approx(0.01953125)
    rng = np.random.default_rng(4)
    for n in (12, 25, 60):  # ties too; by counting the sums of all sign patterns
        x = rng.integers(1, 15, n) * rng.choice([-1, 1, 1], n)
        size = np.abs(x)
        rank = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
        ways = {0: 1}
        for r in rank:
            more = dict(ways)
            for total, k in ways.items():
                more[total + 2 * r] = more.get(total + 2 * r, 0) + k
            ways = more
        low = min(rank[x > 0].sum(), rank[x < 0].sum())
        want = min(1, 2 * sum(k for total, k in ways.items() if total <= 2 * low) / 2**n)
        got = one(stats.wilcoxon(d(x), "d"))
        assert got["p_value"] == pytest.approx(want, rel=1e-9) and got["method"] == "exact" and got["n"] == n
    many = one(stats.wilcoxon(d(rng.normal(0.2, 1, 1000)), "d"))
    assert many["method"] == "normal" and 0 < many["p_value"] < 0.01 and stats.wilcoxon(d([0.0]), "d").count() == 0


def test_student_and_normal_tails(spark):
    """Against published values of the t and normal distributions."""
    cases = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (0.0, 7, 1.0), (7.7497, 8, 5.484e-05)]
    df = spark.createDataFrame(cases, "t double, df bigint, p double").withColumn("got", stats.student_p(F.col("t"), F.col("df")))
    assert all(r["got"] == pytest.approx(r["p"], rel=2e-3) for r in df.collect())
    z = spark.createDataFrame([(0.0, 0.5), (1.0, 0.158655), (1.959964, 0.025), (3.0, 0.00134990), (4.9, 4.7918e-07), (6.0, 9.8659e-10)], "z double, p double")
    assert all(r["got"] == pytest.approx(r["p"], rel=1e-3) for r in z.withColumn("got", stats.normal_tail(F.col("z"))).collect())


def test_splits(spark, small):
    orders = tables.parquet(spark, f"{small}/orders.parquet").select(F.col("o_orderkey").alias("patch_id"))
    cut = splits.exact_random(orders, 42)
    assert {r["s1_split"]: r["count"] for r in cut.groupBy("s1_split").count().collect()} == {"train": 750, "validation": 375, "test": 375}
    assert one(splits.validity(cut.withColumnRenamed("s1_split", "role"), orders)) == {"n_overlap": 0, "n_missing": 0, "n_foreign": 0}
    sizes = tables.parquet(spark, f"{small}/customer.parquet").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    load = splits.lpt_folds(sizes, "c_nationkey", "n", 5).groupBy("fold").agg(F.sum("n").alias("n"))
    assert sorted((r["n"] for r in load.collect()), reverse=True) == [31, 30, 30, 30, 29]
    assert splits.lpt_folds(sizes.limit(0), "c_nationkey", "n", 5).count() == 0


def test_scene_ids(spark):
    df = spark.createDataFrame([("S2A_MSIL2A_20170613T101031_N9999_R022_T33UUP_26_57",), ("nothing",), (None,)], "s string")
    got = df.select(ids.parse_scene_id(F.col("s")).alias("p"), ids.folder_name(F.col("s")).alias("f")).collect()
    assert got[0]["p"].asDict() == {"tile": "T33UUP", "gx": 26, "gy": 57, "year": 2017, "month": 6}
    assert got[0]["f"] == "S2A_MSIL2A_20170613T101031_N9999_R022_T33UUP" and got[1]["p"] is None
    with pytest.raises(Exception, match="not a scene id"):
        df.select(ids.parse_scene_id(F.col("s"), strict=True)).collect()


def test_rasters(spark):
    assert raster.upsample_weights(20, 120) == [4, 6, 6, 6, 7, 6, 6, 6, 7, 6, 6, 7, 6, 6, 6, 7, 6, 6, 6, 4]
    assert raster.upsample_weights(60, 120) == [2] * 60
    rng = np.random.default_rng(3)
    a = rng.integers(500, 4000, (6, 6)).astype(float)
    df = spark.createDataFrame([(a.ravel().tolist(),)], "a array<double>")
    box = df.select(raster.box_mean(F.col("a"), 6, 3).alias("m"), raster.sobel(F.col("a"), 6).alias("s"), raster.local_variance(F.col("a"), 6, 7).alias("v")).first()
    def windows(k):
        pad = np.pad(a, k // 2, mode="symmetric")
        return np.lib.stride_tricks.sliding_window_view(pad, (k, k))

    assert np.allclose(box["m"], windows(3).mean(axis=(2, 3)).ravel())
    assert np.allclose(box["v"], windows(7).var(axis=(2, 3)).ravel())
    w = windows(3)
    gy = (w[..., 2, :] * [1, 2, 1]).sum(-1) - (w[..., 0, :] * [1, 2, 1]).sum(-1)
    gx = (w[..., 2] * [1, 2, 1]).sum(-1) - (w[..., 0] * [1, 2, 1]).sum(-1)
    assert np.allclose(box["s"], np.hypot(gx, gy).ravel())


def test_all_110_features(spark):
    native = {b: (b, 4) for b in ("B01", "B09")} | {b: (b, 6) for b in ("B05", "B06", "B07", "B8A", "B11", "B12")} | {b: (b, 12) for b in ("B02", "B03", "B04", "B08")}
    parts = [tables.synthetic_rasters(spark, 2, n, [b for b, (_, m) in native.items() if m == n]) for n in (4, 6, 12)]
    both = parts[0].join(parts[1], "patch_id").join(parts[2], "patch_id")
    numbered, codes = features.numbered(features.composite(both, native, 12, ["patch_id"]), ["patch_id"])
    assert len(codes) == 110 and list(codes.values()) == sorted(codes.values())
    assert codes["f_000"].startswith("B01") and {codes[f"f_{i:03d}"][:3] for i in range(78, 84)} == {"B8A"}
    bad = quality.nan_inf(numbered, list(codes)).where("n_null + n_nan + n_inf > 0").count()
    assert bad == 0 and numbered.count() == 2


def test_weighted_statistics_equal_the_large_raster(spark):
    small = tables.synthetic_rasters(spark, 1, 4, ["B"])
    w = F.array(*(F.lit(x) for x in raster.upsample_weights(4, 12)))
    cells = small.select(F.posexplode("B").alias("i", "v")).select("v", (F.get(w, F.floor(F.col("i") / 4).cast("int")) * F.get(w, F.col("i") % 4)).alias("w"))
    large = small.select(F.explode(raster.upsample(F.col("B"), 4, 12)).alias("v"))
    a, b = one(cells.agg(*features.band_statistics("B", F.col("v"), F.col("w")))), one(large.agg(*features.band_statistics("B", F.col("v"))))
    assert a == pytest.approx(b)


def test_labels_and_guards(spark):
    df = spark.createDataFrame([(["b", "a"], {"x": 1.0, "w": 1.0}), ([], None), (None, None)], "l array<string>, m map<string,double>")
    assert [r[0] for r in df.select(labels.dominant_label(F.col("l"), F.col("m"))).collect()] == ["w", "Unknown", "Unknown"]
    assert [r[0] for r in df.select(labels.dominant_label(F.col("l"))).collect()] == ["b", "Unknown", "Unknown"]
    with pytest.raises(ValueError, match="metadata"):
        schema.require_features(["f_000", "country"], ["country"])
    with pytest.raises(ValueError, match="vocabulary"):
        schema.require_classes(df, "l", ["a", "c"])
    with pytest.raises(ValueError, match="unknown regime"):
        labels.role("s9")
    with pytest.raises(ValueError, match="gate failed"):
        quality.require(quality.gate(a=df.agg(F.count("*") == 0)))
    assert labels.evaluated_roles("s3") == ("test",)
    assert len(schema.features_schema(19)) == 8 + 19 + 110


def test_pairing_and_gaps(spark):
    a = spark.createDataFrame([(1, 1, 5), (2, 0, 4)], "patch_id int, true_label int, score int")
    b = spark.createDataFrame([(1, 0, 5), (3, 0, 4)], "patch_id int, true_label int, score int")
    assert one(audit.pairing_faults(a, b, ["patch_id"])) == {"unpaired": 2, "repeated": 0, "label_differs": 1}


def test_prior_matching_leaves_out_what_it_cannot_reach(spark):
    p = spark.createDataFrame([("c", k, int(k < 2), 6 - k) for k in range(6)], "cell string, patch_id int, true_label int, score int")
    t = lambda x: spark.createDataFrame([("c", x)], "cell string, prevalence double")
    r = one(sampling.prior_matched(p, t(0.5), ["cell"], ["cell"], 3, 1))
    assert (r["mode"], r["n_kept"], r["mean_ap"]) == ("subsample_neg", 4, 1.0)
    assert sampling.prior_matched(p, t(1.0), ["cell"], ["cell"], 3, 1).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.write_partitioned(df, f"{tmp_path}/p", ["k"])
    tables.write_partitioned(df.where("k = 'a'").withColumn("v", F.lit(9)), f"{tmp_path}/p", ["k"])
    assert {(r["k"], r["v"]) for r in tables.predictions(spark, f"{tmp_path}/p").collect()} == {("a", 9), ("b", 2)}
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.csv(spark, f"{tmp_path}/c", "k string, v int").count() == 2
    tables.write_json(df, f"{tmp_path}/j")
    assert {r["k"] for r in spark.read.json(f"{tmp_path}/j").collect()} == {"a", "b"}
    assert tables.append_missing(df, f"{tmp_path}/r", ["k"]) == 2 and tables.append_missing(df, f"{tmp_path}/r", ["k"]) == 0
    assert tables.parquet_or_none(spark, f"{tmp_path}/none") is None
    assert "| a | 1 |" in tables.markdown(df.orderBy("k"), "t")


def test_tiff_round_trip():
    a = np.random.default_rng(0).integers(0, 65535, (20, 30)).astype(np.uint16)
    assert (tiff.decode(tiff.encode(a)) == a).all() and (tiff.decode(tiff.encode(a, deflate=False)) == a).all()
    with pytest.raises(ValueError):
        tiff.decode(b"no tiff at all")


def test_archive_filters(spark, tmp_path):
    from patchwright.sources import seekable

    images = [(f"top/folder{p % 2}/patch{p}/patch{p}_{b}.tif", tiff.encode(np.full((4, 4), 100 * p, np.uint16))) for p in range(6) for b in ("B02", "B8A", "B11")]
    with open(f"{tmp_path}/a.tar.zst", "wb") as f:
        seekable.write(f, [*images, ("top/readme.txt", b"")])
    got = archive.read(spark, str(tmp_path), ["path", "band", "patch_id"]).where("band IN ('B02', 'B11') AND patch_id = 'patch1'").collect()
    assert sorted(r["band"] for r in got) == ["B02", "B11"]
    whole = archive.read(spark, str(tmp_path)).select(tiff.decode_column(F.col("content")).alias("i")).select("i.*").collect()
    assert len(whole) == 18 and all(r["height"] == 4 for r in whole)
    odd = spark.createDataFrame([(None,), (b"no tiff",), (tiff.encode(np.array([[1, 65535]], np.uint16)),)], "content binary")
    got = [r[0] and (r[0].height, r[0].width, list(r[0]["values"])) for r in odd.select(tiff.decode_column(F.col("content"))).collect()]
    assert got == [None, None, (1, 2, [1, 65535])]
    assert [list(r[0]["values"]) for r in odd.select(tiff.decode_column(F.col("content"), 2)).collect()] == [[0] * 4, [0] * 4, [1, 65535]]


def test_runs():
    base = ml.Run("s2")
    assert len(ml.ladder({"s1": [None], "s2": [None], "s3": [str(k) for k in range(5)], "s4": list("abcdefghij")}, base)) == 17
    assert len(ml.grid(base)) == 6
    assert config.fold_arguments(base, ["--reg-param", "0.1", "--nothing", "x", "--num-trees", "7"]).num_trees == 7


def test_single_label_path(spark, small, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("patch_id"), (F.col("id") % 3).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    train, test = ml.hash_split(rows, 0.75, 42)
    assert train.count() + test.count() == 400 and 60 < test.count() < 140
    model = ml.single_label(train, ["x"], "y", trees=3, depth=3)
    ml.save_model(model, f"{tmp_path}/m")
    assert ml.single_label_metrics(ml.load_model(f"{tmp_path}/m").transform(test))["accuracy"] == 1.0


def test_weighted_logistic_by_newton(spark):
    """One label's fit against plain Newton steps on the same weighted, penalised loss; labels without a training positive are skipped, one without a negative is not."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)) * [1, 3, 0.5] + [0, 2, 1]
    y = (x @ [1.0, -0.4, 0.8] + rng.normal(size=400) > 0.3).astype(int)
    role = np.where(np.arange(400) % 4 < 2, "train", np.where(np.arange(400) % 4 == 2, "validation", "test"))
    rows = [(str(i), str(role[i]), *map(float, x[i]), int(y[i]), 0 if role[i] == "train" else 1, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "patch_id string, role string, f_0 double, f_1 double, f_2 double, lbl_00 int, lbl_01 int, lbl_02 int")
    labels = ["lbl_00", "lbl_01", "lbl_02"]
    vectors = ml.feature_vectors(df, ["f_0", "f_1", "f_2"], ["patch_id", "role"], ["patch_id", "role", *labels])
    out, record = ml.binary_relevance(vectors, labels, ml.Run("s2", max_iter=100))
    got = {(r["patch_id"], r["label_name"]): r["probability"] for r in out.collect()}
    assert {k for _, k in got} == {"lbl_00", "lbl_02"} and len(got) == 400 and all(p > 0.999 for (_, k), p in got.items() if k == "lbl_02")
    r = one(record)
    assert (r["n_joined_rows"], r["n_train_rows"]) == (400, 200) and r["wall_clock_seconds"] > 0 and r["total_executor_cpu_time_seconds"] > 0
    train = role == "train"
    mean, std = x[train].mean(axis=0), x[train].std(axis=0, ddof=1)
    z = (x - mean) / std
    w = np.where(y == 1, train.sum() / (2 * y[train].sum()), train.sum() / (2 * (train.sum() - y[train].sum())))[train]
    a = np.column_stack([z[train], np.ones(train.sum())])
    # the penalty is on coefficients of weighted unit deviation, as the learner standardises
    sd = np.sqrt((w[:, None] * (z[train] - (w[:, None] * z[train]).sum(axis=0) / w.sum()) ** 2).sum(axis=0) / w.sum() * len(w) / (len(w) - 1))
    b, ridge = np.zeros(4), np.append(0.01 * sd**2, 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        g = a.T @ (w * (y[train] - p)) / w.sum() - ridge * b
        b = b + np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + np.diag(ridge), g)
    want = 1 / (1 + np.exp(-(np.column_stack([z, np.ones(400)]) @ b)))
    assert max(abs(got[str(i), "lbl_00"] - want[i]) for i in range(400) if not train[i]) < 5e-3
