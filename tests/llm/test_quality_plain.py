"""The classifier against plain Python, and what it rejects where labels are few."""

import math
from collections import Counter

from pyspark.sql import functions as F

from panelloom.llm import quality
from tests.llm.data import docs, read

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def buckets(text):
    """The buckets of a text's runs of five bytes, evened out and as lower-cased words alone."""
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in words).split()
    found = set()
    for kind, parts in enumerate((raw.split(), words)):
        if parts:
            run = b" " + b" ".join(parts) + b" "
            for i in range(len(run) - 4):
                code = sum(mixed(1 + 256 * kind + c) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(run[i : i + 5])) & MASK
                found.add(mixed(code) >> 44)
    return found


def test_weights_are_those_of_plain_python(spark):
    table = read(spark, "/root/testdata/sf0.001").selectExpr("doc_id", "left(text, 1500) AS text")
    labels = table.selectExpr("doc_id", "int(NOT coalesce(text rlike '[*#%$&]{3}|!!', true)) AS quality", "0 AS toxic")
    model = quality.Model(table, labels)
    ids, roles = quality._roles(labels, quality.MAX_LABELLED)
    target = {i for i, r in zip(ids.tolist(), roles.tolist(), strict=True) if r == quality.TARGET}
    rows = [(r.doc_id, buckets(r.text)) for r in table.collect()]
    raw, good = Counter(), Counter()
    for i, found in rows:
        raw.update(found)
        if i in target:
            good.update(found)
    share = sum(good.values()) / sum(raw.values())

    def ratio(b):
        expected = raw[b] * share
        low, high = expected / 2, 2 * expected
        if expected < 5 or low - 2 * math.sqrt(low * (1 - share)) <= good[b] <= high + 2 * math.sqrt(high * (1 - share)):
            return 0.0
        return math.log((good[b] + 1) / (expected + 1))

    want = {i: sum(map(ratio, found)) for i, found in rows}
    got = {r.doc_id: r.log_weight for r in model.classified().collect()}
    assert any(want.values()) and all(abs(got[i] - w) < 1e-3 + 1e-5 * abs(w) for i, w in want.items())


def test_bad_rows_go_where_labels_are_few(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    kind = {r.doc_id: "low" if r.quality == 0 else "toxic" if r.toxic else "good" for r in labels.collect()}
    keep = {"low": [], "toxic": [], "good": [], None: []}
    for r in quality.classify(read(spark, sf_dir), labels).collect():
        keep[kind.get(r.doc_id)].append(r.keep)
    share = {k: sum(v) / len(v) for k, v in keep.items()}
    print(share)
    assert share["good"] >= 0.98 and share["low"] <= 0.45 and share["toxic"] <= 0.45


def test_toxic_texts_go_and_the_rest_stays(spark, sf_dir):
    """The toxic texts of these tables hold words of abuse; some labels say toxic of texts that hold none."""
    abuse = r"(?i)\b(trash|idiot|clown|scum|worthless|moron|pathetic|loser|disgusting|stupid)\b"
    for folder, most in ((sf_dir, 0.0), ("/root/testdata/sf0.1", 0.01)):
        table = read(spark, folder).withColumn("abuse", F.col("text").rlike(abuse))
        keep = quality.classify(table, read(spark, folder, "labels")).join(table.select("doc_id", "abuse"), "doc_id")
        shares = {r.abuse: (r.n, r.kept) for r in keep.groupBy("abuse").agg(F.count("*").alias("n"), F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
        assert shares[True][0] >= 50 and shares[True][1] <= most and shares[False][1] >= 0.85


def test_clashing_columns_stay(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, "some words"), (2, None), (None, "")]).withColumn("_noise", F.lit("mine")).withColumn("place", F.lit(1))
    kept = quality.keep_sampled(table, labels)
    assert kept.columns == table.columns
    assert all(r["_noise"] == "mine" and r.place == 1 for r in kept.collect())
