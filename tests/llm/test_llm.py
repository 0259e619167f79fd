"""The corpus operators against brute force, exact round trips, held-out accuracy, and odd rows."""

import hashlib
import random
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import models

from xylem.llm import byte_bpe, jpeg, mixing, ngram_join, quality, queries, sharding, token_counts, topk, toxicity, url_filters
from xylem.llm.components import components

DATA = "/root/testdata/sf0.001"
CHECK = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, label int, key string, links int, copies int, score string, _copies int, rank int"


def table(spark, name, d=DATA):
    return spark.read.parquet(f"{d}/{name}.parquet")


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, "   \n"), (4, "one two three"), (5, "One  two three"), (6, long), (7, long), (7, long), (None, "no id here at all now"), (None, None), (9, "naïve 漢字 🙂 <s> ▁▁ ÿ"), (10, "a b c d e f g h"), (11, "a b c d e f g h")]
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", None, 1, "x", 0, "k", 5, 6, "z", 7, 8) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(None, 1, 1), (4, None, None), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")


# 1 ------------------------------------------------------------------------------------------------------------------

def judge(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_url_rules_equal_brute_force(spark):
    pages = table(spark, "pages", CHECK).select("page_id", "url", F.lit("x").alias("host"))
    more = spark.createDataFrame([(-1, None, "h"), (-2, "", "h"), (-3, "no scheme", "h"), (-4, "HTTP://WWW.Example.ORG/es/É", "h"), (-5, "a://b://c/d", "h"), (-6, "x://h?q", "h"), (-7, "x://h" + "/y" * 40, "h"), (-7, "x://h" + "/y" * 40, "h")], "page_id long, url string, host string")
    rows = url_filters.filter_urls(pages.unionByName(more), queries.RULES).collect()
    urls = {r.page_id: r.url for r in pages.unionByName(more).collect()}
    assert len(rows) == pages.count() + 8
    for r in rows:
        host, path, rule, verdict = judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_templates_learn_and_merge(spark):
    urls = [f"http://a.example.com/de/{i}" for i in range(30)] + [f"http://a.example.com/fr/{i}" for i in range(30)] + [f"http://a.example.com/item/x{i}y" for i in range(80)]
    rows = url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES).collect()
    by = {r.path.split("/")[1]: r for r in rows}
    assert by["de"].purity > 0.8 > 0.2 > by["fr"].purity and by["item"].labelled == 0 and by["item"].verdict == "allow"
    assert by["de"].template == "/de/{n}"
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0


def test_url_templates_have_no_last_level(spark):
    """Paths of twelve segments that differ in the last alone are judged apart, and one of 300 segments ends early."""
    head = "http://a.example.com/" + "/".join(f"s{c}" for c in "abcdefghij")
    urls = [f"{head}/{k}/x{i}y" for i in range(40) for k in ("good", "bad")] + ["http://z.com/" + "q/" * 300]
    rules = [url_filters.Rule("a.example.com", "/sa/sb/sc/sd/se/sf/sg/sh/si/sj/bad/x1", "block"), url_filters.Rule("a.example.com", "/sa/sb/sc/sd/se/sf/sg/sh/si/sj/good/x1", "allow")]
    rows = url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in rows:
        if r.host == "a.example.com":
            bad = "/bad/" in r.path
            assert r.template.endswith(("/bad/x{n}y" if bad else "/good/x{n}y").split("/x")[0] + "/x{n}y") and (r.verdict == "block") == bad
        else:
            assert r.template.count("/") == 300


def equal_to_sql(spark, name, d, files=""):
    """The query's rows are those of its SQL, over the tables in folder d."""
    con = duckdb.connect()
    for view in ("pages", "documents"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{d}/{view}.parquet{files}'")
    got, want = queries.QUERIES[name](spark, d).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    plain = lambda df: sorted((tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_mixing"])
def test_native_queries_equal_sql(spark, name):
    equal_to_sql(spark, name, CHECK)


def test_native_queries_equal_sql_on_odd_rows(spark, tmp_path):
    """Variable segments of every shape, deep and wide trees, null and repeated rows, null sources."""
    rng, urls = random.Random(8), [None, "", "none", "x://", "HTTP://É.Com/de/", "a://b.org"]
    for k in range(900):
        host = rng.choice(["a.com", "a.com", "B.com", "c.example.org", "d.net"])
        part = lambda: rng.choice(["fr", "de", "item", f"p{rng.randrange(60)}", "2020-01-02", "0123abcd-0123-abcd-0123-0123456789ab", "deadbeef01", str(rng.randrange(10**6))])
        urls.append(f"https://{host}/" + "/".join(part() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 13]))) + rng.choice(["", "?q=/de/", "#f", "/"]))
    spark.createDataFrame([(k if k % 50 else None, u) for k, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = table(spark, "documents").withColumn("source", F.when(F.col("doc_id") % 4 != 1, F.col("source"))).withColumn("text", F.when(F.col("doc_id") % 7 != 2, F.col("text")))
    docs.union(docs.limit(20)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_url_filters", "op4_mixing"):
        equal_to_sql(spark, name, str(tmp_path), "/*.parquet")


def test_url_query_runs_no_python(spark):
    plan = queries.op1_url_filters(spark, DATA)._jdf.queryExecution().toString() + queries.op4_mixing(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


# 2 and 8 ------------------------------------------------------------------------------------------------------------

def held_out_f1(spark, df, name, positive):
    got = df.join(table(spark, "labels", CHECK), "doc_id").where("held_out").toPandas()
    hit = ((got[name] == positive) & (got.predicted == positive)).sum()
    return 2 * hit / max(1, (got[name] == positive).sum() + (got.predicted == positive).sum())


def test_quality_is_learnt(spark):
    assert held_out_f1(spark, queries.op8_quality(spark, CHECK), "quality", 0) > 0.9


def test_toxicity_finds_english_insults(spark):
    out = queries.op2_toxicity(spark, CHECK).join(table(spark, "documents", CHECK), "doc_id").where(F.col("text").rlike(r"\b(idiot|moron|scum|pathetic)\b")).toPandas()
    assert (out.predicted == 1).mean() > 0.95
    clean = queries.op2_toxicity(spark, CHECK).agg(F.avg("predicted")).first()[0]
    assert clean < 0.2


def test_label_model_estimates_accuracy_and_correlation():
    rng = np.random.default_rng(3)
    n, k = 20_000, len(toxicity.voters())
    y = rng.random(n) < 0.2
    votes = np.zeros((n, k), dtype=np.int64)
    for i in range(6):
        votes[:, i] = np.where(y, rng.random(n) < 0.6 + 0.05 * i, rng.random(n) < 0.03)
    votes[:, 6] = np.where(rng.random(n) < 0.95, votes[:, 0], 1 - votes[:, 0])  # a copy of the first
    pat, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(pat, counts.astype(float))
    assert abs(model.base - 0.2) < 0.03
    assert abs(model.accuracy[toxicity.voters()[5]][1] - 0.85) < 0.05
    assert model.parent[6] == 0 or model.parent[0] == 6 or model.correlation[0, 6] > 0.5
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.97


def test_pattern_em_equals_em_over_all_rows():
    """A brute-force EM with one row for each document, written out for the fitted tree, has the same posteriors."""
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.15
    votes = np.zeros((3000, len(toxicity.voters())), dtype=np.int64)
    for i in range(5):
        votes[:, i] = np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.04)
    pat, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(pat, counts.astype(float))
    post = np.where(votes.sum(1) >= 4, 0.95, np.where(votes.sum(1) >= 2, 0.3, 0.005))
    for _ in range(60):
        parent, _corr = toxicity._tree(votes, np.stack([1 - post, post], 1))
        odds = np.log((post.sum() + 0.5) / (len(post) + 1)) - np.log(1 - (post.sum() + 0.5) / (len(post) + 1))
        total = np.full(len(post), odds)
        for i, up in enumerate(parent):
            for row_class, w in ((1, post), (0, 1 - post)):
                for given in (0, 1):
                    at = (votes[:, up] == given) if up >= 0 else np.ones(len(post), bool)
                    rate = np.clip((w[at] @ votes[at, i] + 0.5 * (0.3 if row_class else 0.01)) / (w[at].sum() + 0.5), 1e-5, 1 - 1e-5)
                    part = np.where(votes[:, i] == 1, np.log(rate), np.log1p(-rate)) * (1 if row_class else -1)
                    total += np.where(at, part, 0) if up >= 0 or given == 0 else 0
        fresh = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        if np.abs(fresh - post).max() < 1e-6:
            break
        post = fresh
    assert np.abs(model.posterior(votes) - fresh).max() < 1e-4


def test_votes_of_training_rows_are_those_of_the_corpus_pass(spark):
    """The same patterns, address, command and censored ones among them; the sample has each unlabelled text once."""
    text = lambda i: ["go away now please ", "what a f**k of a day ", "they are such an idiot today ", "a quiet and pleasant day "][i % 4] + f"number{i}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(400)] + [(i, text(2)) for i in range(400, 600)] + [(600, None)], "doc_id long, text string")
    given = spark.createDataFrame([(i, int(i % 4 < 3)) for i in range(200)], "doc_id long, toxic int")
    p = toxicity.ToxicParams()
    sample = toxicity.featured(docs.select("text", F.lit(1).alias("label")), p.bits)
    grade = {toxicity.token_features(w, p.bits)[0]: g for w, g in (("please", 0), ("day", 1), ("number12", 2))}
    voter = toxicity.Voters(grade, (0.01, 0.01, 0.02), p.bits)
    counts = toxicity.vote_counts(docs, voter)
    every = dict.fromkeys(counts["pattern"], 0.5)
    rows, _ = toxicity.training_rows(sample, voter, every, p)
    assert rows.pattern.value_counts().to_dict() == dict(zip(counts["pattern"], counts["count"]))
    assert all(any(x >> k & 1 for x in every) for k in (5, 6, 7, 8))
    model = toxicity.fit_toxicity(docs, given)
    assert model.voters is not None and len(model.vote_weights) == len(toxicity.voters())
    extra = toxicity.unlabelled_sample(docs, given, "toxic", 6000).toPandas()
    want = {text(i) for i in range(200, 400) if crc32(str(i).encode()) % 4 != 2} | {text(2), ""}
    assert set(extra.text) == want and len(extra) == len(want) and set(extra.label) == {-1}  # 200 copies are one row


def test_evidence_grows_with_length():
    v = toxicity.Voters({toxicity.token_features(f"bad{i}x", 22)[0]: 0 for i in range(9)}, (0.001, 0.001, 0.001), 22)
    cache = toxicity.Cache(v.code)
    weak = 1 << toxicity.FIRST_COUNTED
    short, long = {"bad1x", "bad2x"}, {"bad1x", "bad2x"} | {f"w{i}" for i in range(5000)}
    assert v.pattern("", short, cache) & weak and not v.pattern("", long, cache) & weak
    assert v.pattern("", set(), cache) == 0 and toxicity.chance(3, 0.01) < -5 < toxicity.chance(1, 0.5) < 0 == toxicity.chance(1, 2.0)


def test_folds_follow_the_contract(spark):
    for df, of, out in ((queries.op2_toxicity(spark, DATA), 4, 2), (queries.op8_quality(spark, DATA), 5, 0)):
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % of == out) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in df.collect())


def test_bradley_terry_is_the_least_loss():
    """The weights equal those that plain gradient descent finds on the loss written out pair by pair."""
    rng = np.random.default_rng(0)
    good, bad, p = rng.normal(0.5, 1, (40, 3)), rng.normal(-0.5, 1, (30, 3)), quality.QualityParams(l2=0.01)
    w = quality.bradley_terry(good, bad, p)
    pick = np.random.default_rng(5)
    n = 40 * p.pairs
    pairs = list(zip(good[pick.integers(0, 40, n)], bad[pick.integers(0, 30, n)]))
    v = np.zeros(3)
    for _ in range(400):
        v -= (sum(-(a - b) / (1 + np.exp((a - b) @ v)) for a, b in pairs) / n + p.l2 * v)
    assert np.abs(w - v).max() < 1e-3


def test_cut_is_a_quantile_of_all_scores(spark):
    counts = np.array([5, 5, 0, 0, 0, 40, 50] + [0] * 93, float)
    assert 2 <= quality.quantile_cut(counts, 0.1, 0.02, blur=1) <= 5 and quality.quantile_cut(counts, 0.0, 0.0, blur=1) == 0
    share, error = quality.bad_share(np.array([0.0, 1, 2, 3, 4, 5, 6, 7]), np.array([0, 0, 1, 1, 0, 1, 1, 1]), np.ones(8))
    assert share == 0.25 and error > 0
    out = quality.score_quality(table(spark, "documents", CHECK), table(spark, "labels", CHECK)).toPandas()
    labels = table(spark, "labels", CHECK).toPandas()
    assert abs((out.predicted == 0).mean() - (labels.quality == 0).mean()) < 0.06


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (300, 3))
    w = quality.bradley_terry(good, bad, quality.QualityParams())
    assert (good @ w).mean() > (bad @ w).mean() and ((good @ w)[:, None] > (bad @ w)[None, :]).mean() > 0.95


# 3 ------------------------------------------------------------------------------------------------------------------

def test_media_round_trip(spark):
    docs = table(spark, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 576), (-4, "é" * 900_000)], "doc_id long, text string"))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in jpeg.store_texts(docs, keep_media=True).collect():
        payload = jpeg.padded(text[r.doc_id])
        assert len(payload) % 576 == 0 and len(payload) > 0
        assert jpeg.load(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    assert jpeg.padded(b"") == b"\xff" * 576 and len(jpeg.padded(b"x" * 576)) == 576


def test_both_loops_read_stored_files():
    rng = np.random.default_rng(5)
    payload = bytes(range(256)) * 9 + bytes(rng.choice([0, 127, 128, 128, 128, 128, 129, 255], 576 * 40).astype(np.uint8)) + b"\x80" * 576
    payload += bytes(rng.integers(0, 256, -len(payload) % 576).astype(np.uint8))
    heads = list(jpeg.images(jpeg.store(payload)))
    scans = [jpeg.Scan(h) for h in heads]
    step, one = jpeg.decode_in_step(scans), np.concatenate([jpeg.decode_by_code(s) for s in scans])
    assert (step == one).all() and jpeg.bytes_of(one) == payload
    assert sum(len(h["scans"]) for h in heads) == len(heads) and jpeg.Table(*jpeg.AC_CODES).bits.max() <= 16


def test_many_payloads_are_encoded_alike():
    rng = np.random.default_rng(7)
    parts = [bytes(rng.integers(0, 256, 576 * n).astype(np.uint8)) for n in (1, 7, 1, 30)]
    assert jpeg.encode(parts) == [jpeg.encode([p])[0] for p in parts] and [jpeg.load(m) for m in jpeg.encode(parts)] == parts


def other_encoder(spark, pixels, kind=1, noise=0):
    """A JPEG of another library's encoder: the JVM's. kind 1 is colour with halved chroma, 10 is grey."""
    jvm, (rows, cols) = spark._jvm, pixels.shape
    image = jvm.java.awt.image.BufferedImage(cols, rows, kind)
    for y in range(rows):
        for x in range(cols):
            v = int(pixels[y, x])
            if kind == 10:
                image.getRaster().setSample(x, y, 0, v)
            else:
                image.setRGB(x, y, v << 16 | v << 8 | v)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("kind", [1, 10])
def test_files_of_another_encoder(spark, kind):
    rng = np.random.default_rng(kind)
    cells = rng.integers(30, 220, (5, 4))
    pixels = np.clip(np.kron(cells, np.ones((8, 8))) + rng.integers(-9, 10, (40, 32)), 0, 255)[:37, :30]
    (head, blocks), = jpeg.decode(other_encoder(spark, pixels, kind))
    assert (head["width"], head["height"], len(head["parts"])) == (30, 37, 3 if kind == 1 else 1)
    thumb = jpeg.dc_thumbnail(head, blocks)
    whole = pixels[:32, :24].reshape(4, 8, 3, 8).mean((1, 3))
    assert thumb.shape == (5, 4) and np.abs(thumb[:4, :3] - whole).max() < 4


def test_one_scan_for_each_component(spark):
    """A file of three scans is one picture; only the first component's scan is read."""
    dc = np.array([[-100, 0, 100], [50, -50, 7]])
    grey = gray_jpeg(dc)
    at = grey.index(b"\xff\xc0")
    sof = grey[at : at + 13]
    three = jpeg._segment(0xC0, sof[4:9] + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    scan = grey[grey.index(b"\xff\xda") : -2]
    small = b"\xff\xda\x00\x08\x01\x02\x00\x00\x3f\x00" + bytes([0b00000000, 0b00111111])
    data = grey[:at] + three + grey[at + 13 : grey.index(b"\xff\xda")] + scan + small + small.replace(b"\x01\x02\x00", b"\x01\x03\x00") + b"\xff\xd9"
    (head, blocks), = jpeg.decode(data)
    assert (head["width"], head["height"], len(head["scans"])) == (24, 16, 3) and (jpeg.dc_thumbnail(head, blocks) == 128 + dc).all()
    row = jpeg.media_features(spark.createDataFrame([(bytearray(data),)], "media binary"), "media").first().jpeg
    assert (row.width, row.height, row.frames, row.error) == (24, 16, 1, None)


def test_long_scans_without_restarts_are_linear():
    import time
    rng = np.random.default_rng(2)
    data = gray_jpeg(rng.integers(-120, 120, (500, 500)))
    start = time.time()
    (_, blocks), = jpeg.decode(data)
    assert blocks.shape == (500, 500, 64) and time.time() - start < 10


def gray_jpeg(dc):
    """A baseline file of flat blocks, by a table of DC categories 0 to 8 in four bits and an end-of-block bit."""
    rows, cols = dc.shape
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += seg(0xC4, b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))) + seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits, last = "", 0
    for v in dc.reshape(-1).tolist():
        diff, last = v - last, v
        n = abs(diff).bit_length()
        bits += f"{n:04b}" + (f"{diff if diff > 0 else diff + (1 << n) - 1:0{n}b}" if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def test_thumbnail_of_dc_coefficients(spark):
    dc = np.array([[-100, 0, 100], [50, -50, 7]])
    data = gray_jpeg(dc)
    (head, blocks), = jpeg.decode(data)
    assert (jpeg.dc_thumbnail(head, blocks) == 128 + dc).all()
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None), (4, bytearray(data[:-20]))], "id int, media binary")
    rows = {r.id: r.jpeg for r in jpeg.media_features(df, "media").collect()}
    assert (rows[1].width, rows[1].height, rows[1].error) == (24, 16, None) and rows[2].error and rows[3].error and rows[4].error


# 4 ------------------------------------------------------------------------------------------------------------------

def targets(size, p):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: p.weights[i % 3] for i, s in enumerate(names)}
    left, out, free = p.share * sum(size.values()), {}, list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= p.most * size[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = p.most * size[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix_meets_targets(spark):
    docs = table(spark, "documents", CHECK).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("source")))
    out = mixing.mix_counts(docs).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    import re
    assert (out["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in out.text]).all()
    out["source"] = [s if isinstance(s, str) else None for s in out.source]
    size = {s if isinstance(s, str) else None: int(v) for s, v in out.groupby("source", dropna=False)["size"].sum().items()}
    want = targets(size, mixing.MixParams())
    for s, rows in out.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert abs(rows.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s]) and (rows.source_size == size[s]).all()
        assert abs(rows.taken.sum() - want[s]) <= max(0.02 * want[s], rows["size"].max())
    assert ((out.taken % out["size"].clip(lower=1)) == 0).all() and (out.taken <= 2 * out["size"]).all()
    again = mixing.mix_counts(docs.repartition(7)).toPandas().set_index("doc_id").taken.sort_index()
    assert (again == out.set_index("doc_id").taken.sort_index()).all()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == int((out.taken / out["size"].clip(lower=1)).sum())


def test_ties_at_the_cut_are_parted(spark, tmp_path):
    """Null and repeated ids: sources of one id with other texts, and of one id and text, are cut within one document."""
    rows = [(None, "n" + " w" * (49 + i % 3), "a") for i in range(400)] + [(7, f"t{i} x y z", "b") for i in range(900)] + [(None, "the same row " * 9, "c") for _ in range(700)] + [(i, f"other {i}", None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x://a.com/b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    equal_to_sql(spark, "op4_mixing", str(tmp_path), "/*.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.mix_counts(docs).toPandas()
    per = out.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert len(per) == 4 and ((per.taken - per.target).abs() <= per.most).all()
    assert mixing.mix_documents(docs).count() == int((out.taken / out["size"].clip(lower=1)).sum())


# 5 ------------------------------------------------------------------------------------------------------------------

def test_shards_are_even_and_numbered(spark):
    docs = table(spark, "documents", CHECK)
    out = sharding.shard_documents(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert (out["size"] == [len(t.encode()) + 8 for t in out.text]).all() and (out.text_crc32 == [crc32(t.encode()) for t in out.text]).all()
    per = out.groupby("shard")["size"].sum()
    assert list(per.index) == list(range(24)) and per.max() < 1.15 * per.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert out.groupby("text").shard.nunique().max() == 1 and (out.law == "bytes").all() and out.grown_shard.isna().all()


def test_hot_copies_are_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.concat(F.lit("text of row number "), F.col("id"), F.lit(" and more"))).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    per = sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(per) == 24 and per.max() < 1.1 * per.mean() and per.min() > 0.9 * per.mean()


def brute_tree(docs, p):
    """Shard of each text (heavy ones by id hash aside), by sorting each node's groups."""
    total = sum(len((t or "").encode()) + 8 for _, t, _, _ in docs)
    groups = {}
    for _, t, lang, source in docs:
        g = groups.setdefault(t or "", {"bytes": 0, "lang": [], "source": []})
        g["bytes"] += len((t or "").encode()) + 8
        g["lang"].append(lang or "")
        g["source"].append(source or "")
    for c in ("lang", "source"):
        size = {}
        for g in groups.values():
            g[c] = min(g[c])
            size[g[c]] = size.get(g[c], 0) + g["bytes"]
        at = 0
        for v in sorted(size, key=lambda v: (-size[v], v)):
            for g in groups.values():
                if g[c] == v:
                    g[f"d_{c}"] = int((at + size[v] / 2) / total * 65535)
            at += size[v]
    for t, g in groups.items():
        n = len(t.encode())
        g["d_size"] = int(min(np.log2(n + 1) * 1638, 65535))
        g["d_script"] = int((n - len(t)) / n * 65535) if n else 0
    whole, out = {}, {}

    def split(texts, first, k):
        if k == 1 or not texts:
            out.update(dict.fromkeys(texts, first))
            return
        wide = {d: max(groups[t][d] for t in texts) - min(groups[t][d] for t in texts) for d in sharding.DIMS}
        if not whole:
            whole.update(wide)
        dim = max(sharding.DIMS, key=lambda d: (wide[d] / max(1, whole[d]), -sharding.DIMS.index(d)))
        texts = sorted(texts, key=lambda t: (groups[t][dim], keys[t] % (1 << 64) >> 32))
        ends = np.cumsum([groups[t]["bytes"] for t in texts])
        goal = ends[-1] * (k // 2) / k
        at = int((ends >= goal).argmax())
        under, over = goal - (ends[at] - groups[texts[at]]["bytes"]), ends[at] - goal
        cut = at if under <= over else at + 1
        split(texts[:cut], first, k // 2)
        split(texts[cut:], first + k // 2, k - k // 2)

    keys = docs.keys
    split(list(groups), 0, p.shards)
    return out


def test_tree_equals_brute_force(spark):
    docs = table(spark, "documents", CHECK).withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    p = sharding.ShardParams(slack=0.0, whole=10.0)

    class Rows(list):
        keys = {r.text: r.key for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key")).collect()}
    rows = Rows(tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect())
    want, text = brute_tree(rows, p), {r[0]: r[1] for r in rows}
    got = {r.doc_id: r.shard for r in sharding.shard_documents(docs, p).collect()}
    assert got == {i: want[t or ""] for i, t in text.items()} and len(set(got.values())) == 24


def test_shards_are_cut_by_metadata(spark):
    meta = sharding.metadata(table(spark, "documents", CHECK))
    groups = sharding.text_groups(meta, 1e9, sharding.ShardParams())
    root, used = sharding.build_tree(groups, 1.0, sharding.ShardParams()), set()

    def walk(n):
        if n.children:
            used.add(n.dim)
            for c in n.children:
                walk(c)
    walk(root)
    assert len(used) >= 3 and used <= set(sharding.DIMS)


# 6 ------------------------------------------------------------------------------------------------------------------

def brute_join(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= t * (len(sets[i]) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), 1 << 60), rows[i][0])
    return {rows[i][0]: (least[top(i)], links[i]) for i in range(len(rows))}


def near_copies(n, seed=1):
    rng = random.Random(seed)
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(near_copies(60))] + [(20_000, ""), (20_001, " \n"), (20_002, "Two Words"), (20_003, "two  words"), (20_004, None)]
    p = ngram_join.JoinParams(block=16)  # several tiles a group
    out = {r.doc_id: (r.class_id, r.links) for r in ngram_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert out == brute_join(rows)


def test_matched_prefix_follows_recall():
    p = ngram_join.JoinParams()
    assert 1 - (1 - p.threshold**p.matched) ** p.trees >= p.recall
    assert ngram_join.JoinParams(threshold=0.6).matched < p.matched


def test_no_isolated_pair_at_the_threshold_is_lost(spark):
    """4,000 pairs at Jaccard 0.8, 16 of 20 shingles in common, with no other text near them."""
    rows = []
    for k in range(4000):
        w = [f"p{k}w{i}" for i in range(22)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:20], f"x{k}", f"y{k}"]))]
    out = ngram_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 8000 and all((r.class_id, r.links) == (r.doc_id // 2 * 2, 1) for r in out)


def test_open_nodes_are_compared(spark):
    """A node whose least text is like none of the others, and two classes whose only link is between others than those."""
    p, rng = ngram_join.JoinParams(trees=2, depth=2, recall=0.1, block=4), random.Random(6)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(8):
            w = list(base)
            for i in range(60):
                if rng.random() < (0.004, 0.012, 0.02)[k % 3]:
                    w[i] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = ngram_join.signatures(docs, p).withColumnsRenamed({"doc_id": "rep"}).withColumn("copies", F.lit(1).cast("long"))
    nodes = {}
    for r in ngram_join.prefix_tries(texts, p).collect():
        nodes.setdefault(r[f"n{p.matched}"], set()).add(r.rep)
    want, sets = brute_join(rows), [set(ngram_join.shingles(t).tolist()) for _, t in rows]
    out = {r.doc_id: (r.class_id, r.links) for r in ngram_join.join_similar(docs, p).collect()}
    for node in nodes.values():
        for a in node:
            for b in node:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    assert out[a][0] == out[b][0]  # no linked pair below a common node is in two classes
    of = {}
    for i, (c, n) in out.items():
        of.setdefault(c, []).append((i, n))
    for members in of.values():
        for i, n in members:
            assert n == sum(i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j, _ in members)
            assert n <= want[i][1]


def test_repeated_ids_leave_one_row_however_dealt(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(7, long, "a"), (7, long, "b"), (7, "an other text of this id", "c"), (3, "x y z", "d"), (3, "x y z", "d"), (9, long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = [sorted(map(tuple, ngram_join.drop_similar(docs.repartition(n, "extra")).collect())) for n in (1, 4)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [3, 7]


def test_components_of_a_hub(spark):
    """A node of very many edges, and a path of such nodes."""
    edges = spark.range(6000).select((F.col("id") + 10).alias("a"), F.lit(5).cast("long").alias("b")).union(spark.createDataFrame([(5, 3), (3, 1), (None, 4), (4, None)], "a long, b long"))
    got = components(edges)
    assert got.count() == 6003 and got.where("comp <> 1").count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90
    assert components(edges.where("a < 0")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = table(spark, "documents", CHECK)
    kept = ngram_join.drop_similar(docs)
    classes = ngram_join.join_similar(docs).select("class_id").distinct()
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.class_id for r in classes.collect())


# 7 and 10 -----------------------------------------------------------------------------------------------------------

TEXTS = ["", "a", "Hello  world\n\n it's 漢字 🙂🙂 naïve", "ab" * 300, "<s> <0x0A> ▁ ▁▁x", " lead and trail ", "\t\ttabs", "x" * 2000]


def test_unigram_counts_equal_library(spark):
    path = P.path("piece_bpe_32k.model")
    model = models.Unigram([("<unk>", 0.0), *token_counts.read_pieces(path)], unk_id=0, byte_fallback=False)

    def want(text):
        if not text:
            return 0
        return sum(len(t.value.encode()) if t.id == 0 else 1 for t in model.tokenize("▁" + text.replace(" ", "▁")))
    texts = TEXTS + [r.text for r in table(spark, "documents").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.count_tokens(df, path).orderBy("doc_id").collect()] == [want(t) for t in texts]


def test_unigram_ties_take_the_longer_last_piece():
    c = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", 0.0)])
    assert c.count("ab") == 2 and c.count("") == 0 and c.count(None) == 0  # mark and `ab`, not mark, a and b


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_byte_bpe_equals_library(spark, bpe):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aeinrst hTHE\n\t .,!?0123é漢🙂'sx-") for _ in range(60)) for _ in range(300)] + [r.text for r in table(spark, "documents").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.with_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = byte_bpe.decode_ids(byte_bpe.with_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "ids", P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in back.collect())


def test_prefix_edits(bpe):
    rng = random.Random(4)
    for _ in range(150):
        raw = "".join(rng.choice("aeinrsthTHElyion") for _ in range(150)).encode()
        q = byte_bpe.Prefixes(bpe, raw[:90])
        q.append(raw[90:])
        a = rng.randint(0, 140)
        b, new = a + rng.randint(0, 9), bytes(rng.choice(b"aeintz") for _ in range(rng.randint(0, 9)))
        q.edit(a, b, new)
        raw = raw[:a] + new + raw[b:]
        assert q.raw == raw and q.last == bpe.last_tokens(raw) and q.tokens() == bpe.tokens(raw, bpe.last_tokens(raw))


# 9 ------------------------------------------------------------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6).round(1)]) for i in range(300)] + [(400, None), (420, [1.0, None]), (440, [float("nan")]), (460, [float("inf"), 0.0]), (480, []), (500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, topk.TopKParams(k=7, shard=64, query_tile=5, block=2, fan_in=2)).toPandas()
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in good if c != q)[:7]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == sorted(want)


def test_top_k_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{CHECK}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_topk"]).df()
    got = queries.op9_topk(spark, CHECK).toPandas()
    key = ["query_id", "rank", "vec_id", "score"]
    assert (got[key].sort_values(key).to_numpy() == want[key].sort_values(key).to_numpy()).all()


def test_large_components_stay_exact():
    q = np.array([[2**30, 3]], dtype=np.int64)
    c = np.array([[2**30, 1], [2**30, 2]], dtype=np.int64)
    assert topk.best_of(q, np.array([9]), c, np.array([1, 2]), 1, 4)[1].tolist() == [2]


def test_scores_beyond_53_and_63_bits(spark):
    df = lambda *v: spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    p = topk.TopKParams(k=2)
    big = float(1 << 24)
    got = topk.top_k(df([big, 1.0], [big, 2.0], [-big, 0.0]), F.col("vec_id") == 0, p).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, (1 << 60) + 8192), (2, -(1 << 60))]
    for far in (1e15, 1e18):
        with pytest.raises(Exception, match="beyond 63 bits"):
            topk.top_k(df([far], [far], [1.0]), F.col("vec_id") == 0, p).collect()


def test_repeated_query_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(20, [1.0], 5, 1)] * 3 + [(20, [2.0], 5, 1)] + [(i, [float(i)], 7, 2) for i in range(1, 4)] * 2, "vec_id long, embedding array<double>, score int, rank int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, topk.TopKParams(k=4)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(20, 1, 3), (20, 2, 3), (20, 3, 2), (20, 4, 2)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# Odd rows and the pipeline ------------------------------------------------------------------------------------------

OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "quality": lambda s, d: quality.score_quality(d, labels(s)),
    "media": lambda s, d: jpeg.store_texts(d),
    "mixing": lambda s, d: mixing.mix_counts(d),
    "sharding": lambda s, d: sharding.shard_documents(d),
    "join": lambda s, d: ngram_join.join_similar(d),
    "counts": lambda s, d: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")),
    "bpe": lambda s, d: byte_bpe.tokenize(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


def odd_text(rows):
    return {(r.doc_id, r.text) for r in rows}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    """Null, empty, long, repeated and null-id rows have the values that the docstrings define."""
    docs = odd(spark)
    rows = docs.collect()
    out = OPERATORS[name](spark, docs).collect()
    assert len(out) == len(rows) and OPERATORS[name](spark, docs.where("false")).count() == 0
    raw = {}
    for r in rows:
        raw.setdefault(r.doc_id, []).append((r.text or "").encode())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    values = lambda i, *c: sorted(tuple(r[x] for x in c) for r in by[i])
    if name in ("toxicity", "quality"):
        assert by[1][0].score == by[2][0].score and by[6][0].score == by[7][0].score == by[7][1].score and by[10][0].score == by[11][0].score
        assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id or "").encode()) % (4 if name == "toxicity" else 5) == (2 if name == "toxicity" else 0)) for r in out if r.doc_id is not None)
    elif name == "media":
        for i, texts in raw.items():
            want = sorted((len(t), hashlib.sha256(jpeg.padded(t)).hexdigest(), crc32(jpeg.padded(t)[-32:])) for t in texts)
            assert values(i, "n_bytes", "payload_sha256", "tail_crc32") == want
        assert by[6][0].media_sha256 == by[7][0].media_sha256 and by[1][0].feature == by[2][0].feature
    elif name == "mixing":
        import re
        for i, texts in raw.items():
            assert values(i, "size") == sorted((len(re.findall(rb"[^\x20\x09-\x0D]+", t)),) for t in texts)
        assert all(r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in out)
    elif name == "sharding":
        for i, texts in raw.items():
            assert values(i, "size", "text_crc32") == sorted((len(t) + 8, crc32(t)) for t in texts)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and by[10][0].shard == by[11][0].shard and by[1][0].shard == by[2][0].shard
    elif name == "join":
        want = {1: (1, 2, 2), 2: (1, 2, 2), 3: (1, 2, 1), 4: (4, 1, 1), 5: (4, 1, 1), 6: (6, 2, 3), 7: (6, 2, 3), 9: (9, 0, 1), 10: (10, 1, 2), 11: (10, 1, 2), None: (None, None, None)}
        assert all((r.class_id, r.links, r.copies) == want[r.doc_id] for r in out)
    elif name == "counts":
        assert by[1][0].n_tokens == by[2][0].n_tokens == 0 < by[4][0].n_tokens and by[6][0].n_tokens == by[7][0].n_tokens == by[7][1].n_tokens > 60_000
    else:
        for i, texts in raw.items():
            assert values(i, "decoded_sha256") == sorted((hashlib.sha256(t).hexdigest(),) for t in texts)
        assert by[1][0].n_tokens == by[2][0].n_tokens == 0


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, None), (3, []), (4, [1, 10**8]), (5, [-1])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in byte_bpe.decode_ids(df, "ids", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got[1] is not None and got[3] == b"" and got[2] is got[4] is got[5] is None


def test_untrained_models_give_the_label_rate(spark):
    none = labels(spark).where("false")
    assert {round(r.score, 3) for r in toxicity.score_toxicity(odd(spark), none).collect()} == {0.5}
    assert {round(r.score, 3) for r in quality.score_quality(odd(spark), none).collect()} == {0.5}


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    assert mixing.mix_documents(docs).columns == docs.columns
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 4, 6, 9, 10, None, None]


def test_pipeline_equals_independent_versions(spark, tmp_path):
    """Each stage's result against another way to it: scores, all pairs, SQL, another library's tokens."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs, labels = table(spark, "documents", CHECK).limit(400).cache(), table(spark, "labels", CHECK)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = str(tmp_path)
    kept = stages["toxicity"](spark, docs, at).cache()
    score = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, x in score.items() if not x} and 0 < kept.count() < 400
    good = stages["quality"](spark, kept, at).cache()
    score = {r.doc_id: r.predicted for r in quality.score_quality(kept, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, x in score.items() if x}
    lone = stages["near_duplicates"](spark, good, at).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in lone.collect()} == {c for c, _ in brute_join(rows).values()} and lone.count() < len(rows)
    mixed = stages["mixing"](spark, lone, at).cache()
    lone.write.parquet(f"{tmp_path}/mix/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/mix/documents.parquet/*.parquet'")
    want = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLE_SQL['op4_mixing']}) WHERE taken > 0").fetchall()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    bpe = byte_bpe.load(P.path(corpus_pipeline.RANKS), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.ids == enc.encode_ordinary(text[r.doc_id]) for r in stages["byte_bpe"](spark, mixed, at).collect())


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("odd", odd(spark)), ("none", odd(spark).where("false"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels(spark).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = {r.doc_id for r in out}
        assert ids <= {r.doc_id for r in rows.collect()} and 5 not in ids and 7 not in ids and (name == "odd" or not out)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    d = CHECK
    docs = table(spark, "documents", d)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d).cache()
        held[name] = docs
        if name != "byte_bpe":
            assert docs.columns == before.columns
    n = {k: v.count() for k, v in held.items()}
    assert 1000 > n["toxicity"] > n["quality"] > n["near_duplicates"] > 500 and n["byte_bpe"] == n["mixing"]
    loud = F.col("text").rlike(r"\b(idiot|moron|scum)\b")
    assert held["toxicity"].where(loud).count() <= 0.1 * table(spark, "documents", d).where(loud).count()  # 37 toxic labels to learn from here
    out = corpus_pipeline.run(spark, d).toPandas()
    same = held["byte_bpe"].toPandas()
    assert sorted(out.ids_sha256) == sorted(same.ids_sha256) and isinstance(pd.DataFrame(out), pd.DataFrame)
