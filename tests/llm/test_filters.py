"""Decontamination, personal data, toxicity, sharding and media against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import jpeg
from murmuration.llm.decontaminate import Items, Search, decontaminate, leaks, leaks_in, weighted_similarity
from murmuration.llm.decontaminate_queries import QUERIES as LEAKS
from murmuration.llm.media import media_features, store_media
from murmuration.llm.media_queries import QUERIES as MEDIA
from murmuration.llm.pii import Bootstrap, discovered, personal_data
from murmuration.llm.pii_queries import QUERIES as PII
from murmuration.llm.sharding import load_edits, load_map, rebalanced, round_robin, shard
from murmuration.llm.sharding_queries import QUERIES as SHARDS
from murmuration.llm.toxicity import Training, fit, held_out, slopes, toxicity
from murmuration.llm.toxicity_queries import QUERIES as TOXIC

from ..conftest import SMALL
from .conftest import prose
from .test_dedup import LOW


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# 6


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute_leaks(docs, items):
    out = {}
    for d, text in docs.items():
        own = grams(text)
        for k, item in items.items():
            wanted = collections.Counter(grams(item))
            n = sum(wanted.values())
            if not n or not wanted.keys() & set(own):
                continue
            windows = (collections.Counter(own[i : i + n]) for i in range(max(1, len(own) - n + 1)))
            best = max(sum((c & wanted).values()) / sum((c | wanted).values()) for c in windows)
            if best >= 0.8:
                out[d, k] = best
    return out


def test_op6(spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in LEAKS["op6_simhash_windows"](spark, SMALL).collect()}
    wanted = brute_leaks(documents(spark), items)
    assert found.keys() == wanted.keys() and found
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_leaks_with_edits_and_blocks(spark, messy, nothing):
    items = {i: prose(900 + i, 40) for i in range(12)} | {50: None, 51: "", 52: "two words"}
    docs = {}
    for i in range(12):
        words = items[i].split(" ")
        words[i % 3] = "changed"  # near the start, few shingles
        docs[i] = prose(i, 30) + " " + " ".join(words) + " " + prose(40 + i, 30)
        docs[100 + i] = prose(300 + i, 90)
        docs[200 + i] = items[i]
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    wanted = brute_leaks(docs, items)
    assert len(wanted) >= 24
    for search in (Search(), Search(items_at_once=4)):
        found = {(r["doc_id"], r["item_id"]) for r in leaks(d, b, search).collect()}
        assert found == wanted.keys()
        assert {r["doc_id"] for r in decontaminate(d, b, search).collect()} == docs.keys() - {k for k, _ in wanted}
    assert leaks(nothing, b).count() == 0 and leaks(d, b.where("false")).count() == 0
    assert decontaminate(messy, b).count() == messy.count() and decontaminate(messy, b).columns == messy.columns


def test_lightly_edited_leaks_just_over_the_threshold():
    """400 passages of 45 shingles with 5 changed, a similarity of 0.8: a radius of 15 bits misses about 1 in 40."""
    items = {i: prose(5000 + i, 49) for i in range(400)}
    docs = []
    for i, text in items.items():
        words = text.split(" ")
        words[6 + i % 36] = f"changed{i}"
        docs.append(prose(7000 + i, 30) + " " + " ".join(words) + " " + prose(9000 + i, 30))
    raw = [d.encode() for d in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = {(text, item): share for text, item, _, share in leaks_in(data, offsets, Items(list(items.values()), Search()))}
    assert found.keys() == {(i, i) for i in items} and min(found.values()) == 0.8
    assert Search().reach == 23


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    items = Items([prose(i, 40) for i in range(300)], Search())
    size = max(items.by_size, key=lambda s: len(items.by_size[s]))
    members = items.by_size[size]
    prints = rng.integers(0, 2**63, 200).astype(np.uint64)
    for i in range(100):
        bits = rng.choice(64, rng.integers(0, 18), replace=False)
        prints[i] = items.prints[rng.choice(members)] ^ np.uint64(sum(1 << int(b) for b in bits))
    row, item = items.within(size, prints)
    found = set(zip(row.tolist(), item.tolist(), strict=True))
    wanted = {(i, int(m)) for i in range(200) for m in members if int(prints[i] ^ items.prints[m]).bit_count() <= 15}
    assert found == wanted
    assert weighted_similarity(np.array([1, 1, 2], np.uint64), np.array([1, 2, 3], np.uint64)) == 0.5


# 7


def check_shards(rows, texts, shards=8):
    assert len(rows) == len(texts)
    places, load = collections.defaultdict(list), collections.Counter()
    for r in rows:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    for got in places.values():
        assert sorted(got) == list(range(len(got)))
    return load


def test_op7(spark):
    texts = documents(spark)
    rows = SHARDS["op7_virtual_slots"](spark, SMALL).collect()
    load = check_shards(rows, texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    mean = sum(load.values()) / 8
    assert max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean


def test_slot_maps(spark, messy, nothing, tmp_path):
    sizes = np.random.default_rng(1).integers(0, 10_000, 4096)
    first = round_robin(8)
    second = rebalanced(first, sizes)
    load = np.bincount(second.shard_of, weights=sizes)
    assert load.max() - load.min() < 0.001 * load.mean() and second.version == 1
    moved = list(first.shard_of)
    for slot, a, b in second.edits:
        assert moved[slot] == a
        moved[slot] = b
    assert tuple(moved) == second.shard_of
    third = rebalanced(second, sizes, shards=9)
    assert third.edits[0][2] == 8 and len(third.edits) < 4096 / 4
    path = str(tmp_path / "map")
    rows = shard(messy, 3, path, slots=64).collect()
    check_shards(rows, [r for r in messy.collect()], 3)
    assert load_map(spark, path).count() == 64 and load_map(spark, path, 0).where("shard <> virtual_slot % 3").count() == 0
    assert shard(nothing, 3, str(tmp_path / "none")).count() == 0


def test_a_stored_map_is_edited(spark, tmp_path):
    """A second call goes on from the newest version and moves few slots; one more shard takes only what it needs."""
    path, n = str(tmp_path / "map"), 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    more = docs.unionByName(spark.range(n, n + 150).select(F.col("id").alias("doc_id"), F.lit("yy").alias("text")))
    maps = []
    for rows, shards in ((docs, 4), (more, 4), (more, 5)):
        got = shard(rows, shards, path, slots=256).collect()
        check_shards(got, range(rows.count()), shards)
        maps.append({r["virtual_slot"]: r["shard"] for r in load_map(spark, path).collect()})
    assert load_map(spark, path, 0).count() == 256 and load_map(spark, path).first()["shards"] == 5
    for k in (1, 2):
        edits = sorted(load_edits(spark, path, k + 1).collect(), key=lambda r: r["place"])
        moved = dict(maps[k - 1])
        for r in edits:
            assert moved[r["virtual_slot"]] == r["from_shard"]
            moved[r["virtual_slot"]] = r["to_shard"]
        assert moved == maps[k]
    assert sum(maps[0][s] != maps[1][s] for s in maps[0]) < 64
    assert 0 < sum(s == 4 for s in maps[2].values()) < 100


# 8

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_spans(rows, texts):
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
        assert set(base) <= set(r["spans"].split(","))


def test_op8(spark):
    texts = documents(spark)
    rows = PII["op8_context_bootstrap"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    check_spans(rows, texts)


TRICKY = [
    "a@b.c_d@e.f x@y..z @@ a@b a.b@c-d.e.f.",
    "é\U0001f600 x@y.zz 1.2.3.4.5 256.1.1.1 001.02.3.0004 9999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
    "+1 (988) 555-2485 +123 +1-2.3()4 56789 ++49 123 4567890+33 1 23 45 67 89",
    "1" * 40_000 + " " + "a" * 40_000 + "@" + "b" * 50 + ".c " + "1 " * 9000,
    "9.9.9.9@x.y +4111111111111111 4111111111111111@a.b",
]


def test_tricky_spans(spark, messy, nothing):
    texts = dict(enumerate(TRICKY))
    rows = personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check_spans(rows, texts)
    out = personal_data(messy)
    assert out.count() == messy.count()
    assert all(r["spans"] == "" for r in out.where("doc_id in (2, 3, 4)").collect())
    assert personal_data(nothing).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    """Tokens that stand where many seeds stand are found, others are not."""
    rows = [(i, f"please write to mail: user{i}x@site{i}.org today because it matters") for i in range(12)]
    rows += [(20, "please write to mail: user99(at)site99 today because"), (21, "room number99abc is free"), (22, "mail: only7half7context7 tomorrow")]
    out = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)[20]
    at = text.index("user99(at)site99")
    assert out[20]["spans"] == f"email:{at}:{at + 16}" and out[20]["n_added"] == 1 and out[20]["n_email"] == 0
    assert out[21]["spans"] == "" and out[22]["spans"] == ""


def test_tokens_keep_off_base_spans(spark):
    """Discovered tokens never touch a base span, and their places are right behind moved numbers."""
    seeds = [(i, f"please write to mail: user{i}x@site{i}.org today because it matters") for i in range(12)]
    odd = "call +33 (1) 23-45 67 89 or 4111 1111 1111 1111 now. please write to mail: a(at)b99 today because 1.2.3.4x mail: x@y.zz-1@ today because"
    out = {r["doc_id"]: r for r in personal_data(spark.createDataFrame([*seeds, (50, odd)], "doc_id long, text string")).collect()}
    at = odd.index("a(at)b99")
    spans = [s.split(":") for s in out[50]["spans"].split(",")]
    assert ["email", str(at), str(at + 8)] in spans and out[50]["n_added"] == 1
    places = sorted((int(a), int(b)) for _, a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(places, places[1:], strict=False))
    check_spans([out[50]], {50: odd})


# 9


@pytest.mark.parametrize("shift,sign", [(2.0, 1), (-6.0, -1)])
def test_slopes_are_those_of_the_published_risk(shift, sign):
    """Finite differences of a plain risk, with a corrected negative risk over and under its bound."""
    how, prior, n_p = Training(beta=0.01, gamma=0.7), 0.3, 5
    margin = np.random.default_rng(1).normal(size=12)
    margin[n_p:] += shift
    margin[:n_p] += 3.0

    def parts(m):
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(m[:n_p]).mean(), loss(-m[n_p:]).mean() - prior * loss(-m[:n_p]).mean()

    assert (parts(margin)[1] >= -how.beta) == (sign > 0)
    target = (lambda m: sum(parts(m))) if sign > 0 else (lambda m: -how.gamma * parts(m)[1])
    step = 1e-6
    found = [(target(margin + step * e) - target(margin - step * e)) / (2 * step) for e in np.eye(12)]
    assert np.allclose(slopes(margin, n_p, prior, how), found, atol=1e-8)


def test_op9(spark):
    rows = TOXIC["op9_nnpu_toxicity"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(spark):
    """At the middle scale's labels the classifier separates rows it never saw."""
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity(some, labels, how=Training(epochs=30)).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    base_rate = out.agg(F.avg("toxic")).first()[0]
    assert n > 500 and right > 1 - base_rate / 2


def test_labels_of_held_out_rows_do_not_matter(spark, messy, nothing):
    rows = [(i, ("awful " if i % 5 == 0 else "") + prose(i, 30)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in toxicity(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]
    toxic, clean = ([s for i, s in scores[0].items() if (i % 5 == 0) == flag] for flag in (True, False))
    assert min(toxic) > max(clean)
    out = toxicity(messy, labels)
    assert out.count() == messy.count()
    assert len({r["score"] for r in out.where("doc_id in (2, 3, 4)").collect()}) == 1
    assert toxicity(nothing, labels.where("false")).count() == 0
    assert toxicity(messy, labels.where("false")).count() == messy.count()


def test_fit_without_positives_is_the_prior():
    model = fit([], [np.array([1, 2], np.uint32)], 0.2)
    assert abs(model.score(np.array([1], np.uint32)) - 0.2) < 1e-9


# 10


def test_op10(spark):
    texts = documents(spark)
    rows = MEDIA["op10_baseline_jpeg"](spark, SMALL).collect()
    check_media(rows, texts)


def check_media(rows, texts):
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        same = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(raw, same) == same


def test_messy_media(spark, messy, nothing, tmp_path):
    one = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    store_media(one, str(tmp_path / "media"))
    check_media(media_features(spark.read.parquet(str(tmp_path / "media"))).collect(), {r["doc_id"]: r["text"] for r in one.collect()})
    store_media(nothing, str(tmp_path / "none"))
    assert media_features(spark.read.parquet(str(tmp_path / "none"))).count() == 0
    gaps = spark.createDataFrame([(1, None, None)], "doc_id long, n_bytes long, media binary")
    assert media_features(gaps).first()["feature"] is None
    broken = spark.createDataFrame([(1, 5, b"no image"), (2, 5, b""), (3, 5, b"\xff\xd8\xff\xd9")], "doc_id long, n_bytes long, media binary")
    assert all(r["feature"] is None and r["media_sha256"] is None and r["error"] for r in media_features(broken).collect())


@pytest.mark.parametrize("units", [1, 2, 63, 64, 65, 130, 700])
def test_jpeg_round_trip(units):
    payload = np.random.default_rng(units).integers(0, 256, units * 192).astype(np.uint8).tobytes()
    image = jpeg.parse(jpeg.encode([payload])[0])
    values = jpeg.coefficients([image])[0]
    assert jpeg.payload_of(image, values) == payload
    small = jpeg.thumbnail(image, values)
    assert small.shape == (image.height // 8, image.width // 8)
    dc = values[:units, 0, 0].astype(int)
    assert (small.reshape(-1)[:units] == np.clip((dc + 4) // 8 + 128, 0, 255)).all()


def test_jpeg_with_runs_and_ends_of_blocks():
    """A grey image from other tables: zero runs, an end of block, DC differences and no restart intervals."""
    code_dc, code_ac = bytes([0, 2, 0, *[0] * 13, 0, 3]), bytes([0, 2, 1, *[0] * 13, 0x00, 0x13, 0xF0])
    # DC: 00 size 0, 01 size 3. AC: 00 end, 01 one zero then size 3, 100 sixteen zeros
    bits = "01" + "101" + "01" + "010" + "100" + "01" + "111" + "00" + "00" + "00" + "01" + "000" + "00"
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    frame = bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])
    data = b"\xff\xd8" + part(0xDB, bytes([0, *[2] * 64])) + part(0xC0, frame) + part(0xC4, bytes([0]) + code_dc) + part(0xC4, bytes([0x10]) + code_ac) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"
    image = jpeg.parse(data)
    values = jpeg.coefficients([image])[0]
    first = np.zeros(64)
    first[0], first[2], first[2 + 16 + 2] = 5, -5, 7
    assert (values[0, 0] == first).all()
    assert values[1, 0, 0] == 5 and values[2, 0, 0] == 5 - 7 and not values[1:, 0, 1:].any()
    assert jpeg.thumbnail(image, values).tolist() == [[129, 129, 128]]
    for broken in (b"", b"\xff\xd8\xff\xd9", data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.parse(broken)
