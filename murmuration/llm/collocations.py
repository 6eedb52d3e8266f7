"""Collocations by dynamic itemset counting (Brin et al., 1997) over cyclic shard scans.

Texts are dealt once into shards of word hashes. Scans take the shards in
turn, again and again; in each, phrases of all lengths are counted side by
side. A longer phrase joins the scans as soon as both its subphrases (without
its last and without its first word) have reached the threshold, and leaves
them after one full cycle, when its count is complete.

What has reached the threshold goes to the scans as a table of fixed size: a
byte for each slot of hashes, which holds the scan after which the first
phrase of the slot reached it and never changes again. Another phrase in the
slot may have reached it before this one was counted at all, so a phrase
counts as there no sooner than it joined. Then two phrases in a slot can only
make a phrase join needlessly or early, and never before all that it holds
have; when it joins depends on its slots alone, so it always has one full cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, slices_by_bytes, texts_of
from .shingles import mixed

_GAP, _SPLIT = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _GAP
_KIND[[10, 11, 12, 13]] = _KIND[np.frombuffer(b".,;:!?", np.uint8)] = _SPLIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
NEVER = 255


@dataclass(frozen=True)
class Mining:
    """Parameters. ``slot_bits`` sets the size of the table of phrases at the threshold, which is broadcast: 2**24 bytes.

    ``chunk_words`` words are counted at a time in a scan, and stored rows
    hold ``row_words``.
    """

    threshold: int = 100
    longest: int = 5
    shards: int = 3
    slot_bits: int = 24
    chunk_words: int = 2_000_000
    row_words: int = 2_048
    slice_bytes: int = 4 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The lower-cased words of the texts one after another, and whether each begins a piece. Words don't cross texts."""
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    packed = _LOWER[data[inside]]
    places = (np.cumsum(inside) - 1)[at]
    array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(places, len(packed)).astype(np.int64)), pa.py_buffer(packed)])
    splits = np.cumsum(kind == _SPLIT)[at]
    text = np.searchsorted(offsets, at, side="right")
    return array, np.append(True, (splits[1:] != splits[:-1]) | (text[1:] != text[:-1]))[: len(at)]


def _pieces_apart(data: np.ndarray, limit: int):
    """Ranges of one text of about ``limit`` bytes that end where a piece does."""
    i = 0
    while i < len(data):
        j = min(len(data), i + limit)
        while j < len(data):
            found = np.flatnonzero(_KIND[data[j : j + limit]] == _SPLIT)
            if found.size:
                j += int(found[0])
                break
            j = min(len(data), j + limit)
        yield i, j
        i = j


def _dealt(docs: DataFrame, mining: Mining, seed: int, path: str) -> None:
    """Texts as word hashes by shard at ``path``, and the words of the hashes (shard -1).

    Columns: ``shard, lang, n`` words, ``body`` of 8 bytes a word with a zero
    before each piece; or ``hash, word``.
    """

    def run(batches):
        told: set[int] = set()
        turn = 0
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            coded = batch.column(0).dictionary_encode()
            langs, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for first, last in slices_by_bytes(offsets, mining.slice_bytes):
                base = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                ranges = [(0, len(part))] if last - first > 1 else _pieces_apart(part, mining.slice_bytes)
                for a, b in ranges:
                    local = base if last - first > 1 else np.array([0, b - a])
                    words, opens = words_of(part[a:b], local)
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    names = coded.dictionary.to_pylist()
                    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) or 1 for w in names), np.uint64, len(names))
                    new = [i for i, h in enumerate(hashes.tolist()) if h not in told]
                    if len(told) > 500_000:  # what has been said may be said again
                        told.clear()
                    told.update(hashes[new].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), -1, np.int32)), pa.nulls(len(new), pa.string()), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.binary()), pa.array(hashes[new].view(np.int64)), pa.array([names[i] for i in new], pa.binary())], names=["shard", "lang", "n", "body", "hash", "word"])
                    flat = hashes[coded.indices.to_numpy(zero_copy_only=False)]
                    # rows of one language each: documents of a slice by language, cut where a piece begins
                    sizes = np.diff(np.searchsorted(_starts(words, part[a:b]), local))
                    lang = np.repeat(code[first:last], sizes)
                    out = []
                    for g in np.unique(lang).tolist():
                        own, open_ = flat[lang == g], opens[lang == g]
                        cuts = np.flatnonzero(open_)
                        cuts = cuts[np.unique(np.searchsorted(cuts, np.arange(0, len(own), mining.row_words)).clip(0, len(cuts) - 1))]
                        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                            body = np.insert(own[x:y], np.flatnonzero(open_[x:y]), np.uint64(0))
                            out.append((turn % mining.shards, langs[g], y - x, body.tobytes()))
                            turn += 1
                    shard, name, n, body = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(body, pa.binary()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.binary())], names=["shard", "lang", "n", "body", "hash", "word"])

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "shard int, lang string, n long, body binary, hash long, word binary")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def _starts(words: pa.LargeBinaryArray, data: np.ndarray) -> np.ndarray:
    """Places of the words in the texts."""
    inside = np.flatnonzero(_KIND[data] == 0)
    return inside[np.frombuffer(words.buffers()[1], np.int64)[: len(words)]]


def _slots(lang: str, words: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each phrase, a row of word hashes."""
    state = np.full(len(words), np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    for k in range(words.shape[1]):
        state = mixed(state ^ words[:, k], 13)
    return (state >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of each entry, count) of the distinct codes, in order of appearance."""
    coded = pa.array(codes).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(coded.dictionary)
    first = np.empty(n, np.int64)
    first[number[::-1]] = np.arange(len(codes))[::-1]
    return first, number, np.bincount(number, minlength=n)


def counted(lang: str, words: np.ndarray, table: np.ndarray, scan: int, mining: Mining):
    """(phrases as rows of word hashes, counts, first scans) of each length that is counted in this scan.

    ``words`` has a zero between pieces. Phrases are told apart by dense
    numbers built up word by word, so no two of them are ever taken for one.
    """
    place = np.flatnonzero(words != 0)
    first, number, n = _distinct(words[place])
    if scan < mining.shards:
        yield words[place[first]][:, None], n, np.zeros(len(first), np.int64)
    known = table[_slots(lang, words[place[first]][:, None], mining.slot_bits)].astype(np.int64)
    width = len(first)
    word_at = np.zeros(len(words), np.int64)
    word_at[place] = number
    for length in range(2, mining.longest + 1):
        # phrases of length - 1 that have reached the threshold, by place
        ready = known[number] != NEVER
        at, own, reached = place[ready], number[ready], known[number[ready]]
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, own, starts = at[follows], own[follows], np.maximum(reached[follows], reached[follows + 1]) + 1
        if not len(at):
            return
        place = at
        first, number, n = _distinct(own * width + word_at[place + length - 1])
        phrases = words[place[first][:, None] + np.arange(length)]
        starts = starts[first]
        now = (starts <= scan) & (scan < starts + mining.shards)
        if now.any():
            yield phrases[now], n[now], starts[now]
        if length < mining.longest:
            # not before the phrase joined, whoever else is in its slot; NEVER is above all scans
            known = np.maximum(table[_slots(lang, phrases, mining.slot_bits)], starts)


def _scan(rows: DataFrame, table, scan: int, mining: Mining) -> DataFrame:
    """``lang, phrase, n, start`` of what a scan counts, summed chunk by chunk."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                for phrases, n, starts in counted(lang, np.concatenate(parts), table.value, scan, mining):
                    width = 8 * phrases.shape[1]
                    raw = np.ascontiguousarray(phrases.astype(">u8"))
                    ends = np.arange(len(n) + 1, dtype=np.int64) * width
                    key = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
                    for i in range(0, len(n), 100_000):
                        m = min(100_000, len(n) - i)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * m), key.slice(i, m), pa.array(n[i : i + m].astype(np.int64)), pa.array(starts[i : i + m].astype(np.int32))], names=["lang", "phrase", "n", "start"])

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(np.append(np.frombuffer(body, np.uint64), np.uint64(0)))
                size += len(body) // 8
                if size >= mining.chunk_words:
                    yield from out()
                    held, size = {}, 0
        if size:
            yield from out()

    return rows.select("lang", "body").mapInArrow(run, "lang string, phrase binary, n long, start int")


def _new_slots(reached: DataFrame, bits: int) -> np.ndarray:
    """Distinct slots of phrases: 2**bits numbers at most."""

    def run(batches):
        for batch in batches:
            by: dict[tuple[str, int], list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault((lang, len(phrase)), []).append(phrase)
            for (lang, width), phrases in by.items():
                words = np.frombuffer(b"".join(phrases), ">u8").astype(np.uint64).reshape(-1, width // 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(lang, words, bits)).astype(np.int32))], names=["slot"])

    found = reached.select("lang", "phrase").mapInArrow(run, "slot int").distinct().toArrow()
    return found.column("slot").to_numpy()


def frequent_phrases(docs: DataFrame, mining: Mining = Mining(), seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``lang, phrase, n`` of all phrases at the threshold, ``lang, n`` words, ``hash, word``).

    A phrase is the hashes of its words, 8 bytes each, big end first. Scans
    end one full cycle after the last phrase that reached the threshold.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    _dealt(docs, mining, seed, path)
    rows = spark.read.schema("lang string, n long, body binary, hash long, word binary, shard int").parquet(path)
    table = np.full(1 << mining.slot_bits, NEVER, np.uint8)
    state = None
    scan, last = 0, -1
    while scan < mining.shards or scan <= last + mining.shards:
        shared = spark.sparkContext.broadcast(table)
        found = _scan(rows.where(F.col("shard") == scan % mining.shards), shared, scan, mining).withColumn("reached", F.lit(None).cast("int"))
        merged = (found if state is None else state.unionByName(found)).groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.min("reached").alias("reached"))
        enough = F.col("n") >= mining.threshold
        out = merged.withColumn("reached", F.when(enough, F.coalesce("reached", F.lit(scan)))).where(enough | (F.col("start") + mining.shards - 1 > scan))
        step = f"{path}-counts-{scan}"
        out.write.option("compression", "zstd").parquet(step)
        state = spark.read.schema(out.schema).parquet(step)
        new = _new_slots(state.where((F.col("reached") == scan) & (F.length("phrase") < 8 * mining.longest)), mining.slot_bits)
        shared.unpersist()
        if len(new):
            last = scan
            table[new[table[new] == NEVER]] = scan
        scan += 1
    totals = rows.where("shard >= 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return state.where(F.col("n") >= mining.threshold).select("lang", "phrase", "n"), cut(totals), rows.where("shard = -1").select("hash", "word")


def collocations(docs: DataFrame, top: int = 2000, mining: Mining = Mining(), seed: int = 0) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts the phrase's occurrences within pieces, overlaps included;
    ``l`` and ``r`` those of its two parts at the cut with the lowest score
    (the shortest first part of equals), ``n`` the language's words, and
    ``score`` is 1000 a n / (l r) rounded down, in exact decimals. A phrase is
    left out where a longer one at the threshold holds it and is as frequent:
    then some phrase with one word more is, too, so only those are asked.
    Equal scores go by ``a``, then by the phrase's bytes.

    Texts are read once; scans read their word hashes by shard. Counts are
    summed in tasks before they are shuffled, parts' counts are joined by
    salted keys, and ranks keep ``top`` rows a task before the shuffle. Null
    texts are empty, null languages ``und``; repeated rows count each; an empty
    table gives no rows; other columns are not read. A very long text is cut
    where its pieces end. Words are told apart by 64-bit hashes; should two
    words that stand in phrases share one, all is done again with another seed.
    """
    found, totals, words = frequent_phrases(docs, mining, seed)
    counts = found.withColumnRenamed("n", "a")
    size = (F.length("phrase") / 8).cast("int")
    long = counts.where(F.length("phrase") >= 16).withColumn("size", size)
    # the longer phrase's count at each of its two longest parts; a part in very many phrases is one row a task
    inner = long.where("size > 2").select("lang", "a", F.explode(F.array(F.expr("substring(phrase, 1, 8 * (size - 1))"), F.expr("substring(phrase, 9)"))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = long.join(held, ["lang", "phrase"], "left").where("held is null or held < a").drop("held")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring(phrase, 1, 8 * k)").alias("left"), F.expr("substring(phrase, 8 * k + 1)").alias("right"))
    salt, salts = F.pmod(F.xxhash64("phrase"), F.lit(16)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    side = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(n), salts)
    both = cuts.withColumn("salt", salt).join(side("left", "l"), ["lang", "left", "salt"]).join(side("right", "r"), ["lang", "right", "salt"])
    scored = both.join(totals.select("lang", "n", salts), ["lang", "salt"]).withColumn("score", F.expr("cast(1000 * cast(a as decimal(19,0)) as decimal(22,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    lowest = cut(lowest.select("lang", "phrase", "a", "n", "size", "cut.score", "cut.l", "cut.r"))
    each = lowest.select("lang", "phrase", F.posexplode(F.expr("transform(sequence(1, size), i -> substring(phrase, 8 * i - 7, 8))")).alias("place", "code"))
    each = each.withColumn("hash", F.conv(F.hex("code"), 16, -10).cast("long")).withColumn("salt", salt)
    needed = each.select("hash").distinct()
    named = cut(words.join(needed, "hash", "left_semi").groupBy("hash").agg(F.min("word").alias("word"), F.max("word").alias("other")))
    if named.where("word <> other").limit(1).count():
        return collocations(docs, top, mining, seed + 1)
    said = each.join(named.select("hash", F.col("word").cast("string").alias("word"), salts), ["hash", "salt"])
    texts = said.groupBy("lang", "phrase").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("own")).select("lang", "phrase", F.array_join(F.col("own.word"), " ").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    ranked = lowest.join(texts, ["lang", "phrase"]).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
