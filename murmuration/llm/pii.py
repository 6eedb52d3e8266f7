"""Personal data by fixed patterns and by bootstrapped contexts, in built-in functions only.

Seeds are what the fixed patterns find. The words beside a seed are lexical
patterns; Spark scores the graph between patterns and the tokens that stand
in them, round by round, and patterns of high confidence name tokens that the
fixed patterns miss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, let

KINDS = ("email", "ip", "card", "phone")

# The loops are possessive where nothing after them could need a character
# back, so long runs take neither stack nor a second try. A run that fails
# from its first character fails from the others too, so tries begin there,
# or where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth running.
_WORTH = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = r"^" + r"\.".join([_PART] * 4) + r"$"
#: A token with a digit or an at sign: what an unseen identifier may be.
TOKEN = r"(?<!\S)(?=\S{0,64}?[0-9@])[^\s\uE020-\uE02B]{6,64}+(?!\S)"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.ascii(F.substring(digits, n - i, 1)) - 48
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


#: Entries of one block of a running sum.
_BLOCK = 256


def _running(values: Column) -> Column:
    """The sum of all entries before each, of an array of ints. Blocks are summed by themselves and then their totals, so the work stays near the length."""
    none = F.array().cast("array<int>")

    def sums(entries):
        start = F.struct(F.lit(0).alias("at"), none.alias("found"))
        return F.aggregate(entries, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")))

    def in_blocks(values):
        last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: sums(F.slice(values, k * _BLOCK + 1, _BLOCK)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, sums(F.transform(b, lambda x: x["at"]))["found"], lambda x, base: F.transform(x["found"], lambda y: y + base))))

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, sums(v)["found"]).otherwise(in_blocks(v)))


_MATCH = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _matches(text: Column, pattern: str, worth: Column, around: int = 40) -> Column:
    """Array of (start, end, value, left, right) of all leftmost matches, in code points.

    The pieces between matches and the matches alternate, so each start is the
    length of all before it; ``left`` and ``right`` are the ``around``
    characters beside a match, not beyond the next match. No step goes back to
    the whole text for a single match.
    """
    def zipped(both):
        pieces, values = both["pieces"], both["values"]
        inside = F.slice(pieces, 1, F.size(values))
        sizes = F.zip_with(inside, values, lambda p, v: F.length(p) + F.length(v))
        before = F.concat(F.array(F.lit("")), values)
        after = F.concat(F.slice(values, 2, 1 << 30), F.array(F.lit("")))
        rows = F.arrays_zip(inside.alias("piece"), values.alias("value"), _running(sizes).alias("at"), F.slice(before, 1, F.size(values)).alias("before"), F.slice(pieces, 2, 1 << 30).alias("next"), after.alias("after"))
        return F.when(F.size(values) > 0, F.transform(rows, entry)).otherwise(F.array().cast(_MATCH))

    def entry(m):
        start = m["at"] + F.length(m["piece"])
        return F.struct(
            start.alias("start"),
            (start + F.length(m["value"])).alias("end"),
            m["value"].alias("value"),
            F.right(F.concat(F.right(m["before"], F.lit(around)), m["piece"]), F.lit(around)).alias("left"),
            F.left(F.concat(m["next"], F.left(m["after"], F.lit(around))), F.lit(around)).alias("right"),
        )

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return F.when(worth, let(both, zipped)).otherwise(F.array().cast(_MATCH))


def _words_beside(span: Column) -> tuple[Column, Column]:
    """The last word before and the first word after, from the characters beside; '' at the text's edge."""
    trim = "[^\\p{L}\\p{N}=:]"
    return (
        F.lower(F.regexp_replace(F.regexp_extract(span["left"], r"(\S+)\s*+$", 1), trim, "")),
        F.lower(F.regexp_replace(F.regexp_extract(span["right"], r"^\s*+(\S+)", 1), trim, "")),
    )


def _seen(found: Column, kind: Column) -> Column:
    """Matches as (kind, start, end, value, left word, right word)."""

    def one(m):
        left, right = _words_beside(m)
        return F.struct(kind.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), left.alias("left"), right.alias("right"))

    return F.transform(found, one)


def _spans(text: Column, kind: str) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind], _WORTH[kind](text)), lambda m: _valid(kind, m["value"]))
    return _seen(found, F.lit(KINDS.index(kind)))


# Cards and phones may reach over several tokens. For the search for tokens
# their characters move, one for one, to these private ones, which no token
# may hold and which the phone pattern reads like the plain ones.
_PLAIN, _MOVED = "0123456789 -", "".join(chr(0xE020 + i) for i in range(12))
_DIGIT, _GAP = f"0-9{_MOVED[0]}-{_MOVED[9]}", _MOVED[10:]


def _moved(text: Column, pattern: str, worth: Column, good) -> Column:
    """``text`` with the characters of good matches moved."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hidden = F.transform(values, lambda v: F.when(good(v), F.translate(v, _PLAIN + "+().", _MOVED + _MOVED[10] * 4)).otherwise(v))
    joined = F.array_join(F.zip_with(pieces, hidden, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    return F.when(worth, joined).otherwise(text)


def _without_numbers(text: Column) -> Column:
    """``text``, with valid cards and phones moved out of the way of tokens; positions stay."""
    no_cards = _moved(text, PATTERNS["card"], _WORTH["card"](text), lambda v: _valid("card", v))
    phone = rf"\+[{_DIGIT}][\x20().{_DIGIT}{_GAP}-]+[{_DIGIT}]"
    return _moved(no_cards, phone, _WORTH["phone"](text), lambda v: F.length(F.regexp_replace(v, f"[^{_DIGIT}]", "")).between(8, 15))


def _holds_base(value: Column) -> Column:
    """Whether a token holds an email address or a valid ip; neither reaches beyond a token."""
    ips = F.regexp_extract_all(value, F.lit(PATTERNS["ip"]), F.lit(0))
    return value.rlike(PATTERNS["email"]) | F.exists(ips, lambda v: _valid("ip", v))


@dataclass(frozen=True)
class Bootstrap:
    """A pattern needs ``min_seeds`` different seeds and ``confidence``; a token, that mean over its patterns and two of them."""

    rounds: int = 3
    min_seeds: int = 3
    confidence: float = 0.8


def _found(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, base, seen`` of every row; ``seen`` has the base spans and the tokens that none of them touches, with the words beside."""
    text = F.col("text")
    spans = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.xxhash64("text").alias("mark"),
        "text",
        F.concat(*[_spans(text, kind) for kind in KINDS]).alias("known"),
    )
    tokens = F.filter(_matches(_without_numbers(text), TOKEN, text.rlike("[0-9@]")), lambda m: ~_holds_base(m["value"]))
    return spans.select(
        "doc_id",
        "mark",
        F.transform("known", lambda b: F.struct(b["kind"], b["start"], b["end"])).alias("base"),
        F.concat("known", _seen(tokens, F.lit(None).cast("int"))).alias("seen"),
    )


def discovered(found: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``value, kind``: tokens that patterns of high confidence name.

    Edges are distinct (pattern, value) pairs, so frequency in copies counts
    once, and every score is a grouped mean that combines before its shuffle.
    A known value is 1 for its kind and 0 for others; an unknown one has the
    mean confidence of its patterns, and the next round scores patterns with
    that.
    """
    rows = found.select(F.explode("seen").alias("s")).select("s.*")
    beside = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("L "), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("R "), "right")),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B "), "left", F.lit(" "), "right")),
    )
    edges = cut(
        rows.select("value", "kind", F.explode(F.array_compact(beside)).alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.min("kind").alias("kind"))
    )
    named = None
    kinds = range(len(KINDS))
    for _ in range(how.rounds):
        scored = edges if named is None else edges.join(named.select("value", F.col("kind").alias("guess"), "trust"), "value", "left")
        trust = F.lit(0.0) if named is None else F.coalesce("trust", F.lit(0.0))
        guess = F.lit(None).cast("int") if named is None else F.col("guess")
        share = [F.when(F.col("kind") == k, 1.0).when(F.col("kind").isNull() & (guess == k), trust).otherwise(0.0) for k in kinds]
        sums = scored.groupBy("pattern").agg(
            F.count("*").alias("n"),
            *[F.sum(share[k]).alias(f"s{k}") for k in kinds],
            *[F.sum((F.col("kind") == k).cast("int")).alias(f"seeds{k}") for k in kinds],
        )
        best = F.array_max(F.array(*[F.struct((F.col(f"s{k}") / F.col("n")).alias("c"), F.lit(k).alias("k"), F.coalesce(f"seeds{k}", F.lit(0)).alias("seeds")) for k in kinds]))
        good = (F.col("b.c") >= how.confidence) & (F.col("b.seeds") >= how.min_seeds)
        marked = cut(sums.select("pattern", "n", best.alias("b")).select("pattern", "n", F.when(good, F.col("b.c")).alias("c"), F.when(good, F.col("b.k")).alias("k")))
        unknown = join_counted(edges.where("kind is null"), marked, ["pattern"])
        named = cut(
            unknown.groupBy("value")
            .agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("trust"), F.count("c").alias("patterns"), F.min("k").alias("kind"), F.max("k").alias("other"))
            .where((F.col("patterns") >= 2) & (F.col("kind") == F.col("other")) & (F.col("trust") >= how.confidence))
        )
    return named.select("value", "kind")


def personal_data(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row of ``docs``.

    Counts and digest cover the spans of the fixed patterns; ``spans`` adds
    those of discovered tokens, which never touch them, under the kind their
    contexts point to. Offsets are code points, end exclusive.

    Null and empty texts have no span (the digest is of the empty string);
    null doc_ids are kept, repeated rows each get the same answer, and an
    empty table gives no rows. Time follows a text's length, however many
    matches it has. Further columns are not read. Tokens of other than 6 to 64
    characters are no candidates.
    """
    found = cut(_found(docs))
    named = discovered(found, how)
    unknown = found.select("doc_id", "mark", F.explode("seen").alias("s")).where("s.kind is null").select("doc_id", "mark", "s.start", "s.end", "s.value").distinct()
    added = unknown.join(named, "value").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    marked = added.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "added")
    joined = found.join(marked, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k):
        return F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    more = F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    return joined.select(
        "doc_id",
        *[count(k) for k in range(len(KINDS))],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", more))).alias("spans"),
        F.size(more).alias("n_added"),
    )
