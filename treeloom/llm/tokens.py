"""Byte-level BPE in Spark's own higher-order functions.

Every span of a word's bytes that is a token is a possible merge; a fold takes them by rank,
the leftmost first, and makes those whose two parts stand by then. The borders between tokens
are the bits of one number, so a step is a comparison. Ranks are a literal of the plan: a flat
table in which each token has one of two places, so a look-up costs the same for all. Only spans
are looked up that are as long as a token with their first bytes. Distinct
words that are frequent in a bounded sample are folded once and their tokens are part of the
literal, too; all other words are folded where they stand, so the result doesn't depend on the
sample. A long word is folded in pieces of bounded size, as an array of neighbours, so its time
grows with its length. Decoding concatenates the bytes of the tokens. Texts are never shuffled.
"""

from __future__ import annotations

import base64
import random
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the literal: words whose tokens it holds, and texts (with so many of their signs) that these are counted in.
WORDS, SAMPLE, SAMPLE_SIGNS = 262_144, 24_576, 16_384
#: Longest word in the literal, in bytes.
WORD_BYTES = 48

#: A neighbour in a fold is one number: rank of its pair with the next (17 bits), its place in the word (29), its token (17).
_TOKEN, _PLACE, _NONE = (1 << 17) - 1, ((1 << 29) - 1) << 17, (1 << 17) - 1
#: Bytes of a word that are folded at once; of a longer word so many bytes at a time, after the last KEEP tokens before them.
WHOLE, PIECE, KEEP = 60, 64, 4
#: Bits of the hash of a span's first HEAD bytes, by which the lengths of tokens are found.
HEAD, HEAD_BITS = 4, 18

_SPACE = r"\t-\r \x85\xA0  -     　"


def ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def pattern_in_java(pattern: str) -> str:
    """The split pattern with white space as Unicode has it, which Java's own class isn't."""
    # contractions share their first sign: one look instead of seven at every place
    short = r"'s|'t|'re|'ve|'m|'ll|'d|"
    if pattern.startswith(short):
        pattern = "'(?:s|t|re|ve|m|ll|d)|" + pattern[len(short) :]
    return pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def _places(first: list[int], second: list[int], size: int) -> np.ndarray:
    """The number of the key at each place, -1 where none is; a key is at one of its two places, or left out where they are taken.

    A key goes to its first place always and moves on only for another, so one at its second place has a taken first.
    """
    table = [-1] * size
    rnd = random.Random(1)
    for key in range(len(first)):
        now, at = key, first[key]
        for _ in range(500):
            table[at], now = now, table[at]
            if now < 0:
                break
            a, b = first[now], second[now]
            at = b if at == a else a if at == b else rnd.choice((a, b))
    return np.array(table, np.int64)


class Vocabulary:
    """The literal tables of a rank file."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern_in_java(pattern)
        of = ranks(path)
        self.tokens = [b""] * (max(of.values()) + 1)
        for t, r in of.items():
            self.tokens[r] = t
        self.bytes = [0] * 256
        for b in range(256):
            self.bytes[zlib.crc32(bytes([b])) & 0xFF] = of[bytes([b])]  # all different there
        if len(self.tokens) >= 1 << 16:
            raise ValueError("ids of more than 16 bits, or the last of them, which ends a word")
        self.span_size = 1 << (5 * len(of)).bit_length()
        h = np.array([xxhash.xxh64_intdigest(t, 42) for t in of], np.uint64).view(np.int64)
        table = np.full(1, -1)
        while (table >= 0).sum() < len(of):  # every token has its place
            table = _places((h & self.span_size - 1).tolist(), ((h >> 20) & self.span_size - 1).tolist(), self.span_size)
            self.span_size <<= int((table >= 0).sum() < len(of))
        self.spans = pa.array(np.array(list(of.values()), np.int32)[table], mask=table < 0)
        # by a hash of HEAD bytes: the number of the list of lengths that tokens with these first bytes have, shorter ones always
        short = tuple(range(2, HEAD))
        lengths: dict[int, set[int]] = {}
        for t in of:
            if HEAD <= len(t) <= WHOLE:
                lengths.setdefault(xxhash.xxh64_intdigest(t[:HEAD], 42) & (1 << HEAD_BITS) - 1, set()).add(len(t))
        lists = {short: 0}
        self.heads = [0] * (1 << HEAD_BITS)
        for at, n in lengths.items():
            self.heads[at] = lists.setdefault((*short, *sorted(n)), len(lists))
        self.lengths = list(lists)
        # by token, from its first border: all borders of its span, those that stand before its parts are merged, and the one that goes
        self.borders, self.standing, self.middle = ([0] * len(self.tokens) for _ in range(3))
        for t, r in of.items():
            if 1 < len(t) <= WHOLE:
                n, k = len(t), len(_parts(t, of, r)[0])
                self.borders[r], self.standing[r], self.middle[r] = (1 << n + 1) - 1, 1 | 1 << k | 1 << n, 1 << k


def _parts(token: bytes, of: dict[bytes, int], rank: int) -> list[bytes]:
    """The two tokens that the last merge of a token joins: what merges of smaller rank make of its bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        r, i = min((of.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if r >= rank:
            raise ValueError(f"no merges make the token {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once: the finish of a fold over nothing, which asks for no types and copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def bound(t: Tables, names: list[str], body: Callable[[Tables], Column]) -> Column:
    """body with the tables named once in the expression: plans are compared and hashed as a whole, literals too."""

    def more(at: int, have: Tables) -> Column:
        return body(have) if at == len(names) else let(t[names[at]], lambda x: more(at + 1, have | {names[at]: x}))

    return more(0, {})



def _found(span: Column, t: Tables, v: Vocabulary) -> Column:
    """The token that a span of bytes is; null if it is none."""
    h = F.xxhash64(span)

    def at(place: Column, other: Column | None) -> Column:
        def looked(e: Column) -> Column:
            same = F.when(F.get(t["pieces"], e) == span, e)
            # a token is at its second place only if its first is taken; most spans are none and have an empty place
            return same if other is None else same.when(e.isNotNull(), other)

        return let(F.get(t["spans"], place.bitwiseAND(v.span_size - 1)), looked)

    return at(h, at(F.shiftright(h, 20), None))


def _folded(data: Column, t: Tables, v: Vocabulary) -> Column:
    """The tokens of binary data, not empty: the ranked merges of its bytes, as an array of neighbours.

    The smallest number is the leftmost neighbour of the smallest rank. The rank of a pair is the token that it makes.
    The ends of the array are no tokens, so that each neighbour has one on either side.
    """
    none = F.lit(_NONE << 46)

    def rank(a: Column, b: Column) -> Column:
        """Of two neighbours or ends, shifted to its place."""
        pair = F.concat(F.get(t["pieces"], a.bitwiseAND(_TOKEN).cast("int")), F.get(t["pieces"], b.bitwiseAND(_TOKEN).cast("int")))
        return F.coalesce(let(pair, lambda x: F.shiftleft(_found(x, t, v).cast("long"), 46)), none)

    def step(s: Column, _: Column) -> Column:
        def merged(m: Column) -> Column:
            def at(p: Column) -> Column:
                made, left = F.shiftright(m, 46), F.get(s, p - 2)
                two = F.array(left.bitwiseAND(_PLACE | _TOKEN).bitwiseOR(rank(left, made)), m.bitwiseAND(_PLACE).bitwiseOR(made).bitwiseOR(rank(made, F.get(s, p + 1))))
                return F.concat(F.slice(s, F.lit(1), p - 2), two, F.slice(s, p + 2, F.size(s)))

            return F.when(m >= none, s).otherwise(let(F.array_position(s, m).cast("int"), at))

        return let(F.array_min(s), merged)

    def run(parts: Column) -> Column:
        end = F.array(F.lit(_NONE << 46 | 0xFFFF))
        start = F.concat(end, F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, rank(x, F.get(parts, i + 1))).otherwise(none).bitwiseOR(F.shiftleft(i.cast("long"), 17)).bitwiseOR(x)), end)
        # as many steps as bytes have neighbours
        return let(start, lambda s: F.aggregate(F.slice(s, F.lit(4), F.size(s)), s, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(_TOKEN).cast("int"))))

    def of_bytes(data: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.get(t["bytes"], F.crc32(F.substring(data, i, F.lit(1))).bitwiseAND(0xFF)).cast("long"))

    return let(let(data, of_bytes), run)


def _folded_as_bits(data: Column, t: Tables, v: Vocabulary) -> Column:
    """The same for WHOLE bytes at most: all spans that are tokens by rank and place, each merged if its two parts stand.

    One pass is enough: the merges that make a token have smaller ranks, and a span between two borders is merged as if it
    stood alone, so whenever its last two parts meet, no span of a smaller rank is left to be merged anywhere. A length that
    goes beyond the end gives the span up to it once more; the second merge of a span finds its border gone.
    """

    def run(data: Column) -> Column:
        n = F.octet_length(data)
        # places are counted from 1; a border is the bit of the place after it. A possible merge: its token above 6 bits of place

        def merges(i: Column) -> Column:
            head = F.xxhash64(F.substring(data, i, F.lit(HEAD))).bitwiseAND((1 << HEAD_BITS) - 1)
            spans = F.transform(F.get(t["lengths"], F.get(t["heads"], head)), lambda m: F.substring(data, i, m))
            return F.transform(spans, lambda x: F.shiftleft(_found(x, t, v), 6).bitwiseOR(i))

        def step(b: Column, x: Column) -> Column:
            token = F.shiftright(x, 6)
            # a number of 64 bits is shifted by the last 6 bits of x: its place
            stands = F.call_function("shiftright", b, x).bitwiseAND(F.get(t["borders"], token)) == F.get(t["standing"], token)
            return F.when(stands, b.bitwiseXOR(F.call_function("shiftleft", F.get(t["middle"], token), x))).otherwise(b)

        def tokens(b: Column) -> Column:
            def span(i: Column) -> Column:
                rest = F.call_function("shiftright", b, i + 1)
                return F.substring(data, i, F.bit_count(rest.bitwiseXOR(rest - 1)))

            return F.transform(F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: F.getbit(b, i) == 1), span), lambda x: _found(x, t, v))

        every = F.call_function("shiftleft", F.lit(1).cast("long"), n + 2) - 2
        found = F.when(n > 1, F.sort_array(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), merges))))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(found, every, step, tokens)

    return let(data, run)


def _folded_in_pieces(data: Column, t: Tables, v: Vocabulary) -> Column:
    """The same for long data, piece by piece.

    Tokens in a row are the merges of their bytes if and only if every two neighbours are the merges of theirs: the first
    merge across a border between two of them would be made in these two alone, too. So the last KEEP tokens are folded
    again with the next piece, and if the first new token goes with the one before it, all before it stand. If it does
    not, all is folded from the beginning, which is exact as well.
    """
    ids, many = "array<int>", "array<array<int>>"

    def of_token(i: Column) -> Column:
        return F.get(t["pieces"], i)

    def state(done: Column, last: Column, at: Column, tail: Column) -> Column:
        return F.struct(done.alias("done"), last.alias("last"), at.alias("at"), tail.alias("tail"))

    def run(data: Column) -> Column:
        n = F.octet_length(data)

        def step(s: Column, k: Column) -> Column:
            upto = F.least(n, (k + 1) * PIECE)

            def joined(new: Column) -> Column:
                first = new[0]
                goes = (s["last"] < 0) | (F.get(s["tail"], F.lit(0)) == first)
                goes = F.when(goes, True).otherwise(_folded(F.concat(of_token(s["last"]), of_token(first)), t, v) == F.array(s["last"], first))
                again = state(F.array().cast(many), F.lit(-1), F.lit(0), _folded(F.substring(data, F.lit(1), upto), t, v))
                return let(F.when(goes, state(s["done"], s["last"], s["at"], new)).otherwise(again), kept)

            return let(_folded(F.substring(data, s["at"] + 1, upto - s["at"]), t, v), joined)

        def kept(s: Column) -> Column:
            cut = F.size(s["tail"]) - KEEP
            moved = F.slice(s["tail"], F.lit(1), F.greatest(cut, F.lit(0)))
            length = F.aggregate(moved, F.lit(0), lambda a, i: a + F.octet_length(of_token(i)))
            rest = F.slice(s["tail"], cut + 1, F.lit(KEEP))
            return F.when(cut <= 0, s).otherwise(state(F.concat(s["done"], F.array(moved)), F.get(s["tail"], cut - 1), s["at"] + length, rest))

        begin = state(F.array().cast(many), F.lit(-1), F.lit(0), F.array().cast(ids))
        return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), begin, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["tail"]))))

    return let(data, run)


def fold(word: Column, t: Tables, v: Vocabulary) -> Column:
    """The tokens of one word. t: the tables."""
    data = word.cast("binary")
    return F.when(F.octet_length(word) <= WHOLE, _folded_as_bits(data, t, v)).otherwise(_folded_in_pieces(data, t, v))


def pieces(text: Column, v: Vocabulary) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(v.pattern), F.lit(0))


Tables = dict
_LONGS = ["borders", "standing", "middle"]
_INTS = ["spans", "heads", "bytes"]
_FOLD = [*_LONGS, *_INTS, "lengths", "pieces"]
_WORDS = "array<struct<word:string,ids:array<int>>>"


def _variable(spark: SparkSession, name: str, type: str, rows: DataFrame) -> Column:
    """The one value of rows as a constant of every plan that names it."""
    view = f"{name}_view"
    rows.createOrReplaceTempView(view)
    try:
        spark.sql(f"DECLARE VARIABLE {name} {type}")
        spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {view})")
    finally:
        spark.catalog.dropTempView(view)
    return F.expr(name)


def _tables(spark: SparkSession, v: Vocabulary, words: DataFrame | None = None, most: int = 0) -> Tables:
    """The literal: a constant of the plan, sent with its tasks. words: word, ids and h, the word's hash; `most` rows at most.

    The words are placed in an executor and come as one value; the driver's Python never holds them.
    """
    name = f"treeloom_{uuid.uuid4().hex}"
    whole = {k: ("array<bigint>", pa.array([getattr(v, k)], pa.list_(pa.int64()))) for k in _LONGS}
    whole |= {k: ("array<int>", pa.array([getattr(v, k)], pa.list_(pa.int32()))) for k in _INTS}
    whole["lengths"] = ("array<array<int>>", pa.array([v.lengths], pa.list_(pa.list_(pa.int32()))))
    whole["pieces"] = ("array<binary>", pa.array([v.tokens], pa.list_(pa.binary())))
    whole["tokens"] = ("array<string>", pa.array([[t.decode("latin-1") for t in v.tokens]], pa.list_(pa.string())))
    out: Tables = {"names": []}
    for k, (kind, x) in whole.items():
        out[k] = _variable(spark, f"{name}_{k}", kind, spark.createDataFrame(pa.table({k: x})))
        out["names"].append(f"{name}_{k}")
    out["size"] = size = 1 << (2 * most - 1).bit_length() if words is not None else 0
    if words is None:
        return out

    kinds = {"word": pa.string(), "ids": pa.list_(pa.int32()), "h": pa.int64()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        table = {k: pa.concat_arrays([b.column(k).cast(x) for b in found]) if found else pa.array([], x) for k, x in kinds.items()}
        h = table["h"].to_numpy()
        at = _places((h & size - 1).tolist(), ((h >> 24) & size - 1).tolist(), size)
        at = pa.array(at, mask=at < 0)
        held = pa.StructArray.from_arrays([table[k].take(at) for k in ("word", "ids")], names=["word", "ids"])
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), held)], names=["value"])

    rows = words.select("word", "ids", "h").repartition(1).mapInArrow(placed, f"value {_WORDS}")
    out["words"] = _variable(spark, f"{name}_words", _WORDS, rows)
    out["names"].append(f"{name}_words")
    return out


def _drop(spark: SparkSession, t: Tables) -> None:
    """Plans that are analysed hold the values, not the names."""
    for name in t["names"]:
        spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")


def encode(text: Column, t: Tables, v: Vocabulary) -> Column:
    """array<int>: the tokens of a whole text."""
    size = t["size"]

    def of(t: Tables) -> Column:
        def tokens(w: Column) -> Column:
            if not size:
                return fold(w, t, v)

            def at(h: Column, other: Column) -> Column:
                return let(F.get(t["words"], h.bitwiseAND(size - 1)), lambda x: F.when(x["word"] == w, x["ids"]).otherwise(other))

            h = F.xxhash64(w)
            return at(h, at(F.shiftright(h, 24), fold(w, t, v)))

        return F.flatten(F.transform(pieces(text, v), tokens))

    return bound(t, [*_FOLD, *(["words"] if size else [])], of)


def decode(ids: Column, t: Tables) -> Column:
    """binary: the bytes of the tokens, one after the other. A token is a string with one sign for each byte."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(t["tokens"], i)), ""), "ISO-8859-1")


def frequent_words(docs: DataFrame, v: Vocabulary, text: str = "text", words: int = WORDS) -> DataFrame:
    """(word, ids, h) of the most frequent distinct words of the sample, folded: words rows at most."""
    rows = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("h"), F.left(F.col(text), F.lit(SAMPLE_SIGNS)).alias("text"))
    n = docs.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    counted = sample.select(F.explode(pieces(F.col("text"), v)).alias("word")).groupBy("word").count().where(F.octet_length("word") <= WORD_BYTES)
    top = counted.orderBy(F.desc("count"), "word").limit(words).select("word")
    tables = _tables(docs.sparkSession, v)
    out = top.repartition(32, "word").select("word", bound(tables, _FOLD, lambda t: fold(F.col("word"), t, v)).alias("ids"), F.xxhash64("word").alias("h"))
    _drop(docs.sparkSession, tables)
    return out


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The tables of a rank file; the public one with 50,256 tokens, if none is given."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def tokenize(docs: DataFrame, v: Vocabulary, text: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with ids (tokens of every whole text) and decoded (their bytes).

    Null and empty texts have no tokens and decode to nothing; repeated rows get the same tokens each; input columns
    named as those added are replaced; an empty table gives none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    tables = _tables(docs.sparkSession, v, frequent_words(docs, v, text, words) if words else None, words)
    out = docs.select(*keep, encode(F.col(text), tables, v).alias("ids"))
    out = out.withColumn("decoded", decode(F.col("ids"), tables))
    _drop(docs.sparkSession, tables)
    return out


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary(), keep=["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
