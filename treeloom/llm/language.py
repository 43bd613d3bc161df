"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers how far a text can be read
before it leaves everything that was seen. Reading a text greedily in such longest matches
cuts it into phrases; a phrase costs the bits that point into the labelled text. The
language with the fewest normalised phrases, that is bits for each symbol, wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the labelled sample: symbols of all languages together and of one, and different texts of one. Every
#: language has LEAST_SYMBOLS, even if all together then have more.
SAMPLE_SYMBOLS, LANGUAGE_SYMBOLS, LANGUAGE_ROWS, LEAST_SYMBOLS = 160_000, 40_000, 128, 2_500
#: Parts that the texts of a language are dealt to before its sample is chosen: one language may have most texts.
PARTS = 64
#: Letters of the sample, the most frequent first, whose steps are in a table; those of the others are in a sorted list.
LETTERS = 46
#: Phrases don't cross the ends of blocks of so many symbols, so that many blocks are read at once.
BLOCK = 1024
#: Symbols that are read at once.
GROUP = 1 << 21
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000))
    return _letters[0]


def symbols(text: str, alphabet: str) -> np.ndarray:
    """0 for a run of other signs, 1 for letters outside the alphabet, 2 and up for its letters; no gaps at the ends."""
    table = _table(alphabet)
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes = codes[keep]
    return codes[int(len(codes) > 0 and codes[0] == 0) : len(codes) - int(len(codes) > 1 and codes[-1] == 0)]


_tables: dict[str, np.ndarray] = {}


def _table(alphabet: str) -> np.ndarray:
    if alphabet not in _tables:
        table = _is_letter().astype(np.uint32)
        for i, c in enumerate(alphabet):
            table[ord(c)] = i + 2
        _tables.clear()
        _tables[alphabet] = table
    return _tables[alphabet]


def _steps(codes: np.ndarray) -> list[dict[int, int]]:
    """Steps of the smallest automaton of all substrings; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def _tabled(step: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps by symbols below size as a table, those by others as sorted keys (state and symbol) and states."""
    table = np.full((len(step), size), -1, np.int32)
    rare = []
    for i, x in enumerate(step):
        for c, to in x.items():
            if c < size:
                table[i, c] = to
            else:
                rare.append((i << 21 | c, to))
    keys, to = np.array(sorted(rare), np.int64).reshape(-1, 2).T
    return table, np.ascontiguousarray(keys), np.ascontiguousarray(to)


def suffix_automaton(codes: np.ndarray, size: int) -> np.ndarray:
    """The smallest automaton of all substrings of symbols below size: [state, symbol] -> state, -1 where none is."""
    return _tabled(_steps(codes), size)[0]


def phrases(automaton: np.ndarray, columns: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None, to: np.ndarray | None = None) -> np.ndarray:
    """Phrases of each block: columns[t, b] is symbol t of block b; blocks are sorted by length, longest first.

    keys and to: the steps by symbols that the table of the automaton has no column for.
    """
    flat, size = automaton.ravel(), automaton.shape[1]
    many = keys is not None and columns.size > 0 and int(columns.max()) >= size

    def step(state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not many:
            return flat[state * size + c]
        now = flat[state * size + np.minimum(c, size - 1)]
        rare = np.flatnonzero(c >= size)
        if len(rare):
            now[rare] = -1
            if len(keys):
                wanted = state[rare] << 21 | c[rare].astype(np.int64)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                now[rare] = np.where(keys[at] == wanted, to[at], -1)
        return now

    state = np.zeros(len(lengths), np.int64)
    count = np.zeros(len(lengths), np.int64)
    active = np.searchsorted(-lengths, -np.arange(1, len(columns) + 1), "right")
    for t in range(len(columns)):
        n = int(active[t])
        c = columns[t, :n]
        now = step(state[:n], c)
        missed = np.flatnonzero(now < 0)
        count[missed] += state[missed] > 0
        again = step(np.zeros(len(missed), np.int64), c[missed])
        count[missed] += again < 0  # a symbol that the language lacks is a phrase of its own
        now[missed] = np.maximum(again, 0)
        state[:n] = now
    return count + (state > 0)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """{alphabet, languages: {lang: symbols as bytes}} from labelled rows; rows without text or label don't count."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    kinds = rows.select("lang").distinct().count()
    each = min(LANGUAGE_SYMBOLS, max(LEAST_SYMBOLS, SAMPLE_SYMBOLS // max(1, kinds)))
    if not kinds:
        return {"alphabet": "", "languages": {}}
    # copies count once; the first of each part of a language's texts are at hand before its first are chosen
    picked = rows.select("lang", "h", F.length("text").alias("n"), F.pmod("h", F.lit(PARTS)).alias("part")).distinct()
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.col("n").between(200, each).desc(), "h")
        picked = picked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LANGUAGE_ROWS).drop("k")
    picked = picked.select("lang", "h").distinct()
    sample: dict[str, list] = {}
    # LANGUAGE_ROWS short rows of each language at most
    for r in rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").select("lang", "h", F.left("text", F.lit(2 * each)).alias("text")).distinct().collect():
        sample.setdefault(r["lang"], []).append((not 200 <= len(r["text"]) <= each, r["h"], r["text"]))
    letters = Counter(c for x in sample.values() for *_, t in x for c in t.lower() if c.isalpha())
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0])))
    languages = {}
    for k in sorted(sample):
        codes = symbols(" ".join(t for *_, t in sorted(sample[k])), alphabet)[:each]
        if len(codes):
            languages[k] = codes.tobytes()
    return {"alphabet": alphabet, "languages": languages}


_models: dict[tuple, list] = {}


def _automata(model: dict) -> list[tuple[str, float, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Language, bits of a phrase and automaton; built once in a worker."""
    key = (model["alphabet"], tuple(model["languages"].items()))
    if key not in _models:
        _models.clear()
        _models[key] = [(k, float(np.log2(len(v) // 4 + 1)), _tabled(_steps(np.frombuffer(v, np.uint32)), LETTERS + 2)) for k, v in model["languages"].items()]
    return _models[key]


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: 1 less the ratio of bits of the best and the second language, 0 if unknown."""
    automata = _automata(model)
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    pieces: list[tuple[int, np.ndarray]] = []
    total = np.zeros((len(automata), len(texts)))
    n_symbols = np.zeros(len(texts), np.int64)

    def read() -> None:
        pieces.sort(key=lambda x: -len(x[1]))
        lengths = np.array([len(x) for _, x in pieces])
        columns = np.zeros((int(lengths[0]), len(pieces)), np.uint32)
        for b, (_, x) in enumerate(pieces):
            columns[: len(x), b] = x
        owner = np.array([i for i, _ in pieces])
        for k, (_, bits, (automaton, keys, to)) in enumerate(automata):
            np.add.at(total[k], owner, phrases(automaton, columns, lengths, keys, to) * bits)
        pieces.clear()

    held = 0
    for i, text in enumerate(texts):
        codes = symbols(text or "", model["alphabet"])
        if not codes.any():
            continue
        n_symbols[i] = len(codes)
        for a in range(0, len(codes), BLOCK):
            pieces.append((i, codes[a : a + BLOCK]))
            held += len(pieces[-1][1])
            if held >= GROUP:
                read()
                held = 0
    if pieces and automata:
        read()
    if automata:
        rank = np.argsort(total, axis=0, kind="stable")
        for i in np.flatnonzero(n_symbols).tolist():
            first = total[rank[0, i], i]
            best[i] = automata[rank[0, i]][0]
            score[i] = 1 - first / total[rank[1, i], i] if len(automata) > 1 else 1.0
    return best, score


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with lang_pred and score (0 to 1) of every whole text.

    Null texts and texts without a letter, and all texts if nothing was learned, are `und` with score 0; ties go to the
    language first by name; repeated rows get the same result each; input columns named as those added are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few bytes for each symbol of the sample

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predict(batch.column("__text").to_pylist(), held.value)
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best, pa.string()), pa.array(score)], names=[*kept.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(find, T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add("lang_pred", "string").add("score", "double"))


def held_out(id: str = "doc_id"):
    """True for the third of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known(docs: DataFrame) -> DataFrame:
    """docs whose language is found; those without any letter go. Where no row has a label to learn from, all others stay."""
    model = learn(docs.where(~held_out()))
    if not model["languages"]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=["doc_id", "held_out"])
