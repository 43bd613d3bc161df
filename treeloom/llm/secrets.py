"""Secrets in texts, with a random forest that takes the false positives out.

Candidates are the pieces of a text, between blanks, quotes, brackets and signs that separate
or assign, that could be a secret at all: long ones with a digit or mixed case, of any length,
and shorter ones that are assigned to something; and known formats inside a piece. For each the forest sees its
length, the transitions between its characters, how much of it dictionary words cover, the
path of the text and the neighbouring words. It is trained on labelled findings and then
stands in the plan as one SQL expression; everything here is DataFrame functions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import forest

#: Votes that make a candidate a secret, and the least lengths of candidates.
VOTE, SHORT, LONG = 0.5, 8, 16
MASK = "[SECRET]"

_KEY_WORDS = "(?i)(?:secret|token|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|client[_-]?secret|bearer|apikey)"
_HASH_WORDS = "(?i)(?:commit|sha-?1|sha-?256|md5|digest|checksum|integrity|etag|uuid|guid|revision|hash|build|blob)"
_PATH_WORDS = "(?i)(?:test|example|sample|fixture|mock|doc|readme|spec|demo)"
_FAKE_WORDS = "(?i)(?:example|sample|dummy|changeme|placeholder|your|xxxx|test|fake|redacted|0123456|abcdef|12345)"
_FORMATS = "(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,}\\.[0-9A-Za-z_-]{10,}\\.?[0-9A-Za-z_-]*|glpat-[0-9A-Za-z_-]{20,}|npm_[0-9A-Za-z]{36})"
_KNOWN = f"^{_FORMATS}$"
_KNOWN_INSIDE = f"(?<![0-9A-Za-z]){_FORMATS}(?![0-9A-Za-z])"
#: Signs between pieces; a piece may begin with the scheme of an address and end with padding.
_SIGNS = "\"'`,;&{}()\\[\\]<>=:?|"
_PIECE = f"(?:[A-Za-z][A-Za-z0-9+.-]{{0,20}}+://)?[^\\s{_SIGNS}]++(?:={{1,2}}(?=[\"'`]?(?:[\\s,;&{{}})\\]>|]|$)))?"
#: A piece with the signs around it, or signs alone.
_TOKEN = f"[{_SIGNS}]*+{_PIECE}[{_SIGNS}]*+|[{_SIGNS}]++"
#: Words that names and prose are made of; what they leave of a candidate is its uncovered part.
_DICTIONARY = (
    "the and ing tion ent der die das und ich ein sch que les des eau ment con para los las ado cion en er es re an in on st th ti at ed to of ha ou le de la se ra"
    " user name file path data list view item page text code main index config value string number count time date test http www com org html image print return class public static void import get set key id"
).split()
_COVER = "(?:" + "|".join(sorted(_DICTIONARY, key=lambda w: (-len(w), w))) + ")"
#: A key of any length; single dashes are in the headers of encrypted ones.
_PRIVATE_KEY = "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY-----"

FEATURES = ("length", "digits", "uppers", "lowers", "others", "switches", "vowel_runs", "hex", "known", "uncovered", "fake", "path", "keyed", "hashed", "assigned", "dashes", "card")


def _times(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate; before: the words before it as far as three words back, after: the word after it."""
    n = F.length(value).cast("double")
    near = F.concat_ws(" ", before, after)
    flag = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("double")
    return [
        n,
        _times(value, "[0-9]") / n,
        _times(value, "[A-Z]") / n,
        _times(value, "[a-z]") / n,
        _times(value, "[^0-9A-Za-z]") / n,
        _times(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n,
        _times(F.lower(value), "[aeiou][^aeiou0-9]{1,2}(?=[aeiou])") / n,
        flag(value, "^[0-9a-f]{16,}$|^[0-9A-F]{16,}$"),
        flag(value, _KNOWN),
        F.length(F.regexp_replace(F.lower(value), _COVER, "")) / n,
        flag(value, _FAKE_WORDS),
        flag(path, _PATH_WORDS),
        flag(before, _KEY_WORDS),
        flag(near, _HASH_WORDS),
        flag(before, "[=:]['\"(]*$"),
        _times(value, "[-/.:]"),
        flag(value, "^[0-9 +().:/-]+$"),
    ]


def default_findings(n: int = 240, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, label), n of each kind, made from a seed."""
    rnd = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
    syllables = [w for w in _DICTIONARY if w.isalpha() and len(w) > 1]
    word = lambda k: "".join(rnd.choice(syllables) for _ in range(k))
    prose = lambda: word(rnd.randint(1, 3))
    key = lambda: rnd.choice(["token", "secret", "password", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "SECRET_KEY", "DB_PASSWORD"])
    sign = lambda: rnd.choice([" =", " :", "=", ":", ' = "', '="', ": '"])
    paths = lambda: rnd.choice(["src3", "src/app.py", "config/prod.yml", "tests/example.py", "docs/readme.md", ".env", "src11"])
    out = []
    for _ in range(n):
        b = f"{prose()} {key()}{sign()}"
        bare = f"{prose()} {prose()}"
        out += [
            (pick(hexa, rnd.choice([32, 40, 64])), b, prose(), paths(), 1),
            (pick(alnum, rnd.randint(20, 64)), b, prose(), paths(), 1),
            (pick(alnum + "+/", rnd.choice([40, 44, 86])) + "=" * rnd.randint(0, 2), b, prose(), paths(), 1),
            (pick(alnum + "!@$%", rnd.randint(10, 18)), f"{rnd.choice(['password', 'passwd', 'DB_PASSWORD'])}{sign()}", prose(), paths(), 1),
            ("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), rnd.choice([b, bare]), prose(), paths(), 1),
            (rnd.choice(["ghp_", "gho_", "npm_"]) + pick(alnum, 36), rnd.choice([b, bare]), prose(), paths(), 1),
            ("sk_live_" + pick(alnum, 24), rnd.choice([b, bare]), prose(), paths(), 1),
            ("eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum + "_-", 43), rnd.choice([b, f"{prose()} Bearer"]), prose(), paths(), 1),
            # not secrets
            (pick(hexa, rnd.choice([32, 40, 64])), f"{prose()} {rnd.choice(['commit', 'sha256', 'md5', 'checksum', 'digest'])}{rnd.choice(['', ':', ' ='])}", prose(), paths(), 0),
            (pick(hexa, rnd.choice([32, 40])), bare, prose(), paths(), 0),
            ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rnd.choice([bare, f"{prose()} id:"]), prose(), paths(), 0),
            (word(rnd.randint(5, 9)) + rnd.choice(["", "2", ".3", "_v10"]), rnd.choice([bare, b]), prose(), paths(), 0),
            (f"{word(2)}/{word(2)}/{word(2)}.{rnd.choice(['py', 'html', 'v2'])}", rnd.choice([bare, f"{prose()} path ="]), prose(), paths(), 0),
            (f"https://www.{word(3)}.com/{word(2)}/{rnd.randint(1, 9999)}", bare, prose(), paths(), 0),
            (f"{word(2)}{rnd.randint(1, 99)}@{word(2)}.example.com", bare, prose(), paths(), 0),
            (rnd.choice(["xxxxxxxxxxxxxxxxxxxxxxxx", "your_api_key_here_123", "changeme12345", "example-token-0123456789abcdef", "dummy_secret_value_1"]), b, prose(), "tests/example.py", 0),
            (pick("0123456789", rnd.choice([13, 16, 19])), rnd.choice([bare, f"{prose()} number:"]), prose(), paths(), 0),
            (f"{word(2).title()}{word(2).title()}{word(1).title()}{rnd.randint(1, 9)}", bare, prose(), paths(), 0),
            (f"20{pick('0123456789', 2)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}T10:{pick('012345', 1)}0:00", bare, prose(), paths(), 0),
            (f"process.env.{word(2).upper()}_KEY1", b, prose(), paths(), 0),
            ("GB" + pick("0123456789", 20), bare, prose(), paths(), 0),
        ]
    return out


_forests: dict[tuple, list] = {}


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list:
    """A forest on labelled findings, a bounded list; their features are made by the expressions that the scan uses."""
    key = tuple(findings) if findings is not None else ()
    if key not in _forests:
        rows = findings if findings is not None else default_findings()
        df = spark.createDataFrame(rows, "value string, before string, after string, path string, label int")
        made = df.select(F.array(*features(*(F.col(c) for c in ("value", "before", "after", "path")))).alias("x"), "label").collect()
        _forests[key] = forest.fit(np.array([r["x"] for r in made]), np.array([r["label"] for r in made]))
    return _forests[key]


def candidates(text: Column) -> Column:
    """(value, before, after, at) of all pieces that could be secrets; at counts the pieces of the text from 0."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))

    def of(words: Column) -> Column:
        def long_enough(x: Column, i: Column) -> Column:
            assigned = x.rlike("^[\"'`(\\[{<]*[=:]") | F.get(words, i - 1).rlike("[=:][\"'`(\\[{<]*$")
            size = F.length(x)
            return (size >= SHORT) & ((size >= LONG) | F.coalesce(assigned, F.lit(False))) & x.rlike("[0-9]|[a-z][A-Z]|[A-Z][a-z][A-Z]|[!@$%^&*+/]|AKIA[A-Z]")

        # the filter comes first: of most words only the length is looked at
        at = F.filter(F.transform(words, lambda x, i: F.when(long_enough(x, i), i)), lambda i: i.isNotNull())

        def cut(i: Column) -> Column:
            x = F.get(words, i)
            piece = F.regexp_replace(F.regexp_extract(x, f"^[{_SIGNS}]*+({_PIECE})", 1), "(?<![^0-9A-Za-z=])[^0-9A-Za-z=]++$", "")
            inside = F.regexp_extract(x, f"^[{_SIGNS}]*+", 0)
            back = F.concat_ws(" ", F.get(words, i - 3), F.get(words, i - 2), F.get(words, i - 1), F.nullif(inside, F.lit("")))
            before, after = F.right(back, F.lit(160)), F.left(F.coalesce(F.get(words, i + 1), F.lit("")), F.lit(40))

            def values(v: Column) -> Column:
                known = F.filter(F.regexp_extract_all(v, F.lit(_KNOWN_INSIDE), F.lit(0)), lambda k: k != v)
                return F.concat(F.array(v), F.coalesce(known, F.array().cast("array<string>")))

            # the piece is named once
            found = F.flatten(F.transform(F.array(piece), values))
            return F.transform(found, lambda v: F.struct(v.alias("value"), before.alias("before"), after.alias("after"), i.alias("at")))

        return F.filter(F.flatten(F.transform(at, cut)), lambda c: F.length(c["value"]) >= SHORT)

    # the words are named once, so that the text is split once
    return F.flatten(F.transform(F.array(tokens), of))


def find_secrets(docs: DataFrame, text: str = "text", path: str | None = None, findings: list | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with n_candidates and secrets (kind, value, at, score) by place.

    at counts pieces from 0; private key blocks come first, with at -1 and score 1. A candidate is a secret from VOTE on, a
    tie included; of the words around it the forest sees 160 signs before and 40 after. Null and empty texts have none; pieces
    of any length are candidates; a null path counts as one without a sign of tests. Repeated
    rows get the same result each; input columns named as those added are replaced. No shuffle and no Python.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_candidates", "secrets")]
    trees = train(docs.sparkSession, findings)
    where = F.coalesce(F.col(path), F.lit("")) if path else F.lit("")
    rows = docs.select(*keep, F.col(text).alias("__text"), where.alias("__path")).withColumn("__found", candidates(F.col("__text")))

    def judged(c: Column) -> Column:
        x = F.array(*features(c["value"], c["before"], c["after"], F.col("__path")))
        # features are named once for all trees
        share = F.get(F.transform(F.array(x), lambda f: forest.vote(trees, lambda k: f[k])), F.lit(0))
        kind = F.when(c["value"].rlike(_KNOWN), "known").otherwise("generic")
        return F.struct(kind.alias("kind"), c["value"].alias("value"), c["at"].alias("at"), share.alias("score"))

    keys = F.when(F.contains("__text", F.lit("-----BEGIN ")), F.regexp_extract_all("__text", F.lit(_PRIVATE_KEY), F.lit(0)))
    blocks = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda v: F.struct(F.lit("private_key").alias("kind"), v.alias("value"), F.lit(-1).alias("at"), F.lit(1.0).alias("score")))
    return rows.select(
        *keep,
        (F.size("__found") + F.size(blocks)).cast("long").alias("n_candidates"),
        F.concat(blocks, F.filter(F.transform("__found", judged), lambda s: s["score"] >= VOTE)).alias("secrets"),
    )


def redact(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with MASK for every secret; all rows and columns stay, n_chars follows the text if it is there.

    Null and empty texts stay as they are, and so do rows without an id; repeated rows are masked alike; an empty table
    stays empty. Of secrets that hold one another the longest is masked first.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__t"), (F.col(path) if path else F.lit(None).cast("string")).alias("__p"))
    found = find_secrets(packed, "__t", "__p")
    values = F.array_sort(F.array_distinct(F.transform("secrets", lambda s: s["value"])), lambda a, b: F.length(b) - F.length(a))
    masked = F.when(F.size("secrets") > 0, F.aggregate(values, F.col("__t"), lambda t, v: F.replace(t, v, F.lit(MASK)))).otherwise(F.col("__t"))
    out = found.withColumn("__masked", masked)
    fresh = {text: F.col("__masked")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.size("secrets") > 0, F.char_length("__masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col("__row").getField(c).alias(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = find_secrets(docs, path="source", keep=["doc_id"])
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.transform("secrets", lambda s: s["value"]).alias("secrets"))
