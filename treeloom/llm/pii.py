"""Personal data: patterns propose spans, validators confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds whose spans always count, then those that need a score of MIN_SCORE; spans are ordered so.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id_number")
MIN_SCORE = 0.5
#: Characters to either side in which a context word counts.
NEAR = 48

#: kind: score of a confirmed span without context
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.75, "phone": 0.6, "iban": 0.9, "id_number": 0.3}
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|courriel|correo|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta|cvv|cvc)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|call|fax|telefon|teléfono|téléphone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "id_number": re.compile(r"(?i)\b(?:ssn|social|security|insurance|tax|steuer|passport)\b"),
}
_LOCAL = "".join(map(chr, range(128)))
_LOCAL = "".join(c for c in _LOCAL if c.isalnum() or c in "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that no earlier match has begun is entered at its first digit only, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of account numbers: country and check digits to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # from here on nothing is matched yet, nor is a run that ended at an earlier sign
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start():  # words in capitals may follow
            if 15 <= len(code := text[m.start() : end].replace(" ", "")) <= 34 and mod97(code):
                yield "iban", m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
    for m in _ID.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "id_number", *m.span()


def spans(text: str | None) -> list[dict]:
    """kind, start, end (code points, end exclusive) and score of all spans of a text, by kind and start."""
    out = []
    for kind, start, end in _confirmed(text or ""):
        near = _CONTEXT[kind].search(text[max(0, start - NEAR) : start]) or _CONTEXT[kind].search(text[end : end + NEAR])
        score = min(1.0, _SCORE[kind] + 0.3 * bool(near))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append({"kind": kind, "start": start, "end": end, "score": score})
    return sorted(out, key=lambda x: (KINDS.index(x["kind"]), x["start"]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) and pii: spans of every whole text.

    Null and empty texts have no spans; repeated rows get the same spans each; an input column named pii is replaced.
    No shuffle: each row is one text's work.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([spans(t.as_py()) for t in batch.column("__text")], kind)
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, found], names=[*kept.schema.names, "pii"])

    return rows.mapInArrow(find, T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add("pii", T.DataType.fromDDL(SPANS)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])

    def joined(of):
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of_kind(*kinds):
        return F.filter("pii", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(of_kind(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
