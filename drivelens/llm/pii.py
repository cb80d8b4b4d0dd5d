"""Personal data: patterns propose spans, checks confirm them, words nearby adjust their score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches

#: Kinds in the order that breaks ties of a start. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = 4
#: Score of a confirmed span before its context is read, and what a context word nearby adds or takes.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "secret": 0.6}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "password", "secret", "key", "api"),
}
#: Words that speak against a kind: what else a number or a digest may be.
AGAINST = {
    "email": (),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "invoice", "tracking", "isbn", "serial"),
    "phone": ("order", "invoice", "isbn", "serial"),
    "iban": (),
    "ssn": ("order", "part", "model", "serial", "isbn"),
    "secret": ("commit", "checksum", "digest", "sha", "md", "revision"),
}
BONUS, PENALTY = 0.1, 0.2
REACH = 40
#: Spans of added kinds below this score are dropped; base spans stay whatever their score.
ADDED_MIN = 0.6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match of digits always starts where a run of digits starts, so the look-behind and the possessive runs change no match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: How many characters an IBAN of each country has.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27,
    GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19,
    MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28, TL=23,
    TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
_IBAN = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(f"{c}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _proposals(text: str):
    """(kind, start, end) of every span that its checks confirm."""
    if "@" in text:
        for a, b in _emails(text):
            yield 0, a, b
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield 1, *m.span()
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield 2, *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield 3, *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield 4, *m.span()
    if "-" in text:
        for m in _SSN.finditer(text):
            yield 5, *m.span()
    for m in _SECRET.finditer(text):
        yield 6, *m.span()


def find_spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) by start, then kind; offsets count code points."""
    out = []
    for kind, a, b in _proposals(text or ""):
        near = {w.lower() for w in _WORD.findall(text[max(0, a - REACH) : a] + " " + text[b : b + REACH])}
        name = KINDS[kind]
        score = min(1.0, max(0.0, PRIOR[name] + BONUS * sum(w in near for w in CONTEXT[name]) - PENALTY * sum(w in near for w in AGAINST[name])))
        if kind < BASE or score >= ADDED_MIN:
            out.append((a, kind, b, score))
    return sorted(out)


def mask(text: str | None, spans: list[tuple[int, int, int, float]]) -> str | None:
    """text with each span replaced by its kind; of spans that overlap, the first by start is replaced and the rest of the others with it."""
    if not spans:
        return text
    out, done = [], 0
    for a, kind, b, _ in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_FIELDS = [*(f"n_{k}" for k in KINDS[:BASE]), "n_added"]
DETECTED = T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("max_score", T.DoubleType())])


@F.arrow_udf(DETECTED)
def detect(texts: pa.Array) -> pa.Array:
    """Counts, digest and spans of each text; null counts as empty."""
    rows = []
    for value in texts:
        spans = find_spans(value.as_py())
        base = [s for s in spans if s[1] < BASE]
        counts = [sum(s[1] == k for s in spans) for k in range(BASE)]
        rows.append((*counts, len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), max((s[3] for s in spans), default=0.0)))
    columns = list(zip(*rows, strict=True)) or [()] * 8
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*_FIELDS, "base_sha256", "spans", "max_score"])


@F.arrow_udf(T.StringType())
def masked(texts: pa.Array) -> pa.Array:
    return pa.array([mask(t, find_spans(t)) if t else t for t in (v.as_py() for v in texts)], pa.string())


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans and max_score of the whole text.

    Null and empty texts have no spans. Input columns of the same names are replaced, other extra columns stay;
    repeated rows each get their result; an empty table stays empty. Rows are independent: no shuffle.
    """
    small_batches(docs.sparkSession)
    names = [*_FIELDS, "base_sha256", "spans", "max_score"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, detect("text").alias("__pii")).select(*kept, *[F.col(f"__pii.{n}").alias(n) for n in names])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets, and n_chars, if there, counted anew.

    All rows stay, in place and as often as they are there; null and empty texts stay as they are, other columns too.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "__clean")
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns], masked("text").alias(name))
    new = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(name).cast(docs.schema["n_chars"].dataType)
    return found.select(*[(new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs.select("doc_id", "text"))[["doc_id", *_FIELDS, "base_sha256", "spans", "max_score"]]
