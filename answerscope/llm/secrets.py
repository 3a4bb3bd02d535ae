"""Operator 9: secret scans.

An Aho-Corasick automaton over the ASCII-lower-cased bytes finds keywords; only there are the
anchored expressions tried, leftmost first and without overlaps per kind.  Tokens that carry a
checksum or a header of their own count only if it is valid.  Long runs of hexadecimal digits
have no keyword: they are found by run lengths over the bytes.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerscope.llm import common

#: kinds in the order in which spans of one start are listed; the first three are the base
KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem", "google", "slack"]
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])


def _checksum(match: re.Match) -> bool:
    """The last six digits (base 62) are the CRC-32 of the rest after the prefix."""
    body, digits, n = match[2][:-6], [], zlib.crc32(match[2][:-6])
    for _ in range(6):
        n, k = divmod(n, 62)
        digits.append(_DIGITS[k])
    return bool(body) and "".join(reversed(digits)).encode() == match[2][-6:]


def _header(match: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    part = match[1]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _key(match: re.Match) -> bool:
    """The body is whole base64."""
    try:
        return len(base64.b64decode(re.sub(rb"\s", b"", match[2]), validate=True)) > 0
    except (ValueError, binascii.Error):
        return False


# fixed values: the base expressions (kinds assign, access and hex)
RULES = [
    ("assign", ["password", "passwd", "secret", "token", "api_key", "apikey"],
     re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 8),
    ("access", ["akia"], re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("github", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], re.compile(rb"(gh[pousr]_)([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _checksum),
    ("npm", ["npm_"], re.compile(rb"(npm_)([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _checksum),
    ("jwt", ["eyj"], re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), _header),
    ("pem", ["-----begin "], re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"), _key),
    # these kinds have no checksum: their form alone is checked
    ("google", ["aiza"], re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), lambda m: True),
    ("slack", ["xox"], re.compile(rb"xox[abprs]-[0-9]{8,}-[0-9A-Za-z-]{16,}"), lambda m: True),
]
JWT, _PART = next(k for k, r in enumerate(RULES) if r[0] == "jwt"), re.compile(rb"[A-Za-z0-9_-]+")


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for rule, (_, keywords, _, _) in enumerate(RULES):
            for k in keywords:
                self.automaton.add_word(k, (rule, len(k)))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end (code points, exclusive) and kind of every secret, by start and kind."""
        data = text.encode()
        found, done = [], [0] * len(RULES)
        for last, (rule, size) in self.automaton.iter(data.lower().decode("latin-1")):
            start = last + 1 - size
            if start < done[rule]:
                continue
            if not (m := RULES[rule][2].match(data, start)):
                if rule == JWT and data[start:start + 3] == b"eyJ":
                    # what follows this run of characters is the same for all hits in it: none of them matches
                    done[rule] = _PART.match(data, start).end()
            else:
                done[rule] = m.end()
                if RULES[rule][3](m):
                    found.append((start, m.end(), RULES[rule][0]))
        found += [(a, b, "hex") for a, b in hex_runs(data)]
        if found and len(data) != len(text):  # bytes to code points
            begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            at = lambda k: int(begins[k - 1]) if k else 0
            found = [(at(a), at(b), kind) for a, b, kind in found]
        return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def hex_runs(data: bytes, least: int = 32) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` hexadecimal digits."""
    mask = _HEX[np.frombuffer(data, np.uint8)]
    if len(mask) < least:
        return []
    every = mask[::8]  # a run of 32 covers four of these in a row at least
    n = max(1, least // 8)
    near = every[:len(every) - n + 1].copy()
    for k in range(1, n):
        near &= every[k:len(every) - n + 1 + k]
    runs, done, ends = [], 0, None
    for k in np.flatnonzero(near).tolist():
        if 8 * k < done:
            continue
        if ends is None:
            ends = np.flatnonzero(~mask)  # found once: looking for the next end from every place would read the text again and again
        i = int(np.searchsorted(ends, 8 * k))
        start, done = int(ends[i - 1]) + 1 if i else 0, int(ends[i]) if i < len(ends) else len(mask)
        if done - start >= least:
            runs.append((start, done))
    return runs


SPANS = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])))


def scan(docs: DataFrame, row: bool = False) -> DataFrame:
    """Each document's text and its secrets: start, end (code points, exclusive) and kind; all its columns in ``row`` if asked for.

    Null and empty texts have none; repeated rows and null ids are carried; other columns are ignored.
    """
    texts = common.texts_of(docs, row)

    def work(batches):
        scanner = Scanner()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in common.slices(batches):
            spans = [[dict(zip(("start", "end", "kind"), s)) for s in scanner(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return texts.mapInArrow(work, T.StructType([*texts.schema.fields, SPANS]))


def summary(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scan(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", row: bool = False) -> DataFrame:
    """``doc_id``, ``text`` with every stretch of secrets replaced by ``mark``; overlapping ones are one stretch."""
    joined = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).when(s["start"] < a["at"], F.struct(a["out"].alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at"))))
    cut = scan(docs, row).withColumn("cut", F.when(F.size("spans") > 0, joined))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.concat("cut.out", F.substr("text", (F.col("cut.at") + 1).cast("int"))))
    return cut.select("doc_id", text.alias("text"), *(["row"] if row else []))
