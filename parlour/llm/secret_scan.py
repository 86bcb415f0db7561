"""Operator 4: secret scan. Fixed patterns, and dictionary-primed zstandard novelty for the rest.

The patterns find assignments, access keys and hex runs. Beyond them, a run of identifier characters near a
sensitive word is a candidate; its novelty is the number of compressed bytes it adds to the text around it,
with zstandard primed by a dictionary of common identifiers and code. What the context or the dictionary
explains adds little; a random secret adds nearly its entropy, and is reported.

Scale: a map over whole texts without shuffle. Patterns are tried only where a cheap search finds their fixed
part; compression is run on candidates alone, each against a bounded window of CONTEXT characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns as given.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs of 16 or more: what HEX finds and keeps
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "novel")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Candidates: runs of identifier characters near a sensitive word, which may be part of a name in any case style.
SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth(?:orization)?|bearer|client[_ -]?id|signature|session[_ -]?id|cookie|license[_ -]?key|encryption[_ -]?key)s?", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{10,}")  # fewer cannot add LEAST_BYTES
NEAR = 64  # characters between a sensitive word and a candidate on either side, at most
CONTEXT = 512  # characters either side that prime the compressor
LEAST_BYTES, LEAST_SHARE = 10, 0.65  # added bytes, and added bytes per character, of an incompressible string

# Common identifiers and code, the compressor's dictionary.
DICTIONARY = ("import from return function class def const let var public private static void int string bool true false null none self this new try except catch "
              "throw raise if else elif for while in not and or is lambda async await yield with as print console.log document.getElementById addEventListener "
              "http https www com org net html json xml yaml config settings environment production development localhost example test sample placeholder changeme "
              "username password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret authorization bearer basic "
              "session_id cookie user_id account_id project_id request response header content-type application/json charset utf-8 user-agent accept-language "
              "get_value set_value getElementsByClassName XMLHttpRequest Content-Disposition Access-Control-Allow-Origin aws_access_key_id aws_secret_access_key "
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/= 0123456789abcdef 1234567890 qwertyuiop BEGIN RSA PRIVATE KEY END CERTIFICATE "
              "your_api_key_here your-secret-token insert_password_here xxxxxxxxxxxxxxxxxxxx 00000000000000000000 ")


class Novelty:
    """Marginal compressed bytes of a string after its context, under the dictionary."""

    def __init__(self, dictionary: str = DICTIONARY):
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=12, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def __call__(self, text: str, start: int, end: int) -> int:
        around = (text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT] + "\n").encode("utf-8", "replace")
        return len(self.compress(around + text[start:end].encode("utf-8", "replace"))) - len(self.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind; too short ones dropped."""
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context that overlap no base span."""
    near = [m.span() for m in SENSITIVE.finditer(text)]
    if not near:
        return []
    starts, ends = [a for a, _ in near], [b for _, b in near]
    out = []
    for m in CANDIDATE.finditer(text):
        i, j = bisect_left(ends, m.start() - NEAR), bisect_right(starts, m.end() + NEAR)
        if i >= j:
            continue
        inside = [(a, b) for a, b in near[i:j] if a < m.end() and b > m.start()]  # a name holds the word: its other parts
        for a, b in zip([m.start(), *[b for _, b in inside]], [*[a for a, _ in inside], m.end()]):
            if b - a < LEAST_BYTES or any(x < b and y > a for x, _, y in base):
                continue
            n = novelty(text, a, b)
            if n >= LEAST_BYTES and n >= LEAST_SHARE * (b - a):
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, novel_spans(text, base, novelty)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end, secret), by start, then kind; positions in
    code points, end exclusive.

    A null text counts as empty and has no spans. Repeated rows get equal results; an empty table an empty
    result. Other columns are not read."""
    kind = "array<struct<kind:string,start:long,end:long,secret:string>>"

    @F.pandas_udf(kind)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty()
        for texts in batches:
            out = []
            for t in texts:
                base, more = scan(t, novelty)
                out.append([{"kind": KINDS[k], "start": a, "end": b, "secret": t[a:b]} for a, k, b in sorted(base + more)])
            yield pd.Series(out)

    return docs.select(F.col(id_col).alias("doc_id"), spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def secret_report(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined), n_novel from ``secret_spans``."""
    text = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"), count("novel"))
