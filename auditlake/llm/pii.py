"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues. Each anchor is
handed to the deterministic local parsers of its kind, which expand it to the left and right, find the
boundaries and validate what they found. Positions are code points, ends exclusive.

The base kinds have fixed meanings (leftmost, non-overlapping per kind, failing matches dropped):

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass the Luhn test
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits

Further kinds: ``login`` (user information in a URL), ``handle`` (an account name after an at-sign that begins a
word), ``iban`` (checked modulo 97) and ``secret`` (the value after a cue such as "token =").
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditlake.llm.common import append_columns, free_name

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "handle", "iban", "secret")
#: Cues, lower case; found in the text in lower and upper case and capitalised.
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "iban")

#: Characters after the cue within which a number may begin.
IBAN_WINDOW = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s/@]*)?(?=@)")
_HANDLE = re.compile(r"[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@]|\.[A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IBAN_START = re.compile(r"(?=[A-Z]{2}[0-9]{2})")
_SECRET = re.compile(r"[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9_+/=.-]{8,})")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for mark, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(mark, (kind, len(mark)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("iban" if cue == "iban" else "secret", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban_end(text: str, start: int) -> int:
    """The end of the number that begins here, or 0: the longest prefix that passes the check; a word may follow it directly."""
    m = _IBAN.match(text, start)
    ends = range(m.end(), start + 14, -1) if m else ()
    return next((end for end in ends if text[end - 1] != " " and iban_holds(text[start:end])), 0)


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed in ``KINDS``, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    for last, (anchor, size) in anchors.iter(text):
        at, after = last - size + 1, last + 1
        if anchor == "digit":
            if at >= done["ip"] and (at == 0 or at == done["ip"] or text[at - 1] not in _DIGITS):
                m = _IP.match(text, at)
                if m:
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
            if at >= done["card"]:
                m = _RUN.match(text, at)
                done["card"] = m.end() if m else after
                if m and m.end() - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif anchor == "at":
            left = at
            while left > done["email"] and text[left - 1] in _LOCAL:
                left -= 1
            m = _DOMAIN.match(text, after) if left < at else None
            if m:
                found["email"].append((left, m.end()))
                done["email"] = m.end()
            elif (at == 0 or not text[at - 1].isalnum() and text[at - 1] not in "._%+-/:@") and (m := _HANDLE.match(text, after)):
                found["handle"].append((at, m.end()))
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            if m := _LOGIN.match(text, after):
                found["login"].append(m.span())
        elif anchor == "iban":
            # A number begins within the window and runs on to its own end; the first one that holds counts.
            for m in _IBAN_START.finditer(text, max(after, done["iban"]), after + IBAN_WINDOW + 3):
                end = _iban_end(text, m.start())
                if end:
                    found["iban"].append((m.start(), end))
                    done["iban"] = end
                    break
        elif (m := _SECRET.match(text, after)) and m.start(1) >= done["secret"]:
            found["secret"].append(m.span(1))
            done["secret"] = m.end(1)
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_spans(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """Rows with the list of spans found in the text appended. Null and empty texts have none."""

    def score(at, raw):
        anchors = automaton()
        data = raw.tobytes()
        lists = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = spans_of(data[a:b].decode("utf-8", "replace"), anchors)
            lists.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
        return [lists]

    return append_columns(docs, text, [(free_name(docs, name), SPAN)], score)


def digest_columns(found: DataFrame, doc_id: str = "doc_id", pii: str = "pii") -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans, and all spans as text."""

    def run(batches):
        for batch in batches:
            base = [[(s["kind"], s["start"], s["end"]) for s in spans] for spans in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            sha = [hashlib.sha256(joined([s for s in spans if s[0] in BASE]).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(s) for s in base], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.select(doc_id, pii).mapInArrow(run, kind)
