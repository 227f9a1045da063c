"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, digits that meet
other digits over a dot or a separator, plus signs before digits, schemes and identifier cues.
From each anchor a small local parser walks left and right to the span's boundaries and
validates it: octets of an address, the check digit of a card, the digits of a phone number,
the check digits of an international account number. Parsers of one kind never go back behind
the end of their last match, so every kind's matches are the leftmost non-overlapping ones.

Base kinds are email, ip, card and phone; url (with credentials), account and secret are added,
where they don't overlap a base span. Positions count code points; the end is exclusive.

Results: null counts as empty; an empty text has no spans. Texts are scanned whole in time that
follows their length. Repeated rows each keep their row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ratingmill.llm.base import in_arrow

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = 4
#: Words before an identifier, by the kind that they announce.
CUES = {
    "account": ("iban", "account number", "account no", "acct", "ssn", "passport", "tax id", "routing"),
    "secret": ("token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access key"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_ACCOUNT = re.compile(r"\s{0,3}(?:[:#=]|is)?\s{0,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?|[A-Za-z]{0,2}[0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-/+]{16,}={0,2})(?![A-Za-z0-9])")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for a in _DIGITS:
        found.add_word("+" + a, ("phone", 2))
        for b in _DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(a + between + b, ("card", 2 + len(between)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban(text: str) -> bool:
    code = text.replace(" ", "").upper()
    if not 15 <= len(code) <= 34 or not code[:2].isalpha() or not code[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all personal data, by start, then by kind."""
    done = dict.fromkeys(KINDS, 0)
    found: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    for last, (kind, width) in anchors.iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        at = last - width + 1
        least = done[kind]
        if at < least:
            continue
        if kind == "email":
            start = at
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                done[kind] = m.end()
                found.append((start, 0, m.end()))
        elif kind == "ip":
            start = at
            while start > least and text[start - 1] in _DIGITS:
                start -= 1
            if m := _IP.match(text, start):
                done[kind] = m.end()
                if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) < 256 for part in m[0].split(".")):
                    found.append((start, 1, m.end()))
        elif kind == "card":
            m = _CARD.match(text, at)
            done[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((at, 2, m.end()))
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done[kind] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif kind == "url":
            start = at
            while start > least and at - start < 32 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := _LOGIN.match(text, at)):
                done[kind] = m.end()
                more.append((start, 4, m.end()))
        elif not (at and text[at - 1].isalpha()):
            m = (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
            if m:
                value = m[1]
                sure = any(c in _DIGITS for c in value) if kind == "secret" else not value[:2].isalpha() or value[2:3] not in _DIGITS or iban(value) or value[2:].isdigit()
                if sure:
                    done[kind] = m.end(1)
                    more.append((m.start(1), KINDS.index(kind), m.end(1)))
    return sorted({*found, *apart(more, found)})


def apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``more`` that overlap neither a base span nor one kept before."""
    if not more:
        return []
    base = sorted(base)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    kept: list[tuple[int, int, int]] = []
    for span in more:
        k = bisect_left(starts, span[2])
        at = bisect_left(kept, (span[2], -1, -1))
        if (not k or ends[k - 1] <= span[0]) and (not at or kept[at - 1][2] <= span[0]):
            kept.insert(at, span)
    return kept


def digest(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of spans that overlap replaced by its first kind's tag."""
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, keep: list[str], redacted: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_email, n_ip, n_card, n_phone, base_sha256,
    spans``, and with ``redacted`` a column of that name with the text without its spans (null
    for a null text). One row for each row; no shuffle."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = [f"n_{k}" for k in KINDS[:BASE]]
    schema = f"{types}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string" + (f", `{redacted}` string" if redacted else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            counts, base, all_, clean = [[] for _ in names], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = spans(text, anchors) if text else []
                for k, n in enumerate(counts):
                    n.append(sum(kind == k for _, kind, _ in found))
                own = [s for s in found if s[1] < BASE]
                base.append(hashlib.sha256(digest(own).encode()).hexdigest())
                all_.append(digest(found))
                if redacted:
                    clean.append(redact(text, found) if found else text)
            out = [*batch.columns[:-1], *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(all_, pa.string())]
            if redacted:
                out.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(out, [*keep, *names, "base_sha256", "spans", *([redacted] if redacted else [])])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, schema)
