"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over each whole text and reports anchors:
at-signs, plus signs, digits, URL schemes and identifier cues.  Deterministic
local parsers expand every anchor to a span and validate it.  The four base
kinds give exactly the leftmost non-overlapping matches of their patterns; the
cues add logins in URLs, IBANs and account numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

#: Base kinds in their order, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "account")

#: Cues of the added kinds (fixed values).
CUES = {"://": "login", "IBAN": "iban", "iban": "iban", "Account": "account", "account": "account", "Acct": "account", "acct": "account", "ACCOUNT": "account", "ACCT": "account"}

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
ADDRESS = re.compile(r"[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)").match
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@(?=[A-Za-z0-9])").match
IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])").match
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|id))?[\x20:#=]{1,3}([0-9]{6,17})(?![0-9])").match


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        x = int(d) * (1 + at % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    for cue, kind in CUES.items():
        found.add_word(cue, kind)
    found.make_automaton()
    return found


def emails(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    spans, free = [], 0
    for at in anchors:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_PART:
            begin -= 1
        if begin < at and (m := DOMAIN(text, at + 1)):
            free = m.end()
            spans.append((begin, free))
    return spans


def addresses(text: str, runs: list[int]) -> list[tuple[int, int]]:
    spans, free = [], 0
    for at in runs:
        if at >= free and (m := ADDRESS(text, at)):
            free = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                spans.append(m.span())
    return spans


def cards(text: str, runs: list[int]) -> list[tuple[int, int]]:
    spans, free = [], 0
    for at in runs:
        if at >= free and (m := CARD(text, at)):
            free = m.end()
            if 13 <= free - at <= 37 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                spans.append(m.span())
    return spans


def phones(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    spans, free = [], 0
    for at in anchors:
        if at >= free and (m := PHONE(text, at)):
            free = m.end()
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(m.span())
    return spans


def cued(text: str, kind: str, anchors: list[int]) -> list[tuple[int, int]]:
    """Spans right after a cue that ends at an anchor; they don't overlap each other."""
    spans, free = [], 0
    for at in anchors:
        if at < free:
            continue
        if kind == "login":
            m = LOGIN(text, at)
            span = (at, m.end() - 1) if m else None
        else:
            m = (IBAN if kind == "iban" else ACCOUNT)(text, at)
            span = m.span(1) if m and (kind == "account" or iban_valid(m.group(1).replace(" ", ""))) else None
        if span:
            free = span[1]
            spans.append(span)
    return spans


def find_spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in a text, in code points; ``anchors`` is the automaton."""
    at: dict[str, list[int]] = {"digit": [], "at": [], "plus": [], "login": [], "iban": [], "account": []}
    for last, kind in anchors.iter(text):
        at[kind].append(last)
    digits = at["digit"]
    runs = [d for k, d in enumerate(digits) if not k or digits[k - 1] != d - 1]
    found = {"email": emails(text, at["at"]), "ip": addresses(text, runs), "card": cards(text, runs), "phone": phones(text, at["plus"])}
    for kind in ADDED:
        found[kind] = cued(text, kind, [x + 1 for x in at[kind]]) if at[kind] else []
    return found


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Every span of personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base (the base kinds' spans as
    ``kind:start:end``, comma-joined), spans (all spans likewise) and values (the
    spans' texts): one row per row of ``docs``.  A null text counts as empty and,
    like any text without spans, gives zeros and empty strings.  Repeated rows
    give repeated results; an empty table gives no rows; other columns and a null
    doc_id don't matter.
    """

    def rows(batches):
        anchors = automaton()
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "values")}
            for doc_id, text in zip(b["doc_id"], b["body"], strict=True):
                found = find_spans(text, anchors)
                said = {k: ",".join(f"{k}:{s}:{e}" for s, e in v) for k, v in found.items()}
                out["doc_id"].append(doc_id)
                for k in BASE:
                    out[f"n_{k}"].append(len(found[k]))
                out["base"].append(",".join(said[k] for k in BASE if said[k]))
                out["spans"].append(",".join(said[k] for k in BASE + ADDED if said[k]))
                out["values"].append([text[s:e] for k in BASE + ADDED for s, e in found[k]])
            yield out

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, values array<string>")
