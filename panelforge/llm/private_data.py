"""Operator 13: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.  At each anchor
a small deterministic parser expands to both sides and validates what it finds.  The base kinds are exactly the leftmost
non-overlapping matches of their patterns; the expansion adds what those patterns can't see: written-out and non-ASCII
mail addresses, IPv6 addresses, phone numbers after a cue or scheme, bank and other account numbers, logins in addresses.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.registry import query, table
from panelforge.llm.words import kept_in_worker

#: Order of spans that begin at the same place.
KINDS = ("email", "ip", "card", "phone", "account", "login")
BASE_KINDS = KINDS[:4]

PHONE_CUES = ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "whatsapp", "telefon", "teléfono", "téléphone", "handy")
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security", "passport", "iban", "routing")
CARD_CUES = ("card", "karte", "carte", "tarjeta")
#: Last parts of hosts that tell "name at host dot org" from a sentence.
SPELLED_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es")
#: Countries that issue IBANs (ISO 3166 codes of the IBAN registry).
IBAN_COUNTRIES = """AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ
IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG
XK""".split()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER_PHONE_CUE = re.compile(r"(?:\s?(?:number|no|nr|nummer))?\.?\s{0,2}[:=#]?\s{0,2}(\+?[0-9(][ ().0-9/-]*[0-9])(?![0-9])")
_AFTER_ACCOUNT_CUE = re.compile(r"(?:\s?(?:number|no|nr|id|nummer))?\.?\s{0,2}[:=#]?\s{0,2}((?:[A-Z]{1,2}[0-9]|[0-9])(?:[ -]?[0-9])*)(?!\w)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?!\w)")
_TEL = re.compile(r"\+?[0-9(][ ().0-9-]*[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[^\s/@?#]+")
_SPELLED_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+|\s(?:dot|DOT)\s[A-Za-z0-9-]+)+")
_V6 = re.compile(r"[0-9A-Fa-f:]+(?:\.[0-9]+){0,3}")
#: Characters that a parser looks back over from a written-out at-sign.
_REACH = 64


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    odd = [*map(int, digits[-1::-2])]
    even = [2 * d for d in map(int, digits[-2::-2])]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def iban_ok(text: str) -> bool:
    """Whether letters and digits, without spaces, pass the check of ISO 13616."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _plain(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class Finder:
    """Finds spans (start, index in KINDS, end), in code points."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        anchors: dict[str, str] = dict.fromkeys("0123456789", "digit") | {"@": "at", "＠": "wide at", "+": "plus", "::": "v6", "://": "scheme",
                                                                           "%40": "spelled", "tel:": "tel"}
        anchors |= {o + w + c: "spelled" for o, c in ("()", "[]", "{}") for w in ("at", "AT", "At")}
        anchors |= {" at ": "spelled", " AT ": "spelled"}
        for kind, cues in (("phone cue", PHONE_CUES), ("account cue", ACCOUNT_CUES), ("card cue", CARD_CUES)):
            anchors |= {form: kind for cue in cues for form in (cue, cue.upper(), cue.capitalize())}
        anchors |= {c: "country" for c in IBAN_COUNTRIES}
        for form, kind in anchors.items():
            self.anchors.add_word(form, (kind, len(form)))
        self.anchors.make_automaton()

    def find(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans, both sorted."""
        base: list[tuple[int, int, int]] = []
        more: list[tuple[int, int, int]] = []
        mail_to = dotted_to = digits_to = plus_to = v6_to = 0
        for last, (kind, size) in self.anchors.iter(text):
            at = last - size + 1
            if kind == "digit":
                if at >= dotted_to:
                    dotted_to = self._addresses(text, at, base)
                if at >= digits_to:
                    digits_to = self._card(text, at, base)
            elif kind == "at":
                mail_to = self._mail(text, at, mail_to, base, more)
            elif kind == "plus":
                if at >= plus_to and (m := _PHONE.match(text, at)):
                    plus_to = m.end()
                    if 10 <= len(_plain(m[0])) <= 15:
                        base.append((at, 3, plus_to))
            elif kind == "wide at":
                self._wide_mail(text, at, more)
            elif kind == "spelled":
                self._spelled_mail(text, at, last + 1, more)
            elif kind == "v6":
                if at >= v6_to:
                    v6_to = self._v6(text, at, more)
            elif kind == "scheme":
                if m := _LOGIN.match(text, last + 1):
                    more.append((m.start(), 5, m.end()))
            elif kind == "tel":
                if m := _TEL.match(text, last + 1):
                    self._cued_phone(text, m, 0, more)
            elif kind == "country":
                self._iban(text, at, more)
            elif (at == 0 or not text[at - 1].isalnum()) and not text[last + 1:last + 2].isalpha():
                if kind == "phone cue":
                    if m := _AFTER_PHONE_CUE.match(text, last + 1):
                        self._cued_phone(text, m, 1, more)
                elif m := _AFTER_ACCOUNT_CUE.match(text, last + 1):
                    self._cued_account(text, m, kind == "card cue", more)
        base.sort()
        if not more:
            return base, base
        # Spans of one kind don't overlap, so a new one can only meet its neighbours.
        taken = [[s for s in base if s[1] == k] for k in range(len(KINDS))]
        for s in sorted(set(more), key=lambda s: (s[0] - s[2], s)):  # the longest first
            own = taken[s[1]]
            i = bisect(own, s)
            if (i == 0 or own[i - 1][2] <= s[0]) and (i == len(own) or s[2] <= own[i][0]):
                own.insert(i, s)
        spans = [s for own in taken for s in own]
        return base, sorted(spans)

    @staticmethod
    def _addresses(text: str, at: int, base: list) -> int:
        """Each four parts of a run of dotted numbers, from its left, are one match of the pattern."""
        m = _DOTTED.match(text, at)
        parts = m[0].split(".")
        if len(parts) >= 4:
            place = at
            for i in range(0, len(parts) - len(parts) % 4, 4):
                four = parts[i:i + 4]
                size = sum(map(len, four)) + 3
                # Parts may have any number of leading zeros.
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    base.append((place, 1, place + size))
                place += size + 1
        return m.end()

    @staticmethod
    def _card(text: str, at: int, base: list) -> int:
        m = _DIGITS.match(text, at)
        if m.end() - at >= 14:
            digits = _plain(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                base.append((at, 2, m.end()))
        return m.end()

    def _mail(self, text: str, at: int, floor: int, base: list, more: list) -> int:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            base.append((start, 0, m.end()))
            return m.end()
        self._wide_mail(text, at, more)
        return floor

    @staticmethod
    def _wide_mail(text: str, at: int, more: list) -> None:
        """An address with letters beyond ASCII, or a full-width at-sign."""
        start, least = at, max(0, at - _REACH)
        while start > least and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and (m := _WIDE_DOMAIN.match(text, at + 1)) and m[0].rpartition(".")[2].isalpha():
            more.append((start, 0, m.end()))

    @staticmethod
    def _spelled_mail(text: str, at: int, after: int, more: list) -> None:
        """"name (at) host (dot) org" and the like; a bare "at" needs a bare "dot" and a usual end too."""
        bare = text[at] == " "
        end = at
        if not bare and end and text[end - 1] == " ":
            end -= 1
        start, least = end, max(0, end - _REACH)
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        while start < end and text[start] in ".-":
            start += 1
        if text[after:after + 1] == " " and not bare:
            after += 1
        if start < end and (m := _SPELLED_TAIL.match(text, after)):
            if not bare or re.search(r"\s(?:dot|DOT)\s", m[0]) and m[0].rpartition(" ")[2].lower() in SPELLED_ENDS:
                more.append((start, 0, m.end()))

    @staticmethod
    def _v6(text: str, at: int, more: list) -> int:
        start, least = at, max(0, at - 40)
        while start > least and (text[start - 1] in "0123456789abcdefABCDEF:"):
            start -= 1
        m = _V6.match(text, start)
        found = m[0].rstrip(":") if m[0].endswith(":") and not m[0].endswith("::") else m[0]
        # Two parts around "::" also occur as names in program text.
        clear = found.count(":") >= 4 and any("0" <= c <= "9" for c in found)
        if clear and len(found) <= 45 and not text[start - 1:start].isalnum() and not text[start + len(found):start + len(found) + 1].isalnum():
            try:
                ipaddress.IPv6Address(found)
            except ValueError:
                return m.end()
            more.append((start, 1, start + len(found)))
        return m.end()

    @staticmethod
    def _cued_phone(text: str, m: re.Match, group: int, more: list) -> None:
        if 7 <= len(_plain(m[group])) <= 15:
            more.append((m.start(group), 3, m.end(group)))

    @staticmethod
    def _cued_account(text: str, m: re.Match, card: bool, more: list) -> None:
        n = len(_plain(m[1]))
        if card:
            if n == 13 and luhn(_plain(m[1])):
                more.append((m.start(1), 2, m.end(1)))
        elif 6 <= n <= 20:
            more.append((m.start(1), 4, m.end(1)))

    @staticmethod
    def _iban(text: str, at: int, more: list) -> None:
        if (at == 0 or not text[at - 1].isalnum()) and (m := _IBAN.match(text, at)):
            found = m[0]
            # The last words may belong to the sentence: try the longest that checks, ending at a group.
            while len(bare := found.replace(" ", "")) >= 15:
                if len(bare) <= 34 and iban_ok(bare):
                    more.append((at, 4, at + len(found)))
                    return
                head, gap, _ = found.rpartition(" ")
                if not gap:
                    return
                found = head


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


NEW = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def find_private_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_sha256 and spans to every row; other columns stay.

    Base kinds, by their patterns: email; ip (parts at most 255); card (14 to 19 digits that pass the Luhn check); phone (plus
    sign, 10 to 15 digits).  The counts and base_sha256 (of `kind:start:end`, comma-joined, by start and then kind) are
    those of base spans.  `spans` lists all spans in that form, with the added ones: of the same kinds, `account` and
    `login`; an added span that overlaps one of its own kind is left out.  Places are code points, ends exclusive.  A null or
    empty text has no spans.  Whole texts are read; repeated rows are treated alike; input columns named like an output are
    replaced.  Narrow: no shuffle.
    """
    rest = [c for c in docs.columns if c not in NEW]
    df = docs.select(*[docs[c] for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = kept_in_worker("private data", Finder)
        for b in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            hashes, spans = [], []
            for t in b.column(text).to_pylist():
                base, every = finder.find(t) if t else ([], [])
                for k, column in enumerate(counts):
                    column.append(sum([s[1] == k for s in base]))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            new = [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*rest, *NEW])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


@query("op13_private_data")
def op13(spark, sf):
    """Personal data of every document."""
    return find_private_data(table(spark, sf, "documents").select("doc_id", F.col("text")))
