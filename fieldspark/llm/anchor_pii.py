"""Personal data by anchors: an automaton finds signs and cues, small parsers expand each to the whole address or number."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import map_columns

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "account", "url")
#: Words beside which a number is an account or identity number. Fixed values.
CUES = ("account", "acct", "bank account", "compte", "cuenta", "iban", "identity card", "konto", "kontonummer", "passport", "routing", "social security", "ssn")
#: Written-out at-signs. Fixed values.
AT_WORDS = ("(at)", "[at]", "{at}", "<at>")
PHONE_SCHEMES = ("tel:", "sms:", "callto:")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
WIDE_DOMAIN = re.compile(r"[^\W_](?:[^\W_]|-){0,62}+(?:\.[^\W_](?:[^\W_]|-){0,62}+){1,10}+")
SPOKEN_DOMAIN = re.compile(r" ?([A-Za-z0-9-]{1,63}+(?:(?:\.| ?[(\[{<]dot[)\]}>] ?)[A-Za-z0-9-]{1,63}+){1,10}+)", re.IGNORECASE)
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
DIALLED = re.compile(r"[ ().0-9-]*+")
COLONS = re.compile(r"[0-9A-Fa-f:]*+(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?")
AFTER_CUE = re.compile(r"(?:'s)?(?:[ \t]{0,3}(?:number|no\.?|nr\.?|num\.?|id|#))?[ \t]{0,3}[:=#]?[ \t]{0,3}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
AUTHORITY = re.compile(r"[^\s/?#\"'<>()\[\]{}|\\^`]{1,300}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_end(text: str, start: int) -> int | None:
    """End of the longest valid account number (mod 97) that starts here and ends where a group ends; else None."""
    m = IBAN.match(text, start)
    if not m or (start and text[start - 1].isalnum()):
        return None
    for end in range(m.end(), start + 14, -1):
        if (end == len(text) or not text[end].isalnum()) and text[end - 1] != " ":
            code = text[start:end].replace(" ", "")
            if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return end
    return None


@dataclass
class Parsers:
    """One text's spans. Each parser takes the place of its anchor; `after` holds where a kind's next match may start."""
    text: str
    base: list[tuple[int, int, int]] = field(default_factory=list)  # kind, start, end
    added: set[tuple[int, int, int]] = field(default_factory=set)
    after: dict[str, int] = field(default_factory=dict)

    def at_sign(self, at: int, size: int) -> None:
        text, low = self.text, max(self.after.get("email", 0), self.after.get("@", 0))
        self.after["@"] = at + 1
        local = text[low:at]
        start, m = low + len(local.rstrip(LOCAL)), DOMAIN.match(text, at + 1)
        if start < at and m:
            self.base.append((0, start, m.end()))
            self.after["email"] = m.end()
        # letters of all scripts belong to an address, of which the pattern above sees a part or nothing
        first = at
        while first > max(low, at - 64) and (text[first - 1].isalnum() or text[first - 1] in "._%+-"):
            first -= 1
        first += len(text[first:at]) - len(text[first:at].lstrip("._%+-"))
        m = WIDE_DOMAIN.match(text, at + 1)
        if first < at and m and not text[first : m.end()].isascii():
            last = m.group().rsplit(".", 1)[1]
            if len(last) > 1 and last.isalpha() and m.group().split(".")[0][-1] != "-":
                self.added.add((0, first, m.end()))

    def spoken_at(self, at: int, size: int) -> None:
        text, m = self.text, SPOKEN_DOMAIN.match(self.text, at + size)
        end = at - 1 if at and text[at - 1] == " " else at
        start = end - len(text[max(0, end - 64) : end]) + len(text[max(0, end - 64) : end].rstrip(LOCAL))
        start += len(text[start:end]) - len(text[start:end].lstrip("._%+-"))
        if start < end and m and text[start:end][-1].isalnum() and re.search(r"[A-Za-z]{2,}$", m.group(1)):
            self.added.add((0, start, m.end()))

    def digit(self, at: int, size: int) -> None:
        text = self.text
        if at >= self.after.get("ip", 0):
            m = DOTTED.match(text, at)
            self.after["ip"] = m.end()
            parts = m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in four) and all(int(p.lstrip("0") or 0) <= 255 for p in four):
                    self.base.append((1, at, at + size))
                at += size + 1
            at = m.start()
        if at >= self.after.get("card", 0):
            m = DIGITS.match(text, at)
            self.after["card"] = m.end()
            if m.end() - at >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.base.append((2, at, m.end()))
            if at > 1 and text[at - 2 : at].isupper():
                end = iban_end(text, at - 2)
                if end:
                    self.added.add((4, at - 2, end))

    def plus(self, at: int, size: int) -> None:
        if at < self.after.get("phone", 0):
            return
        dialled = DIALLED.match(self.text, at + 2).group().rstrip(" ().-")
        if len(dialled) > 1:
            end = at + 2 + len(dialled)
            self.after["phone"] = end
            if 8 <= 1 + sum(c.isdigit() for c in dialled) <= 15:
                self.base.append((3, at, end))

    def colon(self, at: int, size: int) -> None:
        """Internet addresses of eight groups, which the ip pattern doesn't know."""
        if at < self.after.get(":", 0):
            return
        text, start = self.text, at
        while start > max(0, at - 4) and text[start - 1] in "0123456789abcdefABCDEF":
            start -= 1
        m = COLONS.match(text, start)
        self.after[":"] = max(m.end(), at + 1)
        found = m.group()
        if len(found) > 39 + 7 or found.count(":") < 2 or sum(c != ":" for c in found) < 4 or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            return
        if m.end() < len(text) and text[m.end()].isalnum():
            return
        found = found.rstrip(":") if not found.endswith("::") else found
        try:
            ipaddress.IPv6Address(found)
        except ValueError:
            return
        self.added.add((1, start, start + len(found)))

    def scheme(self, at: int, size: int) -> None:
        """Addresses that hold a name and a password."""
        text, start = self.text, at
        while start > max(0, at - 20) and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        m = AUTHORITY.match(text, at + size)
        if m and start < at and text[start].isalpha():
            name, sign, host = m.group().rpartition("@")
            if sign and 0 < name.find(":") < len(name) - 1 and host:
                self.added.add((5, start, m.end()))

    def mail_scheme(self, at: int, size: int) -> None:
        """Addresses of one machine have no dotted domain."""
        m = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.@-])").match(self.text, at + size)
        if m:
            self.added.add((0, m.start(), m.end()))

    def phone_scheme(self, at: int, size: int) -> None:
        if at and self.text[at - 1].isalnum():
            return
        dialled = DIALLED.match(self.text, at + size).group().rstrip(" ().-")
        if dialled[:1] in set("(0123456789") and 8 <= sum(c.isdigit() for c in dialled) <= 15:
            self.added.add((3, at + size, at + size + len(dialled)))

    def cue(self, at: int, size: int) -> None:
        text = self.text
        if (at and text[at - 1].isalnum()) or text[at + size : at + size + 1].isalpha():
            return
        start = AFTER_CUE.match(text, at + size).end()
        if start == at + size:
            return
        end = iban_end(text, start)
        if not end:
            m = DIGITS.match(text, start)
            if not m or not 6 <= sum(c.isdigit() for c in m.group()) <= 20 or text[m.end() : m.end() + 1].isalnum():
                return
            end = m.end()
        self.added.add((4, start, end))


def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    signs = {"@": Parsers.at_sign, ":": Parsers.colon, "://": Parsers.scheme, "mailto:": Parsers.mail_scheme}
    signs |= dict.fromkeys(AT_WORDS, Parsers.spoken_at) | dict.fromkeys("0123456789", Parsers.digit) | dict.fromkeys((f"+{d}" for d in range(10)), Parsers.plus)
    signs |= dict.fromkeys(PHONE_SCHEMES, Parsers.phone_scheme) | dict.fromkeys(CUES, Parsers.cue)
    for sign, parser in signs.items():
        machine.add_word(sign, (len(sign), parser))
    machine.make_automaton()
    return machine


def spans_of(text: str | None, machine: ahocorasick.Automaton) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start; code points, end exclusive."""
    if not text:
        return []
    found = Parsers(text)
    lower = text if text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, A-Z alone
    for last, (size, parser) in machine.iter(lower):
        parser(found, last + 1 - size, size)
    if not found.base and not found.added:
        return []
    return sorted([(*s, True) for s in found.base] + [(*s, False) for s in found.added.difference(found.base)])


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each stretch of spans as the name of its first kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], s[0], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, masked): one row per document row; spans is an array of (kind, start, end, base), by kind as listed, then start.

    base spans are those of the four plain patterns (email, ip, card, phone) that pass their checks. The others are
    addresses with letters of other scripts or a written-out at-sign, addresses of eight groups, account numbers that pass
    their check digits or stand beside a cue, numbers behind a telephone scheme, addresses that hold a password. They may overlap
    base spans. masked is the text with spans replaced; null if there are none. Null and empty texts have no spans, repeated rows
    and null ids have rows of their own, empty input gives none. Other columns are not read. The work grows with the length of
    a text, whatever its signs.

    The automaton reports the signs of a text in their order; each starts the parser of its kind, which expands to both sides
    and checks the result. A kind's parser leaves out signs inside what it has taken.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch, machine: ahocorasick.Automaton) -> dict:
        spans, texts = [], []
        for text in batch.column(1):
            text = text.as_py()
            found = spans_of(text, machine)
            spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in found])
            texts.append(masked(text, found) if found else None)
        return {"doc_id": batch.column(0), "spans": spans, "masked": texts}

    return map_columns(docs.select("doc_id", F.col("text").cast("string")), run,
                       f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>, masked string", setup=anchors)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_base(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
