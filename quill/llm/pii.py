"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

Base spans follow four fixed patterns with their checks.  Beyond them,
high-recall generators propose overlapping spans (written-out addresses, IPv6,
card numbers with other separators, telephone numbers without a plus sign): of
neighbouring digit groups, every window whose digit count fits.  Boosted trees
score each by format, neighbours and context, and those at or above the
calibrated threshold of their kind are added, best score first, unless they
overlap a base span or a better one.

The trees are trained on the driver on the candidates of ``TRAIN_ROWS`` labelled
texts from a seeded generator (no table labels spans), where numbers stand alone
or beside others; half of the texts fit the trees, the other half sets the lowest
threshold with a precision of ``PRECISION``.  The model is a few thousand numbers,
whatever the data.

Each text is scanned whole on its own, in time linear in its length (a digit
group starts at most ``CARD_DIGITS`` windows); candidates are scored in blocks of
``SCORE_ROWS``, so a text full of numbers takes no more memory: no shuffle, no
group.  Defined cases: null or empty text has no spans; repeated
rows get equal spans; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.boost import Boost, calibrated_threshold
from quill.llm.pieces import chunks

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, PRECISION, SEED = 9000, 0.99, 11
CONTEXT = 40
CARD_DIGITS, SCORE_ROWS = 19, 8192

Span = tuple[str, int, int]

# --- base patterns ------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind and the possessive runs only spare starts that cannot match
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)  # no match can hold this @
        at = text.find("@", max(end, at + 1))


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# --- candidates ---------------------------------------------------------------------------------

AT = "@＠﹫"
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|DOT|punkt|point|punto)\s)"
AT_WORD = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\s?[\[({]\s?(?:at|AT|" + f"[{AT}]" + r")\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:" + DOT
                     + r"[A-Za-z0-9-]{1,63})++|\s(?:at|AT)\s[A-Za-z0-9-]{1,63}(?:\s(?:dot|DOT|punkt|point|punto)\s[A-Za-z0-9-]{1,63})++"
                     + rf"|\s?[{AT}]\s?" + r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++)")
AT_SIGNS = (*AT, " dot ", " DOT ", " punkt ", " point ", " punto ", "(at", "[at", "{at", "(AT", "[AT", "{AT", "( at", "[ at", "{ at")
# eight groups, or fewer with "::"; whether it is an address is checked
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
GROUP = re.compile(r"[0-9]+")
# what may stand between the groups of one number: blanks and dashes of any width, brackets, points
BETWEEN = "\x20\xa0\u2007\u2009\u202f().,_/\u00b7\u2010-\u2015\u2212-"
GAP = re.compile(f"[{BETWEEN}]{{1,3}}")


def is_ipv6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s)) and any(c != ":" for c in s)
    except ValueError:
        return False


def windows(text: str) -> Iterator[Span]:
    """Every run of neighbouring digit groups that holds as many digits as a telephone or card number."""
    # groups of the current run that a window can still start at
    run: list[tuple[int, int]] = []
    for m in GROUP.finditer(text):
        a, b = m.span()
        if run and not GAP.fullmatch(text, run[-1][1], a):
            run = []
        run.append((a, b))
        n, k = 0, len(run)
        while k and n + run[k - 1][1] - run[k - 1][0] <= CARD_DIGITS:
            k -= 1
            start = run[k][0]
            n += run[k][1] - start
            first = start - (start > 0 and text[start - 1] in "(+")
            if 7 <= n <= 15:
                yield "phone", first, b
            if 13 <= n:
                yield "card", start, b
        del run[:k]


def candidates(text: str) -> Iterator[Span]:
    """High-recall proposals; they may overlap."""
    if any(s in text for s in AT_SIGNS):
        yield from (("email", m.start(), m.end()) for m in AT_WORD.finditer(text))
    if ":" in text:
        yield from (("ip", m.start(), m.end()) for m in IPV6.finditer(text) if is_ipv6(m[0]))
    yield from windows(text)


HINTS = [re.compile(p, re.I) for p in (
    r"(?:phone|tel|t[ée]l[ée]phone|tel[ée]fono?|call(?:s|ed)?|mobile?|m[óo]vil|cell|fax|whatsapp|sms|dial|ring|handy|rufen?|anruf|appel\w*|portable|llam\w+)\W{0,3}(?:\w+\W{1,2}){0,2}$",
    r"\b(?:card|visa|mastercard|credit|debit|amex|karte|kreditkarte|carte|tarjeta)\b", r"\b(?:e-?mail|mail|contact|write to|reach|correo|kontakt)\b",
    r"\b(?:ip|host|server|address|client|login from|ping|route|subnet|gateway)\b",
    r"\b(?:order|invoice|isbn|issn|version|ticket|ref|reference|serial|date|page|no|nr|id|sum|total|population|part|model|code|track\w*|account|row|line|score|results?|bestellung|rechnung|commande|facture|pedido|factura)\b")]


BEFORE_GROUP, AFTER_GROUP = re.compile(f"([0-9]+)([+{BETWEEN}]{{1,4}})\\Z"), re.compile(f"([+{BETWEEN}]{{1,4}})([0-9]+)")


def neighbours(text: str, a: int, b: int, gaps: list[str]) -> list[float]:
    """The digit groups beside a candidate: digits, gap and whether the gap is one of its own."""
    p, n = BEFORE_GROUP.search(text[max(0, a - 24):a]), AFTER_GROUP.match(text, b, b + 24)
    left, before = p.groups() if p else ("", "")
    after, right = n.groups() if n else ("", "")
    return [len(left), len(before), float("," in before), float(before != "" and before in gaps),
            len(right), len(after), float("," in after), float(after != "" and after in gaps)]


def features(text: str, span: Span) -> list[float]:
    """Format, neighbours and context of a candidate."""
    kind, a, b = span
    s = text[a:b]
    d = digits_of(s)
    words = re.findall(r"[0-9]+", s)
    groups = [len(x) for x in words] or [0]
    gaps = re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", s)
    before, after = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
    prev, nxt = text[a - 1:a], text[b:b + 1]
    low = s.lower()
    return [
        len(s), len(d), len(d) / max(1, len(s)), len(groups), max(groups), min(groups), groups[0], groups[-1],
        s.count("."), s.count("-"), s.count(" "), s.count("("), s.count(","), s.count("/"), s.count(":"),
        float(len(set(re.findall(r"[^0-9]", s)))), float(len(d) >= 12 and luhn(d)),
        float(d[:1] in "3456" and bool(d)), float(bool(re.search(r"[\[({]\s?(?:at|@)\s?[\])}]", low))),
        float(bool(re.search(r"(?:\bdot\b)", low))), float("@" in s), float(low.startswith("(")),
        float(bool(re.search(r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$|(?:dot|[.])\s?[\])}]?\s?(?:com|org|net|edu|gov|io|de|fr|es|uk)$", low))),
        float(prev.isalnum()), float(prev in "#$€£%" and prev != ""), float(nxt.isalnum()), float(nxt in "%€$" and nxt != ""),
        float(s.count(" ")) / max(1, len(groups)), float(prev == "+" or s[:1] == "+"), len(set(gaps)),
        float(bool(words) and len(words[0]) == 4 and words[0][:2] in ("19", "20")), float(groups[1] if len(groups) > 1 else 0),
        float(d[:1] == "0"), float(len(set(groups)) == 1), float("::" in s), sum(c in "abcdefABCDEF" for c in s),
        float(bool(re.search(rf"[{AT}]", s))), float(any(ord(c) > 127 for c in s)), float(prev in ":=" and prev != ""),
        *neighbours(text, a, b, gaps),
        *[float(bool(h.search(before))) for h in HINTS], float(bool(HINTS[4].search(after[:12])))]


# --- training sample ----------------------------------------------------------------------------

def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, short: bool = False) -> str:
    """A number with its check digit; ``short``: of fifteen digits."""
    body = r.choice(["34", "37"]) + _number(r, 12) if short else r.choice("34563456345612789") + _number(r, 14)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _word(r: random.Random) -> str:
    return "".join(r.choice(["th", "er", "on", "an", "re", "ha", "es", "in", "ou", "ti"]) for _ in range(r.randint(1, 4)))


PHONES = ("({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")
BLANKS = (" ", " ", " ", "\xa0", "\u202f")
CALLS = ("call ", "phone ", "tel ", "mobile ", "Tel. ", "Tel: ", "phone: ", "fax ", "call us at ", "ring ", "Telefon ", "Handy ", "rufen Sie ",
         "t\u00e9l\u00e9phone ", "appelez le ", "portable : ", "tel\u00e9fono ", "llame al ", "m\u00f3vil ", "whatsapp ", "sms to ", "my number is ", "the number ", "numbers: ", "Telefon: ")


def _phone(r: random.Random, plus: bool = False) -> str:
    """A telephone number as it is written in some country."""
    if plus and r.random() < 0.5:  # the base pattern may take it together with a number behind it
        return f"+{r.randint(1, 99)} " + r.choice(PHONES).format(_number(r, 3), _number(r, 3), _number(r, 4))
    way = r.random()
    if way < 0.1:
        return f"0{_number(r, 3)} {_number(r, 7)}"
    if way < 0.2:  # pairs behind a nought
        return r.choice([*BLANKS, ".", "-"]).join(["0" + r.choice("123456789"), *[_number(r, 2) for _ in range(4)]])
    if way < 0.3:  # threes
        cuts = r.choice([(3, 3, 3), (3, 3, 3), (3, 2, 2, 2), (2, 3, 2, 2)])
        return r.choice([*BLANKS, ".", "-"]).join([r.choice("679") + _number(r, cuts[0] - 1), *[_number(r, n) for n in cuts[1:]]])
    if way < 0.45:  # an area code and a number
        code = "0" + _number(r, r.randint(2, 4)) + r.choice([*BLANKS, "/", "-", " / ", " - "])
        return code + (_number(r, r.randint(5, 8)) if r.random() < 0.6 else " ".join(_number(r, 2) for _ in range(r.randint(3, 4))))
    s = r.choice(PHONES).format(r.choice("23456789") + _number(r, 2), _number(r, 3), _number(r, 4))
    dash = r.choice(["-", "-", "-", "\u2013", "\u2011"])
    return s.replace("-", dash)


def _plain_number(r: random.Random) -> str:
    """A number that is no personal data."""
    return r.choice([lambda: _number(r, r.randint(1, 6)), lambda: r.choice(["19", "20"]) + _number(r, 2),
                     lambda: f"20{_number(r, 2)}-{_number(r, 2)}-{_number(r, 2)}",
                     lambda: f"{_number(r, 2)}.{_number(r, 2)}.{_number(r, 4)}", lambda: f"{_number(r, 1)},{_number(r, 3)}",
                     lambda: f"{_number(r, 2)}.{_number(r, 2)}", lambda: f"{_number(r, 2)}.{r.randrange(256)}.0.{r.randrange(256)}"])()


BESIDE = (" ", ", ", ", ", " - ", " / ", "/", ". ", "; ", " and ", " or ")


def examples(rows: int = TRAIN_ROWS, seed: int = SEED) -> Iterator[tuple[Span, str, bool, list[Span]]]:
    """Seeded labelled candidates: span, text, whether it is personal data, and all personal data of the text."""
    r = random.Random(seed)
    tld = ["com", "org", "net", "de", "fr"]
    made = 0
    while made < rows:
        kind = r.choice(KINDS)
        good = r.random() < 0.5
        beside = r.random() < 0.5  # other numbers beside a card or telephone number
        say = ""
        if kind == "email":
            name, site = _word(r) + r.choice(["", ".", "_"]) + _word(r), _word(r)
            if good:
                a, d = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "),
                                 (" @ ", "."), (" \uff20 ", "."), ("\uff20", "."), (" {at} ", " {dot} "), (" at ", " punkt "), (" at ", " dot "),
                                 (" at ", " punto "), ("(at)", ".")])
                s = name + a + d.join([site, *[_word(r) for _ in range(r.choice([0, 0, 0, 1, 2]))], r.choice(tld)])
                say = r.choice(["", "mail ", "contact ", "write to "])
            else:
                s = _word(r) + r.choice([" at ", " @ ", "(at) "]) + _word(r) + r.choice([". ", " . ", " dot ", " dots "]) + _word(r)
        elif kind == "ip":
            if good:
                parts = [f"{r.randrange(65536):x}" for _ in range(8)]
                if r.random() < 0.6:  # noughts left out
                    k = r.randint(0, 5)
                    parts = [r.choice(["2001", "2a02", "fe80", "fd00", *parts[:1]]), *parts[1:k], "", *parts[7 - r.randint(0, 6 - k):]]
                s = ":".join(parts) if parts[-1] else "::1"
                say = r.choice(["", "from ", "ip ", "host "])
                if not is_ipv6(s):
                    continue
            else:
                s = r.choice([":".join(_number(r, 2) for _ in range(r.randint(4, 6))), ":".join(_number(r, 1) for _ in range(4)),
                              f"{r.choice('abcdef')}::{r.choice('abcdef')}", "::" + r.choice(["add", "b", "c", "dead", "fade"]),
                              r.choice(["ab", "bad", "face", "c", "dec"]) + "::"])
                say = r.choice(["", "at ", "call ", "std "])
        elif kind == "card":
            if good:
                c, sep = _card(r, r.random() < 0.2), r.choice([".", "_", "/", "  ", " - ", "\u2013", "\xa0", "\u202f", "\u2011"] + ["", "", " ", "-"] * beside)
                cuts = [0, 4, 10, 15] if len(c) == 15 and r.random() < 0.7 else range(0, len(c) + 3, 4)
                s = sep.join(c[i:j] for i, j in zip(cuts, [*cuts][1:], strict=False) if c[i:j])
                say = r.choice(["", "card ", "visa ", "paid by credit card "])
            else:
                s = r.choice([_number(r, r.randint(13, 19)), f"{_number(r, 3)}.{_number(r, 3)}.{_number(r, 3)}.{_number(r, 4)}",
                              ", ".join(_number(r, 2) for _ in range(8)), f"978-{_number(r, 1)}-{_number(r, 4)}-{_number(r, 4)}-{_number(r, 1)}"])
                say = r.choice(["", "order ", "isbn ", "id "])
                if luhn(digits_of(s)):
                    continue
        else:
            if good:
                s = _phone(r, beside)
                # a form that is hardly anything else needs no cue
                sizes = [len(x) for x in re.findall("[0-9]+", s)]
                bare = sizes[-3:] == [3, 3, 4] or s[0] == "0" and len(sizes) > 3
                say = r.choice(CALLS) if not bare or r.random() < 0.4 else ""
                if r.random() < 0.1:
                    s, say = _number(r, r.randint(9, 11)), r.choice(["tel", "Tel:", "phone", "fax", "call ", "phone: "])
            else:
                s = r.choice([_number(r, r.randint(7, 15)), f"20{_number(r, 2)}-{_number(r, 2)}-{_number(r, 2)}", f"{_number(r, 2)}.{_number(r, 2)}.{_number(r, 4)}",
                              f"{_number(r, 3)},{_number(r, 3)},{_number(r, 3)}", ", ".join(_number(r, 2) for _ in range(4)),
                              f"{_number(r, 3)}-{_number(r, 3)}-{_number(r, 4)}", f"{_number(r, 1)}.{_number(r, 1)}.{_number(r, 5)}",
                              " ".join(str(r.randint(10, 99)) for _ in range(r.randint(4, 7))), f"{r.randint(1, 9)} {_number(r, 3)} {_number(r, 3)}",
                              f"{r.randint(1, 99)} {_number(r, 3)} {_number(r, 3)} {_number(r, 3)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{_number(r, 2)}",
                              f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{_number(r, 3)}.{_number(r, 3)}.{_number(r, 3)}",
                              f"{r.randint(0, 3)}.{_number(r, r.randint(7, 12))}", " ".join(str(r.randint(1, 9) * 100) for _ in range(3)),
                              f"{_number(r, 5)}-{_number(r, 4)}", f"{_number(r, 2)}/{_number(r, 2)}/{_number(r, 4)} {_number(r, 2)}"])
                say = r.choice(["", "order ", "invoice ", "version ", "total ", "page ", "part no ", "id ", "population ", "isbn ", "account ", "ref ", "= ", "of "])
                if [len(x) for x in re.findall("[0-9]+", s)] == [3, 3, 4]:
                    say = r.choice(["order ", "part no ", "ref ", "serial ", "model "])  # without a cue it is a telephone number
        before, after, other = "", "", []
        if beside and kind in ("card", "phone"):
            where = r.choice(["before", "after", "both"])
            if where != "after":
                before = _plain_number(r) + r.choice(BESIDE)
            if where != "before":
                after = r.choice(BESIDE)
                if good and r.random() < 0.6:  # a second one, written alike or not
                    t = _card(r) if kind == "card" else _phone(r, True)
                    if kind == "card" and r.random() < 0.7:
                        t = sep.join([t[:4], t[4:8], t[8:12], t[12:]])
                    other = [(len(after), len(after) + len(t))]
                    after += t
                else:
                    after += _plain_number(r)
        left = " ".join(_word(r) for _ in range(r.randint(0, 6)))
        left = (left + " " if left else "") + (say + before if r.random() < 0.5 else before + say)
        a, b = len(left), len(left) + len(s)
        text = left + s + after + " " + " ".join(_word(r) for _ in range(r.randint(0, 5)))
        if good and kind in ("card", "phone") and not clear((kind, a, b), *union(base_spans(text))):
            continue  # the base patterns find it
        made += 1
        yield (kind, a, b), text, good, [(kind, a, b)] * good + [(kind, b + x, b + y) for x, y in other]


def labelled(rows: int = TRAIN_ROWS, seed: int = SEED) -> Iterator[tuple[str, str, int, int, bool]]:
    """Seeded labelled candidates: kind, text, start, end and whether it is personal data."""
    for (kind, a, b), text, good, _ in examples(rows, seed):
        yield kind, text, a, b, good


@functools.cache
def trained(rows: int = TRAIN_ROWS, precision: float = PRECISION, seed: int = SEED) -> dict[str, tuple[Boost, float]]:
    """A model and a calibrated threshold for each kind."""
    x: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    y: dict[str, list[float]] = {k: [] for k in KINDS}
    held: dict[str, list[bool]] = {k: [] for k in KINDS}
    for i, (span, text, _, true) in enumerate(examples(rows, seed)):
        taken = union(base_spans(text))
        for c in dict.fromkeys([span, *candidates(text)]):
            if c == span or clear(c, *taken):
                x[c[0]].append(features(text, c))
                y[c[0]].append(float(c in true))
                held[c[0]].append(i % 2 == 1)
    out = {}
    for kind in KINDS:
        rows_x, truth, test = np.array(x[kind]), np.array(y[kind]), np.array(held[kind])
        model = Boost().fit(rows_x[~test], truth[~test])
        out[kind] = model, max(0.5, calibrated_threshold(model.score(rows_x[test]), truth[test], precision))
    return out


def union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Sorted starts and ends of the disjoint stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def clear(c: Span, starts: list[int], ends: list[int]) -> bool:
    """Whether a span overlaps none of the stretches."""
    k = bisect_right(ends, c[1])
    return k == len(ends) or c[2] <= starts[k]


def all_spans(texts: list[str], models: dict[str, tuple[Boost, float]]) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text; the candidates of all texts are scored together, in blocks."""
    base = [base_spans(t) for t in texts]
    taken = [union(b) for b in base]
    added: list[list[Span]] = [[] for _ in texts]
    scored: list[tuple[float, int, Span]] = []
    waiting: dict[str, list[tuple[int, Span]]] = {k: [] for k in KINDS}

    def judge(kind: str) -> None:
        own = waiting[kind]
        if own:
            model, least = models[kind]
            s = model.score(np.array([features(texts[i], c) for i, c in own]))
            scored.extend((-float(p), i, c) for p, (i, c) in zip(s, own, strict=True) if p >= least)
            own.clear()

    for i, t in enumerate(texts):
        for c in candidates(t):
            if clear(c, *taken[i]):
                waiting[c[0]].append((i, c))
                if len(waiting[c[0]]) == SCORE_ROWS:
                    judge(c[0])
    for kind in KINDS:
        judge(kind)
    for _, i, c in sorted(scored, key=lambda x: (x[0], x[1], x[2][1], x[2])):
        starts, ends = taken[i]
        if clear(c, starts, ends):
            k = bisect_right(starts, c[1])
            starts.insert(k, c[1])
            ends.insert(k, c[2])
            added[i].append(c)
    return list(zip(base, added, strict=True))


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, base counts, base_sha256, spans and, if asked for, the redacted text of every row."""
    models = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for part in chunks([t or "" for t in b.column(1).to_pylist()]):
                for text, (base, added) in zip(part, all_spans(part, models.value), strict=True):
                    kinds = [k for k, _, _ in base]
                    row = [*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)]
                    rows.append(row + [redact(text, base + added)] * with_text)
            cols = list(zip(*rows, strict=True)) or [()] * (6 + with_text)
            types = [pa.int64()] * 4 + [pa.string()] * (2 + with_text)
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"][:7 + with_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, {SCHEMA}" + ", redacted string" * with_text)
