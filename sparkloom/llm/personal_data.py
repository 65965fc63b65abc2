"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

Two layers. The fixed patterns (email, ip, card, phone) give base spans, which always stay. On top, high-recall generators
propose overlapping candidates of looser form (spelled-out addresses in small letters or capitals, phones without a plus sign or with 00, in groups of any
size, national and account numbers, IPv6 with and without ::, cards in fours or as 4-6-5 with any separator); each gets format and context features, and gradient-boosted trees give the probability
that it is personal data. A kind's threshold is the least score whose precision on a calibration part, by an exact binomial
lower bound, is at least `precision`; a kind that proves none adds nothing. Of overlapping accepted candidates of a kind the
best stays; one that a base span of any kind overlaps is left out.

No table labels personal data, so the trees are trained on EXAMPLES labelled candidates that a seeded generator writes (as many
again for spelled-out addresses, which have trees of their own): values
that are valid by construction in neutral or telling context against look-alikes (versions, dates, order numbers, hashes, failing
checksums, prose with ' at ' before a full stop). Where the form alone can't tell, words before it do: nine digits in threes are a phone only beside a
word like 'call', and a number of a national id's form is none beside one like 'part' or 'model'. A spelled-out address is proposed with each end that its dots allow, and only the
whole address is a right example. The bound is that parameter; documents have no part in it.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans, and its digest is that of the empty
string. Every text is scanned whole, in time linear in its length; texts without a digit, an @ sign or a spelled-out one (' at ',
'[at]', '(at)') have nothing to find.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "national_id", "account")
BASE = KINDS[:4]
EXAMPLES, SEED, PRECISION = 9000, 11, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(d: list[int]) -> bool:
    return (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [local]+@[label]+(.[label]+)+ from left to right, found from each @ sign: linear on any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


#: Generators by kind, looser than the base patterns.
GENERATORS = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?i:\[at\]|\(at\)| at ) ?([A-Za-z0-9-]{1,63})(?: ?(?i:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}\b")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}([ ._/-]?)[0-9]{6}\1[0-9]{4,5}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]?[0-9]{4}){2}[ ._/-]?[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}|\(?0[0-9]{1,4}\)?)(?:[ ./-][0-9]{1,8}){1,6}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])")),
    (5, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
)
_PART = re.compile(r" ?(?i:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}")
_MORE = re.compile(r"(?i:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[a-z0-9]")
#: Last labels and local parts that tell for and against a spelled-out address.
TOP = frozenset("com org net edu gov mil int info biz io dev app ai co me eu us uk de fr es it nl be ch at se no dk fi pl cz pt ie ru ua tr in cn jp kr tw hk sg au nz za br mx ar cl ca".split())
PROSE = frozenset("a an and are available be by call find for found from hosted i in is it look me meet met more of on online or page see shop site start that the them there they this to us visit was we were you".split())
#: Words before or after a candidate that tell for and against it.
FOR = ("phone", "tel", "call", "mobile", "fax", "mail", "contact", "card", "visa", "ssn", "social", "iban", "account", "address", "reach", "write")
AGAINST = ("version", "order", "invoice", "isbn", "ref", "page", "date", "serial", "hash", "build", "total", "ticket", "part", "tracking", "section", "figure", "item", "model", "sku", "lot", "catalog", "batch")
_AGAINST = re.compile(rf"(?<![a-z])(?:{'|'.join(AGAINST)})s?(?![a-z])")
_DATE = re.compile(r"[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]")


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses with each end that their dots allow; the search goes on in the domain, as 'me at jane.roe at
    example.com' holds two. Matches are bounded, so this is linear."""
    pattern = GENERATORS[0][1]
    m = pattern.search(text)
    while m:
        at = m.end(1)
        while part := _PART.match(text, at, m.end()):
            at = part.end()
            if text[at - 1] != "-":
                yield m.start(), at
        m = pattern.search(text, m.start(1))


def candidates(text: str) -> list[tuple[int, int, int]]:
    out = [(a, 0, b) for a, b in spelled(text)] if re.search(r"(?i: at |\[at\]|\(at\))", text) else []
    if re.search("[0-9]", text):
        out += {(m.start(), kind, m.end()) for kind, pattern in GENERATORS[1:] for m in pattern.finditer(text)}
    return sorted(out)


def _ipv6(s: str) -> bool:
    """Eight groups, or fewer with zeros left out once."""
    n = sum(1 for g in s.split(":") if g)
    return s.count("::") == 1 and ":::" not in s and 1 <= n < 8 or "::" not in s and n == 8


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidate_features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 30) : start].lower(), text[end : end + 20].lower()
    d = digits(s)
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    seps = re.findall("[^0-9A-Za-z]", s)
    near = before + " " + after
    area = int(s[:3]) if kind == 4 else -1
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(len(s)),
        float(len(d)),
        float(len(d) > 1 and luhn(d)),
        float(kind == 5 and _iban(s)),
        len(set(d)) / max(1, len(d)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(len(set(seps))),
        float("(" in s),
        float(area not in (0, 666) and 0 <= area < 900 and s[4:6] != "00" and s[-4:] != "0000"),
        float(len(s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1])),
        float(sum(c.isalpha() for c in s)) / len(s),
        float(sum(w in near for w in FOR)),
        float(len(_AGAINST.findall(near))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "#$%" and before != ""),
        float(re.search("[0-9][ ./_-]$", before) is not None),
        float(re.match("[ ./_-][0-9]", after) is not None),
        float(bool(groups) and 1900 <= int(str(re.findall("[0-9]+", s)[0])[:4] or 0) <= 2100),
        float(kind == 1 and _ipv6(s)),
        float("::" in s),
        float(s.count(":")),
        float(kind == 1 and max(map(len, s.split(":")))),
        float(s.startswith("00")),
        float(s.lstrip("(").startswith("0")),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(min(groups, default=0)),
        float(len(groups) == 5 and set(groups) == {2}),
        float(_DATE.fullmatch(s) is not None),
    ]


def address_features(text: str, span: tuple[int, int, int]) -> list[float]:
    s, after = text[span[0] : span[2]], text[span[2] : span[2] + 20].lower()
    local, last = re.match("[A-Za-z0-9._%+-]*", s)[0].lower(), re.findall("[A-Za-z0-9-]+", s)[-1]
    low = s.lower()
    return [
        *candidate_features(text, span),
        float("[at]" in low or "(at)" in low),
        float(sum(map(low.count, ("[dot]", "(dot)", " dot ")))),
        float(". " in s or " ." in s),
        float(last in TOP or last.lower() in TOP and last.isupper()),
        float(local in PROSE),
        float(re.search("[a-z0-9][._+-]?[0-9]|[a-z0-9][._+-][a-z0-9]", local) is not None),
        float(_MORE.match(after) is not None),
    ]


def examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in seeded sentences."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(3, 8)))

    def card(good: bool) -> str:
        sizes = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)])
        d = r.choice("3456") + num(sum(sizes) - 2)
        s = d + next(c for c in "0123456789" if luhn(digits(d + c)) == good)
        return r.choice([" ", "-", ".", "/", "_"] if len(sizes) == 4 else [" ", "-", "/", "_"]).join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    def iban(good: bool) -> str:
        c, b = r.choice(["DE", "FR", "ES", "GB"]), num(18)
        check = 98 - int("".join(str(int(x, 36)) for x in b + c + "00")) % 97
        s = c + f"{check if good else (check + r.randint(1, 90)) % 97:02d}" + b
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def short_v6() -> str:
        left, right = r.randint(1, 4), r.randint(0, 3)
        group = lambda: f"{r.choice([r.randrange(1, 16), r.randrange(1, 65536), r.randrange(4096, 65536)]):x}"
        return r.choice([f"2{num(3)}", "fe80", group()]) + "".join(":" + group() for _ in range(left - 1)) + "::" + ":".join(group() for _ in range(right))

    def grouped(seps: str, *sizes: int) -> str:
        return r.choice(seps).join(num(k) for k in sizes)

    national = lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    # by kind: forms, each with the words that stand before it: any, telling ones, none that tells, or words against it
    positive = (
        (0, (("any", lambda: f"{name()}.{name()} at {name()} dot {r.choice(['com', 'org', 'net', 'de', 'fr'])}"), ("any", lambda: f"{name()} [at] {name()}.{r.choice(['com', 'org', 'net', 'io'])}"))),
        (1, (("any", lambda: ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8))), ("any", short_v6))),
        (2, (("any", lambda: card(True)),)),
        (
            3,
            (
                ("any", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
                ("any", lambda: grouped("-. ", 3, 3, 4)),
                ("any", lambda: r.choice(" .").join([f"0{num(2)}", num(4), num(4)])),
                ("any", lambda: r.choice(" -").join([f"00{r.randint(1, 99)}", *r.choice([(num(2), num(7)), (num(3), num(4), num(4)), (num(1), num(3), num(4)), (num(1), num(2), num(2), num(2), num(2)), (num(3), num(6))])])),
                ("any", lambda: r.choice(".-").join([f"0{r.randint(1, 9)}", num(2), num(2), num(2), num(2)])),
                ("any", lambda: r.choice(" -").join([f"0{num(r.choice([2, 3]))}", num(r.choice([6, 7]))])),
                ("for", lambda: grouped(" .-", 3, 3, 3)),
                ("for", lambda: grouped(" .-", 3, 3, 3)),
            ),
        ),
        (4, (("any", national),)),
        (5, (("any", lambda: iban(True)),)),
    )
    negative = (
        (0, (("any", lambda: f"look at {name()} dot {name()} dot {name()}"),)),
        (
            1,
            (
                ("any", lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}:{r.randint(0, 29):02d}"),
                ("any", lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6))),
                ("any", lambda: "::".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(2))),
            ),
        ),
        (2, (("any", lambda: card(False)), ("any", lambda: next(s for s in iter(lambda: num(16), None) if not luhn(digits(s)))))),
        (
            3,
            (
                ("any", lambda: f"{r.randint(1990, 2030)}/{num(3)}/{num(4)}"),
                ("any", lambda: r.choice(".- ").join([str(r.randint(1900, 2030)), num(3), num(r.choice([3, 4]))])),
                ("any", lambda: f"{num(3)}/{num(3)}{num(3)}"),
                ("any", lambda: f"{num(2)}.{num(3)}.{num(3)}"),
                ("none", lambda: grouped(" .-/", 4, 4, 4)),
                ("none", lambda: str(r.randint(1, 9)) + grouped(" .-", 2, 3, 3)),
                ("against", lambda: grouped(" .-", 3, 3, r.choice([3, 4]))),
                ("any", lambda: r.choice(".-/ ").join([f"0{r.randint(1, 9)}", f"{r.randint(1, 12):02d}", str(r.randint(1900, 2030))])),
                ("none", lambda: grouped(" -", *[2] * r.choice([4, 6, 7, 8]))),
                ("none", lambda: " ".join(["00", *(num(2) for _ in range(r.randint(3, 5)))])),
            ),
        ),
        (4, (("any", lambda: f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}"), ("against", national))),
        (5, (("any", lambda: iban(False)),)),
    )
    x, y = [], []
    while len(x) < n:
        good = r.random() < 0.5
        own, forms = r.choices(positive if good else negative, (1, 1, 1, 3, 1, 1))[0]  # phones have the most forms
        context, form = r.choice(forms)
        value = form()
        if context == "any":
            word = r.choice(FOR if good else AGAINST) if r.random() < 0.3 else r.choice(FOR + AGAINST) if r.random() < 0.2 and own != 4 else name()
        else:
            word = r.choice({"for": FOR, "against": AGAINST, "none": AGAINST if r.random() < 0.2 else (name(),)}[context])
            word += r.choice(["", f" {name()}", " is", " no", " us on"]) if context != "none" else ""
        text = f"{name()} {name()} {word} {value}{r.choice(['', '.', ','])} {name()} {name()}"
        at = text.index(value)
        for span in sorted((m.start(), kind, m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)):
            if span[0] < at + len(value) and span[2] > at:
                # a candidate of another kind within a value, as digits of an account that look like a card, is no right one
                x.append(candidate_features(text, span))
                y.append(float(good and span[1] == own and span[0] <= at and span[2] >= at + len(value)))
    return np.array(x[:n]), np.array(y[:n])


def address_examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of spelled-out addresses and of prose that is generated as one; only a whole address is right."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(3, 8)))
    ends, common = tuple(sorted(TOP)), tuple(sorted(PROSE))

    def address() -> str:
        local = r.choice([lambda: f"{name()}{r.choice('._-+')}{name()}", lambda: name() + num(2), name])()
        at = r.choice([" at ", " at ", " [at] ", "[at]", " (at) ", "(at)"])
        dot = r.choice([".", ".", " dot ", " [dot] ", "[dot]", " (dot) ", "(dot)"])
        if r.random() < 0.25:
            at, dot = " AT ", r.choice([".", " DOT "])
        return local + at + dot.join([name() for _ in range(r.choice([1, 1, 1, 2]))] + r.choice([[r.choice(ends)], [r.choice(ends)], ["co", "uk"], [name()[: r.randint(2, 4)]]]))

    def prose() -> str:
        word = r.choice([name, lambda: r.choice(common)])()
        place = r.choice([name(), f"{r.choice(['the', 'a', 'this'])}", f"{r.randint(1, 12)}.{r.randint(10, 59)}"])
        return f"{word} at {place}. {r.choice([name, lambda: r.choice(common)])().capitalize()}"

    negative = (
        prose,
        lambda: f"{r.choice(common)} at {name()}.{r.choice(ends)}",
        lambda: f"{name()} at {name()}.{r.choice(['py', 'txt', 'html', 'pdf', name()])}",
        lambda: f"{name()} at {name()}.{r.choice(ends)}",
    )
    x, y = [], []
    while len(x) < n:
        good = r.random() < 0.5
        value = (address if good else r.choice(negative))()
        word = r.choice(FOR if good else AGAINST) if r.random() < 0.6 else r.choice(FOR + AGAINST) if r.random() < 0.2 else name()
        lead = f"{name()} {name()} {word} {r.choice(['me at ', 'us at ', '', '', '', '', '', ''])}"
        text = f"{lead}{value}{r.choice(['', '.', ','])} {r.choice([name, lambda: name().capitalize()])()} {name()}"
        whole = len(lead), len(lead) + len(value)
        for a, b in spelled(text):
            if a < whole[1] and b > whole[0]:
                x.append(address_features(text, (a, 0, b)))
                y.append(float(good and (a, b) == whole))
    return np.array(x[:n]), np.array(y[:n])


class Trees:
    """Gradient boosting on the logistic loss with Newton leaves; splits over at most 32 cuts a feature."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.2) -> None:
        self.trees, self.depth, self.rate = trees, depth, rate
        self.nodes: list[list[tuple[int, float, float]]] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.prior = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score = np.full(len(y), self.prior)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1], method="lower")) for f in range(x.shape[1])]
        bins = [np.searchsorted(edges, x[:, f]) for f, edges in enumerate(cuts)]  # bin i: up to cut i, and above the one before
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            where = np.zeros(len(y), np.int64)
            for node in range(len(tree)):
                rows = np.flatnonzero(where == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, 0.0)
                if node < 2**self.depth - 1:
                    for f, edges in enumerate(cuts):
                        gl = np.cumsum(np.bincount(bins[f][rows], g[rows], len(edges) + 1))[:-1]
                        hl = np.cumsum(np.bincount(bins[f][rows], h[rows], len(edges) + 1))[:-1]
                        gain = np.where(np.minimum(hl, hs - hl) < 1, 0, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1))
                        c = int(gain.argmax())
                        if gain[c] > best[0]:
                            best = (float(gain[c]), f, float(edges[c]))
                tree[node] = (best[1], best[2], self.rate * gs / (hs + 1))
                if best[1] >= 0:
                    where[rows] = np.where(x[rows, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
            self.nodes.append(tree)
            score += self._of(tree, x)
        return self

    @staticmethod
    def _of(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(v) for v in zip(*tree, strict=True))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            go = np.flatnonzero(inner)
            at[go] = np.where(x[go, feature[at[go]]] <= cut[at[go]], 2 * at[go] + 1, 2 * at[go] + 2)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for tree in self.nodes:
            total += self._of(tree, x)
        return 1 / (1 + np.exp(-total))


def lower_bound(good: int, n: int, error: float = 0.05) -> float:
    """Exact (Clopper and Pearson) lower bound of a share, by bisection on the binomial tail."""
    if good == 0:
        return 0.0
    tail = lambda p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(good, n + 1))
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(min(max(mid, 1e-12), 1 - 1e-12)) < error else (lo, mid)
    return lo


@functools.lru_cache(2)
def trained(n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> tuple[tuple[Trees, Trees], tuple[float, ...]]:
    """Trees for spelled-out addresses and for the other kinds, each from two thirds of their examples, and each kind's threshold
    from the rest."""
    models, limits = [], []
    for (x, y), kinds in ((address_examples(n, seed), range(1)), (examples(n, seed), range(1, len(KINDS)))):
        part = np.arange(len(y)) % 3 == 0
        models.append(Trees().fit(x[~part], y[~part]))
        p = models[-1].predict(x[part])
        for kind in kinds:
            own = x[part][:, kind] == 1
            passing = [t for t in np.unique(np.round(p[own], 3)) if lower_bound(int(y[part][own][p[own] >= t].sum()), int((p[own] >= t).sum())) >= precision]
            limits.append(float(min(passing, default=2.0)))
    return (models[0], models[1]), tuple(limits)


def scores(text: str, own: list[tuple[int, int, int]], models: tuple[Trees, Trees]) -> list[float]:
    """Probabilities that the sorted candidates are personal data."""
    p = np.zeros(len(own))
    for model, features, at in ((models[0], address_features, [i for i, c in enumerate(own) if c[1] == 0]), (models[1], candidate_features, [i for i, c in enumerate(own) if c[1]])):
        if at:
            p[at] = model.predict(np.array([features(text, own[i]) for i in at]))
    return p.tolist()


def spans_of(text: str, base: list[tuple[int, int, int]], models: tuple[Trees, Trees], limits: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """Base spans and accepted candidates (start, kind, end), sorted."""
    own = candidates(text)
    if not own:
        return base
    ends = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in ends]
    tops = list(np.maximum.accumulate([e for _, e in ends])) if ends else []

    def meets(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b))
        return i > 0 and tops[i - 1] > a

    own = [c for c in own if not meets(c[0], c[2])]
    if not own:
        return base
    p = scores(text, own, models)
    good = sorted(((x, c) for x, c in zip(p, own, strict=True) if x >= limits[c[1]]), key=lambda v: (-v[0], v[1]))
    taken: dict[int, list[tuple[int, int]]] = {}
    out = list(base)
    for _, (a, kind, b) in good:
        held = taken.setdefault(kind, [])  # apart from one another, so in order by start and by end
        i = bisect(held, (a, b))
        if (not i or held[i - 1][1] <= a) and (i == len(held) or b <= held[i][0]):
            held.insert(i, (a, b))
            out.append((a, kind, b))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def personal_data(docs: DataFrame, redact: bool = False, n_examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> DataFrame:
    """Per row: doc_id, base counts, base_sha256, spans (kind:start:end by start, then kind as listed, comma-joined), n_added; with
    `redact`, also redacted: the text with each span, overlapping ones as one, replaced by [KIND] of its first."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(n_examples, seed, precision))  # a few tens of kB
    schema = SCHEMA + ", redacted string" * redact

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = shared.value
        for part in parts:
            texts = part.column("text")
            cols: list[list] = [[] for _ in range(7 + redact)]
            for x in texts:
                text = x.as_py() or ""
                base = base_spans(text)
                spans = spans_of(text, base, models, limits)
                row = [*(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)]
                if redact:
                    out, at = [], 0
                    for a, k, b in spans:
                        if a >= at:
                            out += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = max(at, b)
                    row.append("".join([*out, text[at:]]))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), *[pa.string()] * redact]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [s.split()[0] for s in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
