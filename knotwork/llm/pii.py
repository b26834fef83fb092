"""Personal data by candidate boosting (operator 8).

Four base kinds have exact patterns and always count. Beyond them, generators with high recall propose
spans that may overlap (credentials, account numbers, national numbers, phone numbers without a plus,
spelled-out addresses, IPv6); boosted trees judge each by its format and what stands around it; a
threshold per kind, set on held-out candidates after Platt calibration, selects. Selected spans that
overlap a base span or a likelier one are dropped.

No labels of personal data exist to learn from. So spans of known kinds, harmful and harmless, made by rule
from a fixed seed (``examples``), are planted into the corpus' own text: at most ``CARRIERS`` rows, those with the least
hash of doc_id, of each at most ``CARRIER_CHARS`` characters, go to the driver; a third of them is for the trees, a third for
calibration and thresholds, the rest for tests. The model is a few kilobytes and goes with the task.

Scale: one pass over the texts, no exchange, some megabytes at a time. Patterns take time in proportion to the text, also on
one word of any length.

Defined cases: with fewer than ``LEAST`` rows to plant into, made words stand for them; null and empty texts have no span; ties between candidates go to the earlier, then longer
span; repeated rows give repeated results; other columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .boosting import Boosted
from .common import thinned, trim_driver
from .worker import give_back, held, pieces

#: Kinds in the order in which spans of one start are listed: the base ones, then the judged ones.
BASE = ("email", "ip", "card", "phone")
JUDGED = ("secret", "iban", "ssn", "phone_local", "email_spelled", "ip6")
KINDS = BASE + JUDGED
RANK = {k: i for i, k in enumerate(KINDS)}

Span = tuple[str, int, int]

_ANY = re.compile(r"[0-9@]|\bat\b|\[at\]|\(at\)")
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behinds only keep a long run of digits from being tried again from within
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the four base kinds, leftmost and non-overlapping within each kind."""
    found: list[Span] = []
    if "@" in text:
        n, end, back = len(text), 0, text[::-1]
        at = text.find("@")
        while at >= 0:
            start = max(end, at - (_LOCAL.match(back, n - at).end() - (n - at)))
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                end = m.end()
                found.append(("email", start, end))
            at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], RANK[s[0]]))


_PROPOSE = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16,}+(?![A-Za-z0-9_+/=.-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9.-])")),
    ("phone_local", re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9.-])")),
    ("email_spelled", re.compile(r"(?<!\S)[A-Za-z0-9._-]{2,40}\s?(?:\[at\]|\(at\)|\bat\b)\s?[A-Za-z0-9-]{2,40}(?:\s?(?:\[dot\]|\(dot\)|\bdot\b)\s?[A-Za-z]{2,12}){1,3}(?!\S)")),
    ("ip6", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:?){1,6}(?![0-9A-Fa-f:])")),
)

#: Fixed word list: what stands before personal data, by kind, and before harmless numbers.
CUES = {
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "credential", "bearer", "auth"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telephone", "cell"),
    "email_spelled": ("mail", "email", "contact", "write", "reach"),
    "ip6": ("ip", "ipv6", "address", "host", "server"),
    "harmless": ("order", "invoice", "version", "isbn", "page", "part", "article", "build", "commit", "sha", "checksum", "file", "model", "item", "ref", "http", "https", "www", "score", "time", "date", "years", "total"),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
#: Fixed word list: ends of host names.
ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
#: Rows that give text to plant into, characters of each, and the least number of them.
CARRIERS, CARRIER_CHARS, LEAST = 600, 2000, 60
_WORDS = re.compile(r"[A-Za-z]+")


def propose(text: str) -> list[Span]:
    """All candidate spans of the judged kinds; they may overlap."""
    return [(k, m.start(), m.end()) for k, p in _PROPOSE for m in p.finditer(text) if k == "email_spelled" or any("0" <= c <= "9" for c in m[0])]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings, as numbers."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 12]
    n, bare = len(s), before.rstrip(" \"'`([{<")
    count = Counter(s)
    d, up, low = (sum(v for c, v in count.items() if t(c)) for t in (lambda c: "0" <= c <= "9", str.isupper, str.islower))
    words = [w.lower() for w in _WORDS.findall(before)][-4:]
    cues = [_CUE.get(w) for w in words]
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    return [
        *(float(kind == k) for k in JUDGED),
        n, d / n, up / n, low / n, (n - d - up - low) / n,
        sum(v for c, v in count.items() if c in "0123456789abcdefABCDEF") / n,
        -sum(v / n * math.log2(v / n) for v in count.values()), switches / n, d,
        float(kind in cues), float("harmless" in cues), float(cues[-1:] == [kind]), float(cues[-1:] == ["harmless"]),
        float(bare[-1:] == "="), float(bare[-1:] == ":"), float(bare[-1:] in {"/", "#", "-", "_"}), float(before[-1:] in {'"', "'", "`"} and after[:1] in {'"', "'", "`"}),
        float(after[:1].isalnum()), float(kind == "iban" and _mod97(s)), s.count("."), s.count("-"), s.count(":"), s.count("/"), float("::" in s),
        float(kind == "email_spelled" and s.lower().endswith(ENDS)), float("at]" in s or "(at)" in s or "dot]" in s or "(dot)" in s),
        float(kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
    ]


def carriers(docs: DataFrame, rows: int = CARRIERS, chars: int = CARRIER_CHARS) -> tuple[str, ...]:
    """Text of the corpus to plant spans into: at most ``rows`` rows of ``chars`` characters; none where there are too few."""
    own = thinned(docs.select("doc_id", "text"), 4 * rows, "doc_id", "text")
    own = own.where(F.length("text") >= 100).select("doc_id", F.substring("text", 1, chars).alias("text"))
    got = own.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()
    return tuple(r["text"] for r in got) if len(got) >= LEAST else ()


def examples(seed: int, n: int = 2400, texts: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Candidates made by rule, half of them personal data, planted into ``texts`` or made words: features, labels, kinds."""
    r = random.Random(seed)
    own = [w for t in texts if len(w := t.split()) >= 10]
    pick, hexa, alnum = r.choice, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    many = lambda cs, k: "".join(pick(cs) for _ in range(k))
    num = lambda k: many("0123456789", k)

    def word() -> str:
        return "".join(pick(("th", "er", "an", "on", "ti", "es", "ou", "ing", "ble", "re")) for _ in range(r.randint(1, 3)))

    def iban(good: bool) -> str:
        body = num(r.randint(14, 20))
        country = many("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{(check if good else (check + r.randint(1, 80)) % 97):02d}{body}"

    local = lambda: pick((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}"))
    made = {
        "secret": (lambda: pick((many(hexa, pick((32, 40, 64))), many(alnum, r.randint(20, 44)), f"sk_{many(alnum, 24)}")), lambda: pick((f"{word()}-{word()}-{num(2)}-{word()}", f"{word()}.{word()}.{word()}/{num(3)}", f"{word()}_{num(4)}.{word()}.tar.gz", "=" * 12 + num(4), f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}.{num(2)}.{num(2)}", num(r.randint(16, 24)), many(hexa, 40)))),
        "iban": (lambda: iban(True), lambda: pick((iban(False), f"AB12{many(alnum[:26] + '0123456789', 14)}"))),
        "ssn": (lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: pick((f"000-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(3)} {num(2)} {num(4)}"))),
        "phone_local": (local, lambda: pick((f"{num(2)}/{num(3)}.{num(3)}", f"{num(4)} {num(4)} {num(3)}", f"20{num(2)} 20{num(2)}", f"{num(3)}.{num(3)}.{num(3)}"))),
        "email_spelled": (lambda: f"{word()}{pick((' at ', '[at]', ' (at) '))}{word()}{pick((' dot ', '[dot]'))}{pick(('com', 'org', 'net'))}", lambda: f"{word()} at {word()} dot {word()}"),
        "ip6": (lambda: ":".join(many(hexa, 4) for _ in range(8)), lambda: pick((f"{num(2)}:{num(2)}:{num(2)}", ":".join(many(hexa, 2) for _ in range(6))))),
    }
    x, y, kinds = [], [], []
    while len(y) < n:
        kind, good = pick(JUDGED), r.random() < 0.5
        s = made[kind][0 if good else 1]()
        cue = (r.random() < 0.7) if good or kind != "secret" else False
        lead = f"{pick(CUES[kind])}{pick((' ', ' = ', ': ', '='))}" if cue and (good or r.random() < 0.15) else f"{pick(CUES['harmless'])} " if not good and r.random() < 0.5 else ""
        q = '"' if kind == "secret" and r.random() < 0.5 else ""
        if good and kind in ("secret", "phone_local") and not lead:
            lead = f"{pick(CUES[kind])} = "
        if own:
            ws = pick(own)
            k = r.randrange(len(ws) - 8)
            left, right = " ".join(ws[k : k + 5]), " ".join(ws[k + 5 : k + 9])
        else:
            left, right = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(4))
        text = f"{left} {lead}{q}{s}{q} {right}"
        a = len(left) + 1 + len(lead) + len(q)
        if any(c == (kind, a, a + len(s)) for c in propose(text)):
            x.append(features(text, (kind, a, a + len(s))))
            y.append(float(good))
            kinds.append(kind)
    return np.array(x), np.array(y), kinds


#: Share of the selected candidates that has to be personal data, on the calibration candidates.
PRECISION = 0.97


@functools.lru_cache(maxsize=4)
def model(texts: tuple[str, ...] = ()) -> tuple[Boosted, dict[str, float]]:
    """The trees, calibrated, and each kind's threshold, from spans planted into two thirds of ``texts``."""
    trees = Boosted().fit(*examples(1, texts=texts[::3])[:2])
    x, y, kinds = examples(2, texts=texts[1::3])
    p = trees.calibrate(x, y).probability(x)
    cuts = {}
    for k in JUDGED:
        own = np.array([q == k for q in kinds])
        order = np.argsort(-p[own], kind="stable")
        right = y[own][order].cumsum() / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= PRECISION)
        cuts[k] = max(0.5, float(p[own][order][ok[-1]])) if len(ok) else 1.1
    give_back()
    return trees, cuts


def all_spans(text: str, trees: Boosted, cuts: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all selected spans: the base ones and those that the trees add."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    taken, found = sorted((a, b) for _, a, b in base), propose(text)
    found = [s for s in found if not any(a < s[2] and s[1] < b for a, b in _near(taken, s))]
    chosen = list(base)
    if found:
        p = trees.probability(np.array([features(text, s) for s in found]))
        import bisect

        for q, s in sorted(((q, s) for q, s in zip(p, found, strict=True) if q >= cuts[s[0]]), key=lambda x: (-round(x[0], 6), x[1][1], -x[1][2], RANK[x[1][0]])):
            if not any(a < s[2] and s[1] < b for a, b in _near(taken, s)):
                bisect.insort(taken, (s[1], s[2]))
                chosen.append(s)
    return base, sorted(chosen, key=lambda s: (s[1], RANK[s[0]], s[2]))


def _near(taken: list, s: Span) -> list:
    """Those of the sorted ``taken`` that can overlap ``s``: base kinds may overlap each other, so a few before count too."""
    import bisect

    return taken[max(0, bisect.bisect_left(taken, (s[1], 0)) - 4) : bisect.bisect_left(taken, (s[2], 0))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch that spans cover replaced by the first one's kind in brackets."""
    out, at, end = [], 0, -1
    for k, a, b in spans:
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"[{k.upper()}]"]
        at = end = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts, digest of the base spans, all spans, and how many they are."""
    ship(docs.sparkSession)
    trees, cuts = model(carriers(docs))
    trim_driver(docs.sparkSession)
    names = [f"n_{k}" for k in BASE]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces("pii", parts, "text"):
            counts, digests, spans, total = [], [], [], []
            for t in p.column("text").to_pylist():
                base, every = all_spans(t, trees, cuts) if t else ([], [])
                n = Counter(k for k, _, _ in base)
                counts.append([n[k] for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                total.append(len(every))
            own = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
            yield pa.record_batch([p.column("doc_id"), *own, pa.array(digests), pa.array(spans), pa.array(total, pa.int64())], ["doc_id", *names, "base_sha256", "spans", "n_spans"])

    kind = f"doc_id long, {', '.join(f'{c} long' for c in names)}, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, kind)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every selected span in ``text`` masked; all other columns as they were."""
    ship(docs.sparkSession)
    trees, cuts = model(carriers(docs))
    trim_driver(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("pii", None, bool)
        try:
            for p in parts:
                yield pa.array([masked(x, all_spans(x, trees, cuts)[1]) if (x := t.as_py()) else x for t in p], pa.string())
                del p
        finally:
            give_back()

    return docs.withColumn("text", clean("text"))
