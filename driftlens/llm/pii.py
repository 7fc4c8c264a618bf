"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans, which always stay. The field then looks at
the text that they left uncovered. Candidate segments come from a lattice: of
runs of digit groups with a few separators between them every segment of whole
groups, and round every sign or word for "at" every address, from each start of
its local part to each end of its domain. What a segment looks like (its groups,
separators, check sum, the shape of its kind, the words before it) only makes
features of the whole span, and dynamic programming over all candidates chooses
boundaries and kinds together. Text outside of segments scores zero. So the field
finds what the patterns can't: numbers that run into each other, addresses
written out, phone numbers without a plus sign.

Entities are bounded by what they are, not by characters: a phone number has 7
to 15 digits and a card 12 to 19, an IP address four groups with dots between
them, a domain at most 127 labels, and a local part with written dots at most 64
characters (without them it may have any length). Separators between digit groups
are at most three of space, full stop, hyphen, slash, plus and parentheses.

Weights come from maximum likelihood on generated sentences with marked spans;
the partition function is the forward sum over all segmentations.

Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches without trying each digit of a long number.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DIGITS = re.compile(r"[0-9]+")
_WRITTEN = ("(at)", "[at]", " at ")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def valid(kind: str, span: str) -> bool:
    """Whether what a base pattern matched is a base span."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    digits = _NOT_DIGIT.sub("", span)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in PATTERNS.items():
        if kind == "email":
            found = _emails(text) if "@" in text else ()
        elif kind == "ip":
            found = _IP.finditer(text) if "." in text else ()
        elif kind == "phone" and "+" not in text:
            found = ()
        else:
            found = pattern.finditer(text)
        out += [(m.start(), m.end(), kind) for m in found if valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _emails(text: str):
    """The email pattern's matches, tried only at the runs before an at-sign: elsewhere it can't begin.

    Other starts would each scan a run to its end, which costs the square of its length.
    """
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = PATTERNS["email"].match(text, lo) if lo < at else None
        if m:
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words that announce a kind.
CUES = {
    "phone": frozenset("tel phone telephone call fax mobile cell telefon téléphone teléfono móvil handy ring".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta cc".split()),
    "email": frozenset("mail email contact write correo courriel".split()),
    "ip": frozenset("ip host server address addr node client".split()),
    "none": frozenset("version order ref id no nr isbn token key invoice since year page born sku lot build".split()),
}
#: What a whole number usually looks like.
SHAPES = {
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{12,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}"),
}
#: How many digits a number of a kind has.
SIZES = {"card": (12, 19), "phone": (7, 15)}
_WORD = re.compile(r"[^\W\d_]+")

#: A run of digit groups with at most three separators between two of them.
_RUN = re.compile(r"[0-9]+(?:[ .()/+-]{1,3}[0-9]+)*")
#: The parts of an address: its at-sign, then labels with dots between them.
_AT = re.compile(r"@|[(\[]at[)\]]| at(?= )")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r" ?(?:\.|[(\[]dot[)\]]| dot(?= )) ?")
_WRITTEN_DOT = re.compile(r" ?(?:[(\[]dot[)\]]|(?<= )dot) ?$")
_GOES_ON = re.compile(r" ?(?:[(\[]dot[)\]]| dot(?= )) ?[A-Za-z0-9]|\.[A-Za-z0-9]")
MOST_LABELS, MOST_LOCAL = 127, 64


#: Of numbers with more digit groups only how many digits and groups they have is a feature.
MANY = 8


class Weights(dict):
    """Weights by feature, and the (kind, digits) of numbers of many groups that don't score above zero."""

    def __init__(self, known: dict[str, float]):
        super().__init__(known)
        score = lambda kind, n: sum(known.get(f, 0.0) for f in _of_many(kind, n))
        self.hopeless = {(kind, n) for kind, (least, most) in SIZES.items() for n in range(least, most + 1) if score(kind, n) <= 0}


def _of_many(kind: str, digits: int) -> list[str]:
    return [f"{kind}:bias", f"{kind}:digits={digits}", f"{kind}:groups={MANY}"]


def numbers(text: str, lo: int, hi: int, hopeless: set | frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """Every segment of whole digit groups of text[lo:hi] with as many digits as a kind has.

    Those that are hopeless are left out, as decoding would leave them out.
    """
    out = []
    for m in _RUN.finditer(text, lo, hi):
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
        if lo and groups[0][0] == lo and text[lo - 1].isdigit():
            groups.pop(0)  # a base span has the rest of it
        if groups and groups[-1][1] == hi < len(text) and text[hi].isdigit():
            groups.pop()
        dots = [text[a[1] : b[0]] == "." for a, b in zip(groups, groups[1:], strict=False)]
        for i, (first, _) in enumerate(groups):
            starts = [first]
            while starts[-1] > lo and first - starts[-1] < 2 and text[starts[-1] - 1] in "+(":
                starts.append(starts[-1] - 1)
            n = 0
            for k in range(i, len(groups)):
                end = groups[k][1]
                n += end - groups[k][0]
                if n > 19:
                    break
                if k == i + 3 and all(dots[i:k]):
                    out.append((first, end, "ip"))
                for kind, (least, most) in SIZES.items():
                    if least <= n <= most and not (k - i >= MANY - 1 and (kind, n) in hopeless):
                        out += [(s, end, kind) for s in (starts if kind == "phone" else starts[:1])]
    return out


def addresses(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Every address of text[lo:hi]: from each start of its local part to the end of each label of its domain but the first."""
    out = []
    for m in _AT.finditer(text, lo, hi):
        at, last = m.end(), m.start()
        if last > lo and text[last - 1] == " ":
            last -= 1
        starts, stop = [], last
        while True:
            start = stop
            while start > lo and text[start - 1] in _LOCAL:
                start -= 1
            while start < stop and not (text[start].isalnum() or text[start] == "+"):
                start += 1
            if start == stop or starts and last - start > MOST_LOCAL:
                break
            starts.append(start)
            dot = _WRITTEN_DOT.search(text, max(lo, start - 7), start)
            if not dot:
                break
            stop = dot.start()
        if not starts:
            continue
        if text[m.start()] == " ":
            at += 1
        if text[at : at + 1] == " ":
            at += 1
        label = _LABEL.match(text, at, hi)
        for _ in range(MOST_LABELS - 1):
            dot = _DOT.match(text, label.end(), hi) if label else None
            label = _LABEL.match(text, dot.end(), hi) if dot else None
            if not label:
                break
            end = label.start() + len(label[0].rstrip("-"))
            if end > label.start():
                out += [(start, end, "email") for start in starts]
    return out


def candidates(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    return numbers(text, lo, hi) + addresses(text, lo, hi)


_STYLES = re.compile(r"@|[(\[](?:at|dot)[)\]]| ?(?<= )(?:at|dot)(?= ) ?| ?\. ?| ")


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Of the whole span and what stands beside it."""
    span = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    if kind == "email":
        at = _AT.search(span)
        local, domain = span[: at.start()], span[at.end() :]
        dots = {d.strip(" ") if d.strip(" ") in (".", "dot") and d == d.strip(" ") else f"_{d.strip(' ')}" for d in _STYLES.findall(domain.strip(" ")) if "." in d or "dot" in d}
        top = re.split(r"[^A-Za-z0-9-]", span)[-1]
        style = f"{at[0].strip(' ')}{'_' if span[at.start() - 1] == ' ' or at[0][0] == ' ' else ''}/{'|'.join(sorted(dots))}"
        out = ["bias", f"style={style}", f"top={top.isalpha()}{min(len(top), 5)}", f"lower={top.islower()}", f"local={min(len(local.strip()), 20) // 4}", f"written={bool(_STYLES.search(local.strip(' ')) and 'dot' in local)}", f"joined={_WRITTEN_DOT.search(before) is not None}", f"goes_on={_GOES_ON.match(text, end) is not None}"]
    else:
        groups = _DIGITS.findall(span)
        digits, sizes = "".join(groups), [len(g) for g in groups]
        if len(groups) >= MANY:
            return _of_many(kind, len(digits))
        seps = set(span) & set(" .-()+/")
        out = ["bias", f"digits={len(digits)}", f"groups={len(groups)}", f"seps={''.join(sorted(seps))}", f"shape={SHAPES[kind].fullmatch(span) is not None}", f"gaps={max((len(g) for g in _NOT_DIGITS.findall(span.strip('+('))), default=0)}", f"small={min(sizes)}", f"large={min(max(sizes), 9)}"]
        if kind == "card":
            check = luhn(digits)
            out += [f"luhn={check}", f"good={check and SHAPES[kind].fullmatch(span) is not None}", f"brand={digits[0] in '3456'}", f"equal={len(set(sizes[:-1])) <= 1}"]
        elif kind == "phone":
            out += [f"plus={span[0] == '+'}", f"paren={'(' in span}", f"balanced={span.count('(') == span.count(')')}", f"last={sizes[-1]}", f"luhn16={len(digits) >= 13 and luhn(digits)}", f"four={len(groups) > 1 and set(sizes) == {4}}", f"sizes={'-'.join(map(str, sizes)) if len(sizes) < 6 else ''}"]
        else:
            out.append(f"valid={valid('ip', span)}")
        out.append(f"more={_MORE.match(text, end) is not None}")
        out.append(f"less={_LESS.search(before) is not None}")
    out += [f"left={_side(before[-1:])}", f"right={_side(after[:1])}{'d' if after[1:2].isdigit() and not after[:1].isalnum() else ''}"]
    words = {w.lower() for w in _WORD.findall(before)[-3:]}
    out += [f"cue={k}" for k, known in CUES.items() if words & known] or ["cue=-"]
    return [f"{kind}:{f}" for f in out]


_NOT_DIGITS = re.compile(r"[^0-9]+")
#: Whether digits go on after a span, or end right before it.
_MORE, _LESS = re.compile(r"[ .()/+-]{1,3}[0-9]"), re.compile(r"[0-9][ .()/+-]{1,3}$")


def _side(c: str) -> str:
    return "^" if not c else "a" if c.isalpha() else "d" if c.isdigit() else "s" if c.isspace() else c if c in ".-+/#:=\"'" else "o"


def decode(text: str, found: list[tuple[int, int, str]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of candidates that don't overlap: Viterbi over their ends."""
    found = sorted(found, key=lambda s: (s[1], s[0], s[2]))
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # score, candidate taken, state before it
    ends = [-1]
    for k, (start, end, kind) in enumerate(found):
        score = sum(weights.get(f, 0.0) for f in features(text, start, end, kind))
        if score <= 0:
            continue
        lo = bisect.bisect_right(ends, start) - 1
        total = best[lo][0] + score
        if total > best[-1][0] + 1e-12:
            best.append((total, k, lo))
            ends.append(end)
    out, at = [], len(best) - 1
    while at > 0:
        _, k, before = best[at]
        out.append(found[k])
        at = before
    return out[::-1]


def _lattice(text: str, found, gold: set, known: dict[str, int]):
    """(number of cuts, rows by end, rows by start, all rows); a row has its cuts, its features and whether it is gold."""
    cuts = sorted({0, len(text), *(s[0] for s in found), *(s[1] for s in found)})
    at = {c: i for i, c in enumerate(cuts)}
    rows = [(at[s], at[e], np.array([known[f] for f in features(text, s, e, k) if f in known]), float((s, e, k) in gold)) for s, e, k in found]
    ends, starts = [[] for _ in cuts], [[] for _ in cuts]
    for i, (a, b, _, _) in enumerate(rows):
        ends[b].append(i)
        starts[a].append(i)
    return len(cuts), ends, starts, rows


def _likelihood(lattice, weights: np.ndarray) -> np.ndarray:
    """The gradient of the log likelihood: features of the gold segments less their expected ones."""
    n, ends, starts, rows = lattice
    score = [float(weights[f].sum()) for _, _, f, _ in rows]
    alpha, beta = [0.0] * n, [0.0] * n
    for j in range(1, n):
        alpha[j] = _log_sum([alpha[j - 1], *(alpha[rows[i][0]] + score[i] for i in ends[j])])
    for j in range(n - 2, -1, -1):
        beta[j] = _log_sum([beta[j + 1], *(beta[rows[i][1]] + score[i] for i in starts[j])])
    grad = np.zeros(len(weights))
    for (a, b, f, true), s in zip(rows, score, strict=True):
        np.add.at(grad, f, true - math.exp(min(0.0, alpha[a] + s + beta[b] - alpha[-1])))
    return grad


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum([math.exp(v - top) for v in x])) if len(x) > 1 else top


def generated(n: int, seed: int = 5) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Sentences with marked spans, and numbers that are nothing of the kind."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "ti", "es", "lo", "mi", "ra", "che")) for _ in range(r.randint(1, 4)))

    def card():
        body = r.choice("3456") + digits(r.choice((13, 14, 14, 14)))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(("", " ", "-"))
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep and len(full) == 16 else full

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(3)} {digits(7)}"))

    def email():
        user, host, top = f"{word()}{r.choice(('', '.', '_'))}{r.choice((digits(2), word()))}", word(), r.choice(("com", "org", "net", "fr", "info", "de", "io"))
        user = word() if r.random() < 0.3 else user
        domain = [host, *(word() for _ in range(r.choice((0, 0, 1, 2)))), top]
        at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", "."), (" @ ", ".")))
        if at.strip(" ") != "@" and r.random() < 0.3:  # written dots in the local part as well
            user = dot.join(word() for _ in range(r.randint(2, 3)))
        return user + at + dot.join(domain)

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def unchecked(k):
        """A number of k digits that fails the check of cards."""
        body = digits(k - 1)
        return body + r.choice([c for c in "0123456789" if not luhn(body + c)])

    def noise():
        return r.choice((
            f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"token = \"{hashlib.sha1(digits(9).encode()).hexdigest()}\"", f"order {digits(r.choice((10, 11, 13, 16)))}",
            f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{r.randint(8, 23)}:{digits(2)}:{digits(2)}", f"id {digits(9)}", f"{digits(3)} {digits(2)} {word()} {digits(3)}", f"key {digits(8)}-{digits(4)}-{digits(4)}", r.choice((" ", " ", "-", ". ")).join(digits(r.randint(1, r.choice((1, 2, 4)))) for _ in range(r.randint(4, 16))), f"version {r.randint(1, 9)}.{digits(2)}.{digits(1)}.{digits(2)}", f"ref {digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{word()} at {word()} dot",
            unchecked(16), unchecked(16), unchecked(r.choice((12, 13, 14, 15, 17, 18, 19))), f"{word()} at {word()}. {word().capitalize()} {word()}", f"{word()} at {word()}. {word().capitalize()}", f"{digits(14)} at {word()}. {word().capitalize()}", f"{word()} @ {word()}. {word().capitalize()}", f"{word()} dot {word()} at {word()} {word()}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{digits(1)}.{digits(5)} {digits(1)}.{digits(6)}", f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}:{digits(2)}:{digits(2)}.{digits(3)}", f"page {digits(2)}-{digits(3)}", f"{digits(r.randint(7, 12))}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(1)} {digits(3)} {digits(3)}", f"{digits(3)}/{digits(4)}/{digits(2)}",
        ))

    made = {"card": card, "phone": phone, "email": email, "ip": ip}
    out = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 3)))
            text += " " if text and not text.endswith(" ") else ""
            kind = r.choice((*KINDS, "none", "none"))
            if r.random() < 0.3:
                text += r.choice(sorted(CUES[kind])) + r.choice((" ", ": "))
            span = noise() if kind == "none" else made[kind]()
            if kind != "none":
                gold.add((len(text), len(text) + len(span), kind))
            text += span + r.choice((" ", " ", ". ", ", ", "\n"))
        out.append((text + word(), gold))
    return out


@functools.cache
def train(n: int = 1500, rounds: int = 6, rate: float = 0.3, l2: float = 2e-3) -> dict[str, float]:
    """Weights by AdaGrad on the log likelihood of generated sentences."""
    data = [(t, candidates(t, 0, len(t)), g) for t, g in generated(n)]
    names = sorted({f for t, found, _ in data for s in found for f in features(t, *s)})
    known = {f: i for i, f in enumerate(names)}
    lattices = [_lattice(t, found, gold, known) for t, found, gold in data if found]
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(rounds):
        for lattice in lattices:
            g = _likelihood(lattice, w) - l2 * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
    return Weights({f: float(w[i]) for f, i in known.items()})


def added_spans(text: str, base: list[tuple[int, int, str]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """What the field finds outside of base spans."""
    edges = _merged([(s, e) for s, e, _ in base])
    found: list[tuple[int, int, str]] = []
    written = "@" in text or any(w in text for w in _WRITTEN)
    for lo, hi in zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)], strict=True):
        found += numbers(text, lo, hi, getattr(weights, "hopeless", frozenset()))
        if written:
            found += addresses(text, lo, hi)
    return decode(text, found, weights) if found else []


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind."""
    if not _DIGITS.search(text) and "@" not in text and not any(w in text for w in _WRITTEN):
        return [], []
    base = base_spans(text)
    more = added_spans(text, base, weights)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _find(weights):
    def rows(given):
        w = weights.value
        for doc_id, text in given:
            base, spans = find(text, w)
            fixed = set(base)
            yield doc_id, [{"kind": k, "start": s, "end": e, "base": (s, e, k) in fixed} for s, e, k in spans]

    return rows


SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Returns doc_id and spans (kind, start, end, base), a row for each row of docs.

    Base spans of different kinds may overlap; those that the field adds overlap
    nothing. A null or empty text has no spans. Rows that repeat are searched
    each for itself; null ids stay null. Other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train())  # a few hundred numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.arrow_pass(texts, _find(weights), SPANS, 1024)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span, or run of spans that overlap, replaced by its first kind in brackets."""
    out, at = [], 0
    for lo, hi in _merged([(s, e) for s, e, _ in spans]):
        out += [text[at:lo], f"[{next(k for s, _, k in spans if s == lo)}]"]
        at = hi
    return "".join([*out, text[at:]])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
