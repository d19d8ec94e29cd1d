"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

Base spans are fixed by their patterns and checks and always stay. Beyond them, generators of high recall propose
spans that loosen a kind's format, overlapping ones of a kind too: from each group of digits, every end at a group's
end that gives a number of digits the kind may have. Boosted trees are trained on a bounded, seeded sample of the corpus,
drawn by kind and by whether a candidate is a base span: base spans, written in looser formats and beside other numbers,
are positive; candidates that overlap no base span, with base spans spoilt so that their checks fail, are negative, but
those that look like personal data by their format are left out. Chances are calibrated by isotonic regression on folds
that did not train, and a candidate is selected from a calibrated chance of ``PRECISION`` on. Of the selected
spans that overlap, the likeliest stays. Four numbers with commas between them are a list, not an address.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import checkpointed, column, drawn, id_and_text, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
#: Bound of the sample that trains, in base spans and in other candidates of each kind; characters of context; calibrated
#: chance from which a span is selected; folds; loose spans of each kind that teach, however few base spans they are made of.
MAX_TRAINING, CONTEXT, PRECISION, FOLDS, TAUGHT = 400, 24, 0.9, 4, 800
#: Common last labels of hosts.
TOP_LABELS = frozenset("""com org net edu gov mil int info biz io ai co me tv app dev uk us eu de fr it es nl be ch at pl se no dk fi cz ru ua
cn jp kr in br mx ar au nz ca za ie pt gr tr il sg hk""".split())
#: Characters that an address may have (64, @ and 255); longer strings are no loose addresses and don't teach.
MAX_SPAN = 320

#: The base patterns. Those of ip and email are written so that long runs of digits or letters are read
#: once: a match can only start where a run of digits does, and an email is what stands around its @ sign.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL, _HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOT = r"(?:\s{0,2}[\[({]\s{0,2}dot\s{0,2}[\])}]\s{0,2}|\s{1,2}dot\s{1,2}|\.)"
_LOOSE = {
    "ip": re.compile(r"[0-9]{1,3}(?:\s?[.,_]\s?[0-9]{1,3}|\s?[\[(]\.[\])]\s?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\s./_-]{0,2}[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+\s?|\b00)?\(?[0-9][0-9]{0,3}\)?(?:[\s./-]{0,2}\(?[0-9]{2,4}\)?){2,5}"),
}
#: Groups of digits, what may stand between those of a card or phone, and the least and most digits and groups of each.
_GROUP, _BETWEEN = re.compile("[0-9]+"), {"card": re.compile(r"[\s./_-]{1,2}"), "phone": re.compile(r"\)?[\s./-]{0,2}\(?")}
_BOUNDS = {"card": (13, 19, 19), "phone": (7, 15, 6)}
_PLUS, _BESIDE = re.compile(r"(?:\+\s?)?\(?\Z"), (re.compile(r"[0-9][\s./_-]{1,2}\Z"), re.compile(r"[\s./_-]{1,2}[0-9]"))
_FOUR = re.compile(rf"(?<![0-9])(?=({_LOOSE['ip'].pattern})(?![0-9]))")
#: What stands for an @ sign, and a host's labels after it.
_SIGN, _HOST_START, _LABEL = re.compile(r"@|[\[({]\s{0,2}at\s{0,2}[\])}]|(?<=\s)at(?=\s)", re.I), re.compile(r"\s{0,2}([A-Za-z0-9-]+)"), re.compile(rf"{_DOT}[A-Za-z0-9-]+", re.I)
_CUES = {
    "email": re.compile(r"mail|contact|write|address", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|payment|mastercard", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|contact", re.I),
}
_OTHER = re.compile(r"token|version|password|key|id\s*[:=]|order|page|isbn|licen[cs]e|released|section", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _alone(kind: str, body: str) -> bool:
    return kind != "email" and BASE[kind].fullmatch(body) is not None and _valid(kind, body)


def _emails(text: str) -> Iterator[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from left to right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind that pass its check, by kind and start."""
    need = {"phone": "+" in text}
    need["ip"] = need["card"] = any(d in text for d in "0123456789")
    rest = [(kind, m.start(), m.end()) for kind in KINDS[1:] if need[kind] for m in BASE[kind].finditer(text) if _valid(kind, m.group())]
    return [*_emails(text), *rest]


def _grouped(text: str) -> Iterator[Span]:
    """Cards and phones from each group of digits to each end of a group within the bounds of the kind."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for kind, (least, most, most_groups) in _BOUNDS.items():
        between = _BETWEEN[kind]
        joined = [a < c <= a + 4 and between.fullmatch(text, a, c) is not None for (_, a), (c, _) in zip(groups, groups[1:])]
        for i, (start, end) in enumerate(groups):
            n = end - start
            if n > most:
                continue
            if kind == "phone":
                start = _PLUS.search(text, max(0, start - 3), start).start()
            for k in range(i, min(i + most_groups, len(groups))):
                if k > i:
                    n += groups[k][1] - groups[k][0]
                    if not joined[k - 1] or n > most:
                        break
                    end = groups[k][1]
                if n >= least:
                    closes = kind == "phone" and text[end : end + 1] == ")" and text.count("(", start, end) > text.count(")", start, end)
                    yield kind, start, end + closes


def _addresses(text: str) -> Iterator[Span]:
    """Around each sign for an @: the letters before, and a host of two labels or more to each of its ends."""
    for sign in _SIGN.finditer(text):
        end = sign.start()
        while end > 0 and sign.start() - end < 2 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and end - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST_START.match(text, sign.end()) if start < end else None
        at = host.end() if host else 0
        while host and at - start <= MAX_SPAN and (label := _LABEL.match(text, at)):
            at = label.end()
            yield "email", start, at


def candidates(text: str) -> list[Span]:
    """Spans that the generators propose, whatever they overlap: also one another within a kind."""
    found: dict[Span, None] = {}
    if any(d in text for d in "0123456789"):
        found.update(dict.fromkeys((kind, m.start(), m.end()) for kind in KINDS[1:] for m in _LOOSE[kind].finditer(text)))
        found.update(dict.fromkeys(("ip", *m.span(1)) for m in _FOUR.finditer(text)))
        found.update(dict.fromkeys(_grouped(text)))
    found.update(dict.fromkeys(_addresses(text)))
    return list(found)


def likely(kind: str, before: str, body: str) -> bool:
    """Whether a candidate looks like personal data by its format alone, so that it can't teach what is none."""
    digits = _digits(body)
    if kind == "email":
        return "@" in body or bool(re.search(r"[\[({]\s*(?:at|dot)", body, re.I)) or re.split(r"\sdot\s+", body.lower())[-1] in TOP_LABELS
    if kind == "ip":
        return "," not in body and all(int(g) <= 255 for g in re.findall("[0-9]+", body))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    shaped = body[0] in "+(" or digits[:2] == "00" or [len(g) for g in re.findall("[0-9]+", body)] == [3, 3, 4]
    return 9 <= len(digits) <= 15 and (shaped or bool(_CUES[kind].search(before)))


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    glued = (before[-1:].isalnum() or before[-1:] in ("-", "_", "=", "/")) + 0.0
    context = [
        float(KINDS.index(kind)), glued, float(after[:1].isalnum()), float(bool(_CUES[kind].search(before))), float(bool(_OTHER.search(before))),
        float(bool(_BESIDE[0].search(before))), float(bool(_BESIDE[1].match(after))),
    ]
    if kind == "email":
        sign = _SIGN.search(body)
        host = body[sign.end() :]
        dots = len(re.findall(r"\S\.\S", host)), len(re.findall(r"[\[({]\s*dot", host, re.I)), len(re.findall(r"\sdot\s", host, re.I))
        written = 0.0 if "@" in sign.group() else 1.0 if sign.group()[0] in "[({" else 2.0
        last, more = re.split(r"[^A-Za-z0-9-]+", body)[-1].lower(), re.match(rf"{_DOT}[A-Za-z]", text[end : end + CONTEXT], re.I)
        return context + [written, float(body[sign.start() - 1].isspace()), *map(float, dots), float(last in TOP_LABELS), float(last.isalpha() and 2 <= len(last) <= 6), float(more is not None)] + [0.0] * 13
    groups = [g for g in re.split(r"[^0-9]+", body) if g]
    between = re.findall(r"[^0-9]+", body.lstrip("+(").rstrip(")"))
    digits, seps = "".join(groups), {c for c in body if not c.isalnum()}
    return context + [0.0] * 8 + [
        float(len(digits)), float(len(groups)), float(max(map(len, groups))), float(len(groups[0])), float(len(groups[-1])),
        float(body[:1] == "+") + 2.0 * (digits[:2] == "00" and digits[:3] != "000"), float("(" in body and ")" in body), float(len(seps)),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)),
        float("." in seps) + 2.0 * ("," in seps), float("\n" in body), float(len(set(between))),
    ]


class _Taken:
    """Stretches of a text, disjoint and in order."""

    def __init__(self, spans: list[Span] = ()):
        self.at: list[tuple[int, int]] = []
        for start, end in sorted(s[1:] for s in spans):
            if self.at and start < self.at[-1][1]:
                self.at[-1] = (self.at[-1][0], max(end, self.at[-1][1]))
            else:
                self.at.append((start, end))

    def overlaps(self, span: Span) -> bool:
        i = bisect_left(self.at, (span[2], -1))
        return i > 0 and self.at[i - 1][1] > span[1]

    def add(self, span: Span) -> None:
        insort(self.at, span[1:])


def _free(text: str, base: list[Span]) -> list[Span]:
    taken = _Taken(base)
    return [c for c in candidates(text) if not taken.overlaps(c)]


def _likeliest(chance: np.ndarray, spans: list[Span]) -> Iterator[int]:
    """Places of the spans that overlap no likelier one; of equal chances the first and longer comes first."""
    taken = _Taken()
    for i in sorted(range(len(spans)), key=lambda i: (-chance[i], spans[i][1], -spans[i][2], spans[i][0])):
        if not taken.overlaps(spans[i]):
            taken.add(spans[i])
            yield i


def _looser(kind: str, body: str, draw: random.Random) -> str:
    """A base span in a looser format of its kind."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    if kind == "email":
        at, dot = draw.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] ")])
        name, _, host = body.partition("@")
        name = draw.choice([name, re.sub("[0-9]", "", name), re.split("[^A-Za-z]", name)[0] + draw.choice(["", number(2)])])
        labels = draw.choice([host, ".".join(host.split(".")[-2:])]).split(".")
        host = ".".join([*labels[:-1], draw.choice([labels[-1], draw.choice(sorted(TOP_LABELS))])])
        return (name.strip(".-_") or "info") + at + host.replace(".", dot)
    if kind == "ip":
        private = draw.choice([body, body, f"10.0.{draw.randrange(3)}.{draw.randrange(256)}", f"192.168.{draw.randrange(2)}.{draw.randrange(256)}"])
        return private.replace(".", draw.choice([" . ", "[.]", "(.)"]))
    digits = _digits(body)
    if kind == "card":
        sep = draw.choice([".", "/", "_", "  ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    abroad = "00" + draw.choice([digits[:-10] or "1", str(draw.randrange(20, 99))])
    form = draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", abroad + " {} {} {}", abroad + " {} {}{}", abroad + "{} {}{}"])
    return form.format(last[:3] if draw.random() < 0.5 or not form.startswith("00") else last[:2], last[3:6], last[6:])


def _spoilt(kind: str, body: str, draw: random.Random) -> str:
    """A string of nearly the format of a kind that fails its checks."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, _, host = body.partition("@")
        word = re.sub("[^a-z]", "", name) or "look"
        return draw.choice(["{0} at the", "{0} @ the", "@{0} the", "{1} at {2}", "{1} at the dot on", "{1} at noon. Then", "{1} at one dot of"]).format(name[:6], word, draw.choice([host, ".".join(host.split(".")[-2:])]))
    if kind == "ip":
        return draw.choice([f"{draw.randrange(1, 20)}.{draw.randrange(30)}.{draw.randrange(300, 999)}.{draw.randrange(300, 999)}", f"{number(3)}, {number(3)}, {number(3)}, {number(3)}", ", ".join(str(draw.randrange(256)) for _ in range(4))])
    if kind == "card":
        digits = list(_digits(body) or number(16))
        digits[-1] = str((int(digits[-1]) + draw.randrange(1, 9)) % 10)
        return draw.choice(["", ".", "/", "-"]).join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    year = draw.randrange(1900, 2030)
    return draw.choice([f"{year}-{number(2)}-{number(2)}", f"{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{year}-{number(2)}-{number(2)} {number(2)}", f"{number(2)}.{number(4)} {number(2)}.{number(4)}", number(8), number(10), number(12), f"{number(4)}/{number(2)}/{number(2)}", f"{number(2)}.{number(3)}.{number(3)}", f"{number(3)} {number(3)} {number(3)} {number(3)}", f"{year}-{draw.randrange(1900, 2030)}"])


@dataclass
class SpanModel:
    """Trees, the kinds that could be learnt, and the knots that turn the trees' output into calibrated chances."""

    trees: BoostedTrees
    kinds: frozenset[str]
    knots: tuple[np.ndarray, np.ndarray] | None

    def chances(self, text: str, spans: list[Span]) -> np.ndarray:
        raw = self.trees.chance(np.array([features(text, c) for c in spans]))
        return np.interp(raw, *self.knots)

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that overlap neither a base span nor a likelier one."""
        free = [c for c in _free(text, base) if c[0] in self.kinds] if self.kinds else []
        if not free:
            return []
        chance = self.chances(text, free)
        good = np.flatnonzero(chance >= PRECISION).tolist()
        free = [free[i] for i in good]
        return [free[i] for i in _likeliest(chance[good], free)]


def _isotonic(chance: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step-wise fit of labels, with one negative more than there are."""
    order = np.argsort(chance, kind="stable")
    pools = [[0.0, 1.0, 0.0]]  # sum of chances, number, positives
    for p, y in zip(chance[order].tolist(), label[order].tolist()):
        pools.append([p, 1.0, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def train(sample: list[tuple[str, str, str, str, bool]], seed: int = 3) -> SpanModel:
    """A model from (kind, before, body, after, is base span) of sampled candidates."""
    draw = random.Random(seed)
    folds: list[list[list[tuple[list[float], int, Span]]]] = [[] for _ in range(FOLDS)]

    def add(fold: int, kind: str, before: str, body: str, after: str, label: int) -> None:
        text = before + body + after
        own = (kind, len(before), len(before) + len(body))
        near = [span for span in candidates(text) if span[1] < own[2] and own[1] < span[2]]
        # a span that would be a base span if it stood alone is no negative, nor one that looks like one beside none known
        body_of = lambda span: text[span[1] : span[2]]
        doubtful = lambda span: _alone(span[0], body_of(span)) or not label and span != own and likely(span[0], text[: span[1]], body_of(span))
        found = [(features(text, span), int(label and span == own), span) for span in near if label and span == own or not doubtful(span)]
        if found:
            folds[fold].append(found)

    sample = sorted(sample)
    for kind in KINDS:
        base = [row[1:4] for row in sample if row[0] == kind and row[4]]
        for i in range(TAUGHT if base else 0):
            fold, (before, body, after) = i % len(base) % FOLDS, base[i % len(base)]  # a base span is in one fold only
            add(fold, kind, before, _looser(kind, body, draw), after, 1)
            add(fold, kind, before, _spoilt(kind, body, draw), after, 0)
            for left in (True, False) if kind != "email" else ():
                crowded = body if kind == "card" or draw.random() < 0.5 else _looser(kind, body, draw)
                number = "".join(draw.choice("0123456789") for _ in range(draw.choice([16, 16, 4, 3]) if kind == "card" else draw.randrange(1, 6)))
                if kind == "phone" and draw.random() < 0.5:
                    number = ".".join(str(draw.randrange(1, 256)) for _ in range(4))
                add(fold, kind, *((before + number + " ", crowded, after) if left else (before, crowded, " " + number + after)), 1)
    for i, (kind, before, body, after, is_base) in enumerate(sample):
        if not is_base and not likely(kind, before, body):
            add(i % FOLDS, kind, before, body, after, 0)
    rows = [found for fold in folds for found in fold]
    if len({label for found in rows for _, label, _ in found}) < 2:
        return SpanModel(BoostedTrees(), frozenset(), None)
    fit = lambda some: BoostedTrees().fit(np.array([r[0] for found in some for r in found]), np.array([r[1] for found in some for r in found], float))
    held: list[tuple[float, int]] = []
    for rest in folds:
        others = [found for fold in folds if fold is not rest for found in fold]
        if not rest or not others:
            continue
        chances = fit(others).chance(np.array([r[0] for found in rest for r in found]))
        for found in rest:
            own, chances = chances[: len(found)], chances[len(found) :]
            held += [(float(own[i]), found[i][1]) for i in _likeliest(own, [r[2] for r in found])]
    kinds = frozenset(span[0] for found in rows for _, label, span in found if label)
    return SpanModel(fit(rows), kinds, _isotonic(np.array([c for c, _ in held]), np.array([y for _, y in held], float)))


def fit_spans(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_training: int = MAX_TRAINING) -> SpanModel:
    """Train on candidates of the smallest seeded hash, over all documents; only they reach the driver.

    At most ``max_training`` base spans and as many other candidates of each kind are drawn. A kind without a base span
    in the corpus can't be learnt, and none of its spans is added.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts(batch)):
                if not text:
                    continue
                base = base_spans(text)
                spans = [(s, True) for s in base] + [(c, False) for c in _free(text, base)]
                for (kind, start, end), is_base in spans:
                    if end - start <= MAX_SPAN:
                        body = text[start:end]
                        key = f"{doc_id}:{start}:{end}:{kind}".encode()
                        out.append((int.from_bytes(hashlib.blake2b(key, digest_size=7).digest(), "big"), kind, text[max(0, start - CONTEXT) : start], body, text[end : end + CONTEXT], is_base))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["draw", "kind", "before", "body", "after", "is_base"])

    rows = checkpointed(id_and_text(docs, id_col, text_col).mapInArrow(work, "draw bigint, kind string, before string, body string, after string, is_base boolean"))
    counts = {(r["kind"], r["is_base"]): r["count"] for r in rows.groupBy("kind", "is_base").count().collect()}
    sample = []
    for (kind, is_base), n in sorted(counts.items()):
        some = rows.where((F.col("kind") == kind) & (F.col("is_base") == is_base))
        sample += drawn(some, "draw", max_training, n, 0, 2**56 - 1).collect()
    return train([tuple(r)[1:] for r in sample])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_training: int = MAX_TRAINING) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of each whole text.

    Counts and digest are of the base spans; ``spans`` has all, as kind:start:end in code points. Null and empty
    texts have none (the digest is that of the empty string). Equal chances go to the span that starts first, then
    the longer. Repeated rows get equal results; an empty table gives an empty result, with no model needed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_spans(docs, text_col=text_col, id_col=id_col, max_training=max_training))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in texts(batch):
                base: list[Span] = []
                more: list[Span] = []
                if text:
                    base = base_spans(text)
                    more = model.select(text, base)
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(base + more))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans)],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return id_and_text(docs, id_col, text_col).mapInArrow(work, schema)
