"""Personal data: rules, high-recall candidate generators and gradient-boosted trees.

Four kinds have exact base rules (e-mail, IP address, card, phone). Generators propose overlapping spans which the rules miss: masked
e-mail addresses, phone numbers without a country code, cards with odd separators, IP addresses with masked dots or in hexadecimal
groups, and, as a fifth kind, secrets: values that are assigned to a password, token or key, and long words of mixed characters.
Boosted trees score each candidate from its format and its context, and thresholds calibrated on a held-out part select
those that are added. The trees learn from base spans of a bounded sample of documents, from rewritten forms of these spans in their
own context, from made-up secrets in such contexts, and, as negatives, from what the generators find elsewhere and from rewritten spans
that fail the checks. Only secrets that are assigned to a name of one, or have the form of an access key, teach as found.

Edge cases: a null text is the empty text and has no spans; rows are independent, so repeats and ties change nothing; every scan is
linear in the text, however long its runs of digits are; without training spans no thresholds exist and only base spans are returned.
"""

from __future__ import annotations

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
from pyspark.sql import types as T

from .boosting import BoostedTrees
from .common import bounded_sample, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans.
ALL_KINDS = (*KINDS, "secret")
SECRET = 4
SAMPLE_DOCS = 3000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = nxt = m.end()
        else:
            done = at + 1
        at = text.find("@", nxt)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four runs of digits with single dots between them; a run that begins no match can't begin one at a later digit, either."""
    runs = [m.span() for m in _RUN.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        broken = next((k for k in (2, 1, 0) if runs[i + k + 1][0] != runs[i + k][1] + 1 or text[runs[i + k][1]] != "."), None)
        if broken is not None:
            i += broken + 1
            continue
        if all(len(p := text[s:e].lstrip("0")) <= 3 and int(p or 0) <= 255 for s, e in runs[i : i + 4]):
            yield runs[i][0], runs[i + 3][1]
        i += 4


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    if not text:
        return []
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *s) for s in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


_NUMBER = re.compile(r"(?<![0-9A-Za-z+])[+(]?[0-9][0-9().\x20_/:\[\]-]{5,48}[0-9](?![0-9A-Za-z])")
_HEX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[\[({]\x20?at\x20?[\])}]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]\x20?(?:dot|\.)\x20?[\])}]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63})+", re.I)
_ANCHOR = re.compile(r"\bdot\b|\[\.\]|[\[({]\x20?at\x20?[\])}]", re.I)
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,256}(?![A-Za-z0-9+/_-])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\x20?[=:]\x20?[\"']?([^\s\"',;]{6,256})", re.I)
_ACCESS_KEY = re.compile(r"(?:AKIA|ASIA|ghp_|xox[bp]-|sk_live_)[A-Za-z0-9]{16,}")
_CONTEXT = (
    re.compile(r"tel|phone|call|mobil|fax|whats", re.I),
    re.compile(r"mail|contact|write", re.I),
    re.compile(r"card|visa|master|amex|credit|pay", re.I),
    re.compile(r"\bip\b|host|addr|server|ping", re.I),
    re.compile(r"version|\bv\.?$|release|license|isbn|\bno\.?$|#$", re.I),
    re.compile(r"passw|token|secret|key|hash|=\W*$", re.I),
)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals (kind, start, end) for the spans that base rules may miss."""
    out = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            groups = _RUN.findall(m[0])
            n = sum(map(len, groups))
            if n >= 13:
                out.append((2, *m.span()))
            if len(groups) == 4 and max(map(len, groups)) <= 3:
                out.append((1, *m.span()))
            if 7 <= n <= 15:
                out.append((3, *m.span()))
        out += [(1, *m.span()) for m in _HEX.finditer(text)] if ":" in text else []
    done = 0
    for a in _ANCHOR.finditer(text):
        for m in _MASKED.finditer(text, max(done, a.start() - 160), min(len(text), a.end() + 160)):
            out.append((0, *m.span()))
            done = m.end()
    assigned = {m.span(1) for m in _ASSIGNED.finditer(text)} if "=" in text or ":" in text else set()
    mixed = {m.span() for m in _LONG.finditer(text) if _DIGIT.search(m[0]) and any(map(str.isalpha, m[0]))}
    out += [(SECRET, *span) for span in sorted(assigned | mixed)]
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    return sum(-n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Of format and of context. The rules' own verdict is none of them."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    groups = _RUN.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    seps = [c for c in s if not c.isalnum()]
    return [
        *(float(kind == k) for k in range(5)), float(len(s)), float(len(digits)), len(digits) / max(len(s), 1), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(sizes[-1]),
        float(len(set(seps))), float(len(seps)), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count(":")), float("(" in s and ")" in s), float(s.startswith("+")), float(s.startswith("00")),
        float(bool(13 <= len(digits) <= 19 and luhn(digits))), float(max((int(g) for g in groups if len(g) < 10), default=-1)), float(len(set(digits))), float(sum(c.isalpha() for c in s)), float(bool(re.search(r"@|\bat\b", s, re.I))), float(bool(re.search(r"\bdot\b|\[\.\]", s, re.I))),
        float(before[-1:].isalnum()), float(before[-1:] in "=\"'#$/"), float(after[:1].isalnum()), float(after[:1] in "%$€/"), *(float(bool(c.search(before))) for c in _CONTEXT),
        entropy(s), len(_TURN.findall(s)) / len(s), float(sum(map(str.isupper, s))), float(bool(_NAMED.search(before))), float(bool(_ACCESS_KEY.fullmatch(s))),
    ]


#: Where letters and digits meet, and the name of a secret with its sign before the value.
_TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_NAMED = re.compile(r"(?:passw|pwd|secret|token|key|auth)[a-z_\"']*\x20?[=:]\x20?[\"']?$", re.I)


def overlaps(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for _, s, e in spans)


def _rewritten(rng: random.Random, kind: int, s: str) -> tuple[str, str]:
    """A form of a personal span that the rules miss, and one of the same looks that is none."""
    digits = "".join(_RUN.findall(s))
    if kind == 0:
        local, _, domain = s.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), ("[at]", "[.]"), (" [at] ", " [dot] "), ("@", "[.]")])
        words = rng.sample(["look", "stay", "here", "point", "line", "spot", "big", "red", "small"], 4)
        return local + at + domain.replace(".", dot), f"{words[0]} at {words[1]} dot {words[2]} {words[3]}"
    if kind == 1:
        parts = s.split(".")
        mark = rng.choice(["[.]", " . ", "(.)"])
        return mark.join(parts), ".".join(str(int(p) + rng.choice([256, 300, 700])) for p in parts)
    if kind == 2:
        mark = rng.choice([".", "_", "/", "  "])
        bad = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)), rng.choice([bad, "".join(rng.choice("0123456789") for _ in digits)])
    tail = digits[-10:]
    good = rng.choice([f"({tail[:-7]}) {tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]}-{tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]}.{tail[-7:-4]}.{tail[-4:]}", f"00{digits[:-10] or '1'} {tail[:-7]} {tail[-7:-4]} {tail[-4:]}"])
    return good, rng.choice([f"{tail[:4]}-{tail[4:6]}-{tail[6:8]}", f"{tail[:3]} {tail[3:6]} {tail[6:8]} {tail[8:]}.0", tail, f"{tail[:4]}/{tail[4:8]}"])


def _secret(rng: random.Random) -> tuple[str, str, str, str]:
    """Text before it and a secret, and text before it and a long word that is none."""
    alphabet = rng.choice(["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
    value = "".join(rng.choice(alphabet) for _ in range(rng.choice([12, 16, 18, 20, 32, 40])))
    name = rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth"]) + rng.choice(["=", ": ", " = ", ' = "', ":", '="'])
    before = name if len(value) < 20 or rng.random() < 0.7 else ""
    if not before:
        value = rng.choice(["AKIA", "ASIA"]) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    words = [rng.choice(["release", "version", "chapter", "section", "figure", "model", "page", "part", "table", "draft"]) for _ in range(4)]
    plain = rng.choice(["-".join([*words[:3], str(rng.randrange(3000))]), "/".join([*words, str(rng.randrange(99))]), "_".join(words[:2]) + "_" + str(rng.randrange(10**6)), "".join(words) + str(rng.randrange(99)), f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(24):02}-00-00Z"])
    return before, value, rng.choice(["", "see ", "in ", "id: "]), plain


class Detector:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: BoostedTrees | None, thresholds: list[float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    @staticmethod
    def train(texts: list[str], precision: float = 0.995, seed: int = 7) -> Detector:
        """Learns from two thirds of the texts; the rest sets each kind's threshold: the smallest above which `precision` holds there,
        at least 0.9; a kind without 20 held-out positives gets none."""
        rng, x, y, kinds, fold = random.Random(seed), [], [], [], []
        def example(part: str, kind: int, at: int, end: int, label: int, group: int) -> None:
            x.append(features(part, kind, at, end))
            y.append(label)
            kinds.append(kind)
            fold.append(group % 3)

        for i, text in enumerate(sorted(texts)):
            base = base_spans(text)
            for kind, s, e in base:
                good, bad = _rewritten(rng, kind, text[s:e])
                left, right, at = text[max(0, s - 40) : s], text[e : e + 40], min(s, 40)
                for form, label in ((text[s:e], 1), (good, 1), (bad, 0)):
                    example(left + form + right, kind, at, at + len(form), label, i)
                named, secret, plainly, plain = _secret(rng)
                for more, form, label in ((named, secret, 1), (plainly, plain, 0)):
                    example(left + more + form + right, SECRET, at + len(more), at + len(more) + len(form), label, i)
            for kind, s, e in candidates(text):
                if not overlaps(base, s, e):
                    sure = kind == SECRET and bool(_ACCESS_KEY.fullmatch(text[s:e]) or _NAMED.search(text[max(0, s - 24) : s]) and _DIGIT.search(text[s:e]))
                    example(text, kind, s, e, int(sure), i)
        if sum(y) < 20 or len(y) == sum(y):
            return Detector(None, [2.0] * len(ALL_KINDS))
        x, y, kinds, fold = np.array(x), np.array(y), np.array(kinds), np.array(fold)
        trees = BoostedTrees.train(x[fold < 2], y[fold < 2])
        p, thresholds = trees.probability(x[fold == 2]), []
        for kind in range(len(ALL_KINDS)):
            own, truth = p[kinds[fold == 2] == kind], y[fold == 2][kinds[fold == 2] == kind]
            order = np.argsort(-own, kind="stable")
            right = np.cumsum(truth[order]) / np.arange(1, len(own) + 1)
            good = np.flatnonzero(right >= precision)
            thresholds.append(max(0.9, float(own[order][good[-1]])) if truth.sum() >= 20 and len(good) else 2.0)
        return Detector(trees, thresholds)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates over the threshold which overlap neither a base span nor a better candidate."""
        found = [c for c in candidates(text) if not overlaps(base, c[1], c[2])] if self.trees else []
        if not found:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in found]))
        out: list[tuple[int, int, int]] = []
        for i in np.lexsort((np.arange(len(p)), -p)).tolist():
            if p[i] >= self.thresholds[found[i][0]] and not overlaps(out, *found[i][1:]):
                out.append(found[i])
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


def train_detector(docs: DataFrame, key: str, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Detector:
    """From a sample of about sample_docs texts that hold a digit or an at sign (all of them, if fewer)."""
    rows = docs.filter(F.col(text).rlike("[0-9@]"))
    return Detector.train([r[0] for r in bounded_sample(rows, key, sample_docs).select(text).collect()])


def find_spans(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs with pii_base and pii_added (flat lists kind, start, end, ...) in place of any columns of these names."""
    docs = docs.drop("pii_base", "pii_added")
    kept = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_base", T.ArrayType(T.IntegerType())), T.StructField("pii_added", T.ArrayType(T.IntegerType()))])
    held = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        model = held.value
        for b in slices(batches, text):
            base, added = [], []
            for t in b.column(text).to_pylist():
                own = base_spans(t)
                base.append([v for s in own for v in s])
                added.append([v for s in model.added(t, own) for v in s] if t else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(base, pa.list_(pa.int32())), pa.array(added, pa.list_(pa.int32()))], [*kept, "pii_base", "pii_added"])

    return docs.mapInArrow(run, schema)


def _triples(flat: list[int]) -> list[tuple[int, int, int]]:
    return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Each span becomes its kind in brackets; overlapping spans become one, of the first one's kind."""
    kept = [c for c in found.columns if c not in ("pii_base", "pii_added")]
    schema = T.StructType([f for f in found.schema.fields if f.name in kept])

    def run(batches):
        for b in slices(batches, text):
            texts = b.column(text).to_pylist()
            for i, (base, added) in enumerate(zip(b.column("pii_base").to_pylist(), b.column("pii_added").to_pylist(), strict=True)):
                if base or added:
                    parts, at = [], 0
                    for s, e, kind in sorted((s, e, k) for k, s, e in _triples(base + added)):
                        if s >= at:
                            parts += (texts[i][at:s], f"[{ALL_KINDS[kind].upper()}]")
                        at = max(at, e)
                    texts[i] = "".join([*parts, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else b.column(c) for c in kept], kept)

    return found.mapInArrow(run, schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans as text, and how many of them there are, of secrets and in all."""

    def run(batches):
        for b in batches:
            rows = []
            for base, added in zip(b.column("pii_base").to_pylist(), b.column("pii_added").to_pylist(), strict=True):
                base, added = _triples(base), _triples(added)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), sum(k == SECRET for k, _, _ in added), len(base) + len(added)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_spans"])

    return found.select("doc_id", "pii_base", "pii_added").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_columns(find_spans(docs, train_detector(docs, "doc_id")))
