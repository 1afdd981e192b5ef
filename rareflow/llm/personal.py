"""Personal data by weak supervision.

Labelers (patterns, word lists, context words) vote on candidate spans. How often each
pattern of votes and features occurs is counted over all documents; expectation-maximisation on these
counts estimates each labeler's reliability per kind, and its posteriors train a logistic
span classifier. A second pass marks the spans: the ones of the fixed patterns always,
the others if the classifier accepts them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rareflow.llm.common import add_columns, small_batches

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "url_login")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is entered at its first digit only; no other start can match further left
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# candidates beyond the fixed patterns; runs are taken whole, and entered at their start only
SECRET = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z_]{2,}+)[=:]\x20?([A-Za-z0-9+/_-]{8,}+)")
LOGIN = re.compile(r"(?<![a-z])[a-z]{3,}+://([^\s/@:]++):([^\s/@]++)@")
LOCAL_PHONE = re.compile(r"(?<![0-9+.\-])(?:\([0-9]{2,5}\)|0[0-9]{1,4})[\x20/-][0-9]{3,4}[\x20-][0-9]{3,6}"
                         r"(?![0-9])")
OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?"
                        r"[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)+")
#: gazetteers and context words per kind
GAZETTEER = {
    "email": {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key",
               "access_key", "secret_key", "auth"},
    "phone": {"0", "("}, "ip": {"10", "127", "172", "192"}, "card": {"3", "4", "5", "6"},
    "url_login": {"ftp", "http", "https", "postgres", "mysql", "mongodb", "redis", "ssh"}}
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "addr", "login", "from"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "telefon"},
    "secret": {"login", "user", "credentials", "env", "config", "password", "export"},
    "url_login": {"connect", "database", "url", "server", "login"}}
LABELERS = 4                 # fixed pattern, loose pattern, gazetteer, context


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each run before an ``@`` is looked at once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(LOCAL))
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", *span) for span in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
                       for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text)
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of looser patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [("secret", m.start(2), m.end(2)) for m in SECRET.finditer(text)]
    if "://" in text and "@" in text:
        out += [("url_login", m.start(1), m.end(2)) for m in LOGIN.finditer(text)]
    out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    if "at]" in text or "at)" in text:
        out += [("email", *m.span()) for m in OBFUSCATED.finditer(text)]
    return out


def name_before(text: str, start: int) -> str:
    """The name whose value begins at ``start``."""
    end = start - 1 - (text[start - 1:start] == " ")         # of the sign between them
    low = end
    while low > 0 and (text[low - 1].isascii() and text[low - 1].isalpha() or text[low - 1] == "_"):
        low -= 1
    return text[low:end]


def described(text: str, kind: str, start: int, end: int, fixed: bool) -> tuple:
    """(kind, votes, features) of a candidate; few values each, so patterns stay countable."""
    value = text[start:end]
    around = set(re.findall(r"[a-z][a-z-]*", (text[max(0, start - 40):start] + " "
                                              + text[end:end + 20]).lower()))
    known = GAZETTEER[kind]
    if kind == "email":
        listed = value.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in known
    elif kind == "ip":
        listed = value.split(".")[0] in known
    elif kind == "secret":
        name = name_before(text, start).lower()
        listed = name in known or not known.isdisjoint(name.split("_"))
    elif kind == "url_login":
        before = re.search(r"([a-z]{3,10})://$", text[max(0, start - 14):start])
        listed = bool(before) and before[1] in known
    else:
        listed = value[:1] in known or value.startswith("+")
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    features = (int(digits > 0), int(letters > 0 and digits > 0), int(len(value) >= 12),
                int(len(value) >= 20), int(4 * digits >= len(value)))
    votes = (int(fixed), int(not fixed), int(listed), int(bool(around & CONTEXT[kind])))
    return (kind, *votes, *features)


def candidates(text: str | None) -> list[tuple[tuple[str, int, int], bool]]:
    """All candidate spans; loose ones that touch a fixed span of their kind are dropped."""
    text = text or ""
    fixed = fixed_spans(text)
    out = [(span, True) for span in fixed]
    if loose := loose_spans(text):
        taken = {kind: sorted((s, e) for k, s, e in fixed if k == kind)
                 for kind in dict.fromkeys(k for k, _, _ in loose)}
        starts = {kind: np.array([s for s, _ in spans], np.int64) for kind, spans in taken.items()}
        for kind, start, end in dict.fromkeys(loose):
            i = int(np.searchsorted(starts[kind], end)) - 1
            if i < 0 or taken[kind][i][1] <= start:
                out.append(((kind, start, end), False))
    return out


@dataclass
class SpanModel:
    """Labeler reliabilities and classifier weights of each kind."""

    reliability: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]

    def score(self, pattern: tuple) -> float:
        """Probability of a candidate; 0 if no labeler but its own loose pattern speaks for it."""
        weight = self.weights.get(pattern[0])
        if weight is None or not (pattern[1] or any(pattern[3:1 + LABELERS])):
            return 0.0
        return float(1 / (1 + np.exp(-(weight[0] + weight[1:] @ np.array(pattern[1:], float)))))


@dataclass(frozen=True)
class PersonalData:
    """Adds span columns to a table of texts.

    Null and empty texts have no spans; very long texts are searched whole, in time in
    proportion to their length; repeated rows get equal results; columns named like a new one are
    replaced. A kind without candidates has no model and adds nothing. The model is a
    function of pattern counts, so its size does not depend on the corpus.
    """

    accept: float = 0.5
    steps: int = 30
    prior: float = 0.5

    def counts(self, docs: DataFrame, text_column: str = "text") -> list[tuple]:
        """(pattern, n) over all documents; the patterns are bounded by kinds x 2^9."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    text = text.as_py()
                    for (kind, start, end), fixed in candidates(text):
                        seen[described(text, kind, start, end, fixed)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()),
                 pa.array([list(k[1:]) for k in seen], pa.list_(pa.int64())),
                 pa.array(list(seen.values()), pa.int64())], names=["kind", "marks", "n"])

        small_batches(docs.sparkSession)
        rows = (docs.select(F.col(text_column).alias("text")).mapInArrow(
            run, "kind string, marks array<long>, n long")
            .groupBy("kind", "marks").agg(F.sum("n").alias("n")).collect())
        return sorted(((r["kind"], *r["marks"]), r["n"]) for r in rows)

    def fit(self, counted: list[tuple]) -> SpanModel:
        """Expectation-maximisation over vote patterns, then one classifier per kind."""
        reliability, weights = {}, {}
        for kind in KINDS + ADDED:
            own = [(p[1:], n) for p, n in counted if p[0] == kind]
            if not own:
                continue
            marks = np.array([p for p, _ in own], float)
            n = np.array([c for _, c in own], float)
            votes = marks[:, :LABELERS]
            # start: labelers are right nine times in ten, the loose pattern says little
            rate = np.array([[0.1, 0.5, 0.1, 0.1], [0.9, 0.5, 0.9, 0.5]])
            share = self.prior
            # kinds without a fixed pattern: the labeler that cannot vote says nothing either way
            heard = votes[:, int(kind in ADDED):], rate[:, int(kind in ADDED):]   # a view of the rates
            for _ in range(self.steps):
                like = [np.log(part) + heard[0] @ np.log(r) + (1 - heard[0]) @ np.log(1 - r)
                        for part, r in zip((1 - share, share), heard[1], strict=True)]
                belief = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
                for c, b in enumerate((1 - belief, belief)):
                    rate[c] = ((n * b) @ votes + 1) / ((n * b).sum() + 2)
                share = float(np.clip((n @ belief + 1) / (n.sum() + 2), 0.01, 0.99))
            reliability[kind] = rate
            weights[kind] = logistic(marks, belief, n)
        return SpanModel(reliability, weights)

    def mark(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """``docs`` with counts per fixed kind, the digest of fixed spans and all spans."""
        model, accept = self.fit(self.counts(docs, text_column)), self.accept
        extra = StructType([StructField(f"n_{k}", LongType()) for k in KINDS]
                           + [StructField(c, StringType()) for c in ("base_sha256", "spans")])
        order = {kind: i for i, kind in enumerate(KINDS + ADDED)}
        position = docs.drop(*[f.name for f in extra.fields]).columns.index(text_column)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            tallies = {k: [] for k in KINDS}
            digests, spans = [], []
            for text in batch.column(position):
                text = text.as_py()
                found = candidates(text)
                fixed = [span for span, is_fixed in found if is_fixed]
                kinds = Counter(kind for kind, _, _ in fixed)
                for k in KINDS:
                    tallies[k].append(kinds[k])
                digests.append(hashlib.sha256(written(fixed, order).encode()).hexdigest())
                more = [(k, s, e) for (k, s, e), is_fixed in found if not is_fixed
                        and model.score(described(text, k, s, e, False)) >= accept]
                spans.append(written(fixed + more, order))
            return [*(pa.array(tallies[k], pa.int64()) for k in KINDS),
                    pa.array(digests, pa.string()), pa.array(spans, pa.string())]

        return add_columns(docs, extra, work)


def written(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    ordered = sorted(spans, key=lambda s: (order[s[0]], s[1], s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def logistic(marks: np.ndarray, target: np.ndarray, n: np.ndarray,
             penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weighted logistic regression on soft targets by Newton steps."""
    x = np.hstack([np.ones((len(marks), 1)), marks])
    w = np.zeros(x.shape[1])
    n = n * min(1.0, 1e6 / n.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - target)) + penalty * w
        bend = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w
