"""PII spans by a semi-Markov conditional random field.

A text is cut into tokens; a segmentation covers them by entities of at most ``MAX_TOKENS`` tokens and by single tokens outside.
A candidate span gets a score for each type from features of the whole span (its shape, its length, what stands before and after) and
dynamic programming over bounded segments chooses boundaries and types jointly. The weights maximise the conditional likelihood
(exact forward-backward over all segmentations) of generated sentences; no sample of the corpus is used.

An entity must hold a digit of any script, an @, or a token of ``LONG`` characters or more in both cases (a secret may be all letters), so a stretch of
text without either is outside in every segmentation. Decoding therefore runs on the neighbourhoods of such tokens, wide enough for every span and its context, and
gives what decoding of the whole text would; the rest is skipped by a scan for them. Digits of other scripts are read as the ASCII ones.

``redacted`` gives the documents with every span replaced by its type in brackets.

Defined results: null and empty texts have no spans; a text of any length is scanned whole; of equally good segmentations
the one with the shorter last segment, then the earlier type, is taken; rows repeating a document repeat its spans, rows with a null
doc_id keep null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import random
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

MAX_TOKENS, BUCKETS, CONTEXT = 8, 1 << 12, 2
TYPES = ("OUT", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "NATIONAL_ID")
TOKEN = re.compile(r"\w+(?:[.@%+\-]+\w+)*|[^\w\s]")
LONG = 20
_HOT = re.compile(rf"[0-9@]|[A-Za-z]{{{LONG},}}")
_MIXED = re.compile(r"(?:[a-z]*[A-Z]){3}")


def _is_trigger(found: str) -> bool:
    """Of what ``_HOT`` finds, a run of letters counts if three are capitals and some are not."""
    return len(found) == 1 or (_MIXED.match(found) is not None and not found.isupper())


def triggers(text: str, start: int = 0, end: int = sys.maxsize) -> Iterator[tuple[int, int]]:
    return ((m.start(), m.end()) for m in _HOT.finditer(text, start, end) if _is_trigger(m.group()))


#: The same for the JVM, which only has to let through all texts that may hold one.
MAY_HOLD = rf"[\p{{Nd}}@]|[A-Za-z]{{{LONG},}}"
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


@lru_cache(maxsize=1)
def _digits() -> dict[int, str]:
    return {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}


def with_ascii_digits(text: str) -> str:
    """Digits of all scripts as ASCII digits; no character moves."""
    return text.translate(_digits()) if _OTHER_DIGIT.search(text) else text


def _shape(s: str) -> str:
    """Runs of the character classes with lengths up to 6 exact, 16 and 40 told apart, longer ones merged."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|\s+|.", s):
        t = m.group()
        n = len(t)
        size = str(n) if n <= 6 else "16" if n == 16 else "13-19" if 13 <= n <= 19 else "7-12" if n <= 12 else "20+"
        out.append(f"d{size}" if t[0].isdigit() else "a" if t[0].isalpha() else "_" if t.isspace() else t)
    return "".join(out)


def _luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _features(tokens: list[tuple[str, int, int]], text: str, i: int, j: int) -> list[int]:
    """Hashed features of the span of tokens i to j (exclusive)."""
    span = text[tokens[i][1] : tokens[j - 1][2]]
    digits = re.sub(r"[^0-9]", "", span)
    before = tokens[i - 1][0].lower() if i else "^"
    before2 = tokens[i - 2][0].lower() if i > 1 else "^"
    after = tokens[j][0].lower() if j < len(tokens) else "$"
    glued_before, glued_after = bool(i) and tokens[i - 1][2] == tokens[i][1], j < len(tokens) and tokens[j][1] == tokens[j - 1][2]
    octets = re.fullmatch(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})", span)
    n, hex_ = len(digits), re.fullmatch(r"[0-9a-fA-F]{20,}", span)
    secret = re.fullmatch(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=\-]{20,}", span)
    names = [
        "shape=" + _shape(span)[:40],
        f"tokens={j - i}",
        f"digits={n if n < 20 else 20}",
        "before=" + before[:12],
        "before2=" + before2[:12] + "|" + before[:12],
        "after=" + after[:12],
        f"plus={span[:1] == '+'},paren={'(' in span},n={7 <= n <= 15}",
        f"mail={bool(re.fullmatch(r'[^@\s]+@[^@\s]+[.][A-Za-z]{2,}', span))}",
        f"ip={bool(octets) and all(int(x) < 256 for x in octets.groups())}",
        f"cardlike={13 <= n <= 19 and bool(re.fullmatch(r'[0-9](?:[ -]?[0-9])*', span))},luhn={13 <= n <= 19 and _luhn(digits)}",
        f"hex={bool(hex_)},secret={bool(secret)}",
        f"glued={glued_before and before not in '(\"=<[{'},{glued_after and after.isalnum()}",
        f"cutdigits={glued_before and before[-1:].isdigit()},{glued_after and after[:1].isdigit()}",
        f"moredigits={i > 0 and before.isdigit()},{j < len(tokens) and after.isdigit()}",
        f"letters={bool(re.search(r'[^\W\d_]', span))},at={span.count('@')}",
        f"mixed={bool(re.fullmatch(r'(?=(?:[a-z]*[A-Z]){3})[A-Za-z]{20,}', span))},{len(re.findall('[a-z][A-Z]|[A-Z][a-z]', span)) > len(span) // 4}",
        "bias",
    ]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


N_FEATURES = 17


def tokenize(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]


def _spans(tokens: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Candidate spans: within the bound, holding a digit or an @, not ending in an opening mark or starting in a closing one."""
    hot = [next(triggers(t), None) is not None for t, _, _ in tokens]
    out = []
    for j in range(1, len(tokens) + 1):
        seen = False
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            seen |= hot[i]
            if seen:
                out.append((i, j))
    return out


def score_spans(tokens, text: str, weights: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    spans = _spans(tokens)
    if not spans:
        return {}
    ids = np.array([_features(tokens, text, i, j) for i, j in spans])
    return dict(zip(spans, weights[ids].sum(1)))


def decode(tokens, scores: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, str]]:
    """The best segmentation's entities. A token outside scores as the one-token span's OUT, or 0 if that is no candidate."""
    n = len(tokens)
    best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
    for j in range(1, n + 1):
        one = scores.get((j - 1, j))
        top, choice = best[j - 1] + (0.0 if one is None else one[0]), (j - 1, 0)
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            s = scores.get((i, j))
            if s is not None:
                y = int(np.argmax(s[1:])) + 1
                if best[i] + s[y] > top + 1e-12:
                    top, choice = best[i] + s[y], (i, y)
        best[j], back[j] = top, choice
    out, j = [], n
    while j:
        i, y = back[j]
        if y:
            out.append((i, j, TYPES[y]))
        j = i
    return out[::-1]


def generate(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with marked personal data and with look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwäéñöü") for _ in range(r.randint(1, 9)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    octet = lambda: str(r.randint(0, 255))
    card = lambda: r.choice([d(16), d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15)])
    email = lambda: f"{word()}{r.choice(['', '.' + word(), '.' + d(2), d(r.randint(1, 4)), '_' + word(), '+' + word()])}@{word()}{r.choice(['', d(1), '-' + word()])}.{r.choice(['com', 'org', 'example.com', 'net', 'co.uk', 'de'])}"
    phone = lambda: r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}",
            f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
            f"+{d(11)}"])
    secret = lambda: r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64]))),
            "sk-" + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQ0123456789") for _ in range(32)),
            "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) + d(2),
            "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.choice([24, 32,
                40])))])
    makers = {"EMAIL": email, "PHONE": phone, "IP": lambda: ".".join(octet() for _ in range(4)), "CARD": card, "SECRET": secret,
        "NATIONAL_ID": lambda: f"{d(3)}-{d(2)}-{d(4)}"}
    fakes = [lambda: f"Version {d(1)}.{d(1)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"${d(2)}.{d(2)}",
        lambda: d(r.randint(1, 6)), lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}",
        lambda: f"({d(4)})", lambda: f"{word()}{d(2)}", lambda: f"@{word()}", lambda: f"{d(2)}%",
        lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(3)}.{d(3)}",
        lambda: f"no. {d(4)}-{d(4)}", lambda: "".join(r.choice(["get", "user", "name", "from", "table", "with", "index",
        "value"]).title() for _ in range(r.randint(5, 7))),
        lambda: f"{r.randint(300, 999)}.{d(3)}.{r.randint(300, 999)}.{d(2)}"]
    out = []
    for _ in range(n):
        text, marks = "", []
        noise = r.choice(["", "", "", "###", "!!", "%%%", "$$$", "***", "&&&"])
        for _ in range(r.randint(3, 7)):
            x = r.random()
            if x < 0.35 and len(marks) < 3:
                kind = r.choice(TYPES[1:])
                value = makers[kind]()
                lead = {"SECRET": r.choice(['token = "', 'key: ', 'api_key="', 'password = ', ""]),
                    "EMAIL": r.choice(["", "", "mail ", "<"]), "PHONE": r.choice(["", "", "tel ", "call "]),
                    "NATIONAL_ID": r.choice(["SSN ", "ssn: ", ""])}.get(kind, "")
                text += lead
                marks.append((len(text), len(text) + len(value), kind))
                text += value + {'"': '"', "<": ">"}.get(lead[-1:], "") + r.choice(["", "", "", ".", ",", noise]) + " "
            elif x < 0.55:
                text += r.choice(fakes)() + r.choice(["", ".", ","]) + noise + " "
            else:
                text += word() + r.choice(["", "", ",", "."]) + noise + " "
        out.append((text.rstrip(), marks))
    return out


class Likelihood:
    """The conditional log-likelihood of marked sentences, and its gradient, by forward-backward over all segmentations."""

    def __init__(self, sentences: list[tuple[str, list[tuple[int, int, str]]]]):
        ids, owner, lo, hi, gold, n_tokens = [], [], [], [], [], []
        for s, (text, marks) in enumerate(sentences):
            tokens = tokenize(text)
            told = {}
            for a, b, kind in marks:
                inside = [k for k, (_, x, y) in enumerate(tokens) if x < b and y > a]
                told[inside[0], inside[-1] + 1] = TYPES.index(kind)
            covered = {k for i, j in told for k in range(i, j)}
            n_tokens.append(len(tokens))
            for i, j in _spans(tokens):
                ids.append(_features(tokens, text, i, j))
                owner.append(s)
                lo.append(i)
                hi.append(j)
                gold.append(told.get((i, j), 0 if j == i + 1 and i not in covered else -1))
        ids, self.owner, self.lo, self.hi, gold, self.n_tokens = (np.array(x) for x in (ids, owner, lo, hi, gold, n_tokens))
        self.used, cols = np.unique(ids, return_inverse=True)
        self.cols = cols.reshape(ids.shape)
        self.one = self.hi - self.lo == 1
        top = int(self.n_tokens.max())
        self.by_end = [np.flatnonzero(self.hi == j) for j in range(top + 1)]
        self.by_start = [np.flatnonzero(self.lo == i) for i in range(top + 1)]
        self.truth = np.zeros((len(ids), len(TYPES)))
        self.truth[gold >= 0, gold[gold >= 0]] = 1
        self.scored_one = np.zeros((len(self.n_tokens), top + 1), bool)
        self.scored_one[self.owner[self.one], self.lo[self.one]] = True

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean log-likelihood, gradient) at the weights (used feature, type)."""
        n, top, owner, lo, hi = len(self.n_tokens), self.scored_one.shape[1] - 1, self.owner, self.lo, self.hi
        s = w[self.cols].sum(1)
        value = float((s * self.truth).sum())
        s[~self.one, 0] = -np.inf  # outside only one token at a time
        total = np.logaddexp.reduce(s, axis=1)
        alpha, beta = np.full((n, top + 1), -np.inf), np.full((n, top + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, top + 1):
            free = ~self.scored_one[:, j - 1] & (j <= self.n_tokens)
            alpha[free, j] = alpha[free, j - 1]
            e = self.by_end[j]
            np.logaddexp.at(alpha[:, j], owner[e], alpha[owner[e], lo[e]] + total[e])
        beta[np.arange(n), self.n_tokens] = 0
        for i in range(top - 1, -1, -1):
            free = ~self.scored_one[:, i] & (i < self.n_tokens)
            beta[free, i] = beta[free, i + 1]
            e = self.by_start[i]
            np.logaddexp.at(beta[:, i], owner[e], beta[owner[e], hi[e]] + total[e])
        z = alpha[np.arange(n), self.n_tokens]
        posterior = np.exp(s + (alpha[owner, lo] + beta[owner, hi] - z[owner])[:, None])
        off, flat = (self.truth - posterior) / n, self.cols.ravel()
        return (value - float(z.sum())) / n, np.stack([np.bincount(flat, np.repeat(off[:, y], N_FEATURES), len(self.used)) for y in range(len(TYPES))], 1)


@lru_cache(maxsize=2)
def train(sentences: int = 900, rounds: int = 70, l2: float = 1e-4) -> np.ndarray:
    """Weights (feature, type) by AdaGrad on the conditional log-likelihood, all sentences at once."""
    likelihood = Likelihood(generate(sentences))
    w = np.zeros((len(likelihood.used), len(TYPES)))
    ada = np.full(w.shape, 1e-6)
    for _ in range(rounds):
        g = likelihood(w)[1] - l2 * w
        ada += g * g
        w += 0.5 * g / np.sqrt(ada)
    out = np.zeros((BUCKETS, len(TYPES)))
    out[likelihood.used] = w
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around the tokens with a digit or an @, with room for the longest span and its context on either side; overlapping ones are one.

    A region begins and ends between tokens.
    """
    room = MAX_TOKENS + CONTEXT

    def widened(b: int) -> int:
        """The end of the last word that a span or context from b on can reach; each word is a token at least."""
        for _ in range(room):
            while b < len(text) and text[b].isspace():
                b += 1
            while b < len(text) and not text[b].isspace():
                b += 1
        return b

    start = end = -1
    for a, b in triggers(text):
        if a < end:
            continue
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        for _ in range(room):
            while a > 0 and text[a - 1].isspace():
                a -= 1
            while a > 0 and not text[a - 1].isspace():
                a -= 1
        if a > end:
            if start >= 0:
                yield start, end
            start = a
        # what the region holds is decoded with it; a trigger near its end must widen it
        seen, end = b, max(end, widened(b))
        while (n := next(triggers(text, seen, end), None)) is not None:
            seen = n[1]
            while seen < len(text) and not text[seen].isspace():
                seen += 1
            end = max(end, widened(seen))
    if start >= 0:
        yield start, end


def find(text: str | None, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities, in characters."""
    out, text = [], with_ascii_digits(text or "")
    for a, b in regions(text):
        part = text[a:b]
        tokens = tokenize(part)
        out += [(a + tokens[i][1], a + tokens[j - 1][2], kind) for i, j, kind in decode(tokens, score_spans(tokens, part, weights))]
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, type, value) of all personal data; texts that can't hold any never leave the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    schema = "doc_id bigint, start int, length int, type string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, e - s, kind, t[s:e]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s,
                e, kind in find(t, shared.value)]
            ids, starts, lengths, kinds, values = zip(*rows) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()),
                    pa.array(lengths, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                names=["doc_id", "start", "length", "type", "value"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").rlike(MAY_HOLD)), run, schema)


def redact(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every entity replaced by its type in brackets; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in find(text, weights):
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its type; all other columns and all rows as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t, shared.value) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_arrow(docs, run, T.StructType(docs.schema.fields))
