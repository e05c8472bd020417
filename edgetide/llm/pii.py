"""Personal data and secrets: weak-supervision aggregation over candidate spans.

Base spans are those of four fixed patterns with their checks; they are always returned. A wider generator finds
further candidates: numbers in phone shape without a plus, addresses written with words for @ and dot, dotted numbers
and digit runs that fail the checks, and, as a fifth kind, secrets: values that something is set to, and long tokens of
letters and digits. Eight labelers vote yes or no or abstain on every candidate, base ones included: a check of the
value, a gazetteer of beginnings and endings, the words before it, whether it is assigned, what it touches, its length, its
mix of characters, and what else is close by. None of them knows what is a base span.

Expectation-maximisation over the counts of all vote patterns estimates each labeler's reliability for each kind and how
likely each pattern is personal data; it covers all rows. On these posteriors a logistic classifier is trained over the
text itself (the span's characters and shape, its neighbours), on a bounded sample of candidates; it scores every
candidate, and those it takes are added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.runtime import prepare, stage

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Candidates that the classifier is trained on at most (about; chosen by a hash of row and place).
TRAIN_SPANS = 20_000
BITS = 14
#: Texts without any of these, a digit or one of @ = : have no span and no candidate.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# Candidates beyond the base patterns.
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_WORDY_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63})+")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z_-]{2,24}[\"']? ?[=:] ?[\"']?(?P<value>[^\s\"'<>,;]{6,200})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[A-Za-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{16,200}")
_WORDS = re.compile(r"[^\W\d_]+")
_SETS = re.compile(r"([A-Za-z_-]+)[\"']? ?[=:] ?[\"']?$")
_SHAPES = ((re.compile(r"[0-9]"), "0"), (re.compile(r"[a-z]"), "a"), (re.compile(r"[A-Z]"), "A"))
# Gazetteers and context words, in English, German, French and Spanish.
MAIL_ENDINGS = frozenset("com org net edu gov mil int io de fr es uk us eu ch at nl it info biz".split())
SECRET_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "ya29.")
CONTEXT = {
    "email": frozenset("email mail contact write address reply courriel correo adresse kontakt contacto ecrire schreiben".split()),
    "ip": frozenset("ip server host address login from connection client serveur servidor adresse verbindung connexion".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay carte tarjeta karte kreditkarte zahlung paiement pago".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon contact numero anruf handy portable llamar movil".split()),
    "secret": frozenset("password passwd pwd passwort clave contrasena token secret key apikey api auth bearer credential credentials access private motdepasse schluessel".split()),
}
#: Texts without any of these, a digit or one of @ = : have no span and no candidate.
ANY_SIGN = ("dot", *SECRET_STARTS)
#: Tokens that begin in a known way need no digit.
_MARKED = re.compile("(?<![A-Za-z0-9+/_=-])(?:" + "|".join(re.escape(x) for x in SECRET_STARTS) + ")[A-Za-z0-9+/_-]{12,200}")
#: Lengths in code points that a kind usually has.
LENGTHS = {"email": (6, 64), "ip": (7, 15), "card": (13, 23), "phone": (9, 22), "secret": (12, 128)}
LABELERS = ("valid", "gazetteer", "context", "assigned", "apart", "length", "charset", "company")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outward, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            # what stands before this @ can't be part of a later local part
            free = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start; per kind leftmost and non-overlapping."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the wider patterns find beside the base spans, by kind, then start.

    A candidate of a base kind overlaps no base span; a secret may hold one, but not lie in one.
    """
    starts, reach, out, seen = [], [], [], set()
    for s, e in sorted((s, e) for _, s, e in base):
        starts.append(s)
        reach.append(max(e, reach[-1] if reach else 0))

    def add(kind: int, start: int, end: int) -> None:
        before = bisect_left(starts, end)
        if not before or reach[before - 1] <= start:
            out.append((kind, start, end))

    if "at" in text and "dot" in text:
        for m in _WORDY_EMAIL.finditer(text):
            add(0, *m.span())
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            add(1, *m.span())
        for m in _CARD.finditer(text):
            if 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                add(2, *m.span())
        for m in _LOCAL_PHONE.finditer(text):
            add(3, *m.span())
    secrets = [m.span("value") for m in _ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    secrets += [m.span() for pattern in (_TOKEN, _MARKED) for m in pattern.finditer(text)]
    last = 0
    for start, end in sorted(secrets, key=lambda x: (x[0], -x[1])):
        k = bisect_left(starts, start + 1)
        if start >= last and not (k and reach[k - 1] >= end):
            out.append((4, start, end))
            last = end
    return out


def entropy(found: str) -> float:
    """Bits a character."""
    n = np.array(list(Counter(found).values()), float) / max(1, len(found))
    return float(-(n * np.log2(n)).sum()) if len(n) else 0.0


def votes(text: str, span: tuple[int, int, int], others: list[tuple[int, int, int]]) -> int:
    """Two bits a labeler, in the order of LABELERS: 0 abstains, 1 says no, 2 says yes."""
    kind, start, end = span
    name, found = ALL_KINDS[kind], text[start:end]
    digits = [c for c in found if "0" <= c <= "9"]
    letters = [c for c in found if c.isalpha()]
    head = text[max(0, start - 64) : start]
    before = [w.lower() for w in _WORDS.findall(head)[-4:]]
    yes = lambda x: 2 if x else 1
    if name == "email":
        ending = re.split(r"[. ]", found.rstrip(" )]"))[-1].lower()
        valid, known, mixed = yes(ending.isalpha() and len(ending) >= 2), yes(ending in MAIL_ENDINGS), yes(".." not in found and "  " not in found and found[0] not in ".%+-")
    elif name == "ip":
        parts = found.split(".")
        valid = yes(all(len(p) <= 3 and int(p[:4]) <= 255 for p in parts) and text[end : end + 2][:1] != ".")
        known, mixed = (1 if parts[0].strip("0") == "" else 0), yes(all(p == "0" or p[0] != "0" for p in parts))
    elif name == "card":
        valid, known = yes(luhn("".join(digits))), yes(digits[0] in "3456")
        groups = [len(g) for g in re.split(r"[ -]", found)]
        mixed = yes(len(groups) == 1 or all(g in (4, 5, 6) for g in groups[:-1]))
    elif name == "phone":
        valid, known = yes(9 <= len(digits) <= 15), 2 if found[0] == "+" and digits[0] != "0" else (1 if digits[0] in "01" and found[0] != "+" else 0)
        mixed = yes(not re.search(r"[ .-]{3}|\.\d{1,2}\.", found))
    else:
        known = 2 if found.startswith(SECRET_STARTS) else 0
        classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in found]
        changes = sum(x != y for x, y in zip(classes, classes[1:]))
        valid = yes(known or (entropy(found) >= 2.8 and changes >= 3))
        mixed = yes(len(letters) >= 3 and (len(digits) >= 2 or any(c.isupper() for c in found[1:])) and not found.startswith(("http", "www.", "//")))
    setting = _SETS.search(head)
    assigned = 0 if not setting else (2 if set(re.split(r"[-_]", setting.group(1).lower())) & CONTEXT[name] else 1 if name == "secret" else 0)
    context = 2 if CONTEXT[name] & set(before) else 0
    glued = text[end : end + 1].isalnum() or (start > 0 and text[start - 1].isalnum())
    low, high = LENGTHS[name]
    close = any(k != kind and (0 <= s - end <= 80 or 0 <= start - e <= 80) for k, s, e in others)
    cast = (valid, known, context, assigned, 1 if glued else 2, yes(low <= len(found) <= high), mixed, 2 if close else 0)
    return sum(v << 2 * i for i, v in enumerate(cast))


def features(text: str, span: tuple[int, int, int]) -> list[int]:
    """Hashed coordinates of a candidate's own text and neighbours: its kind, shape, pieces of shape, beginning, length, entropy,
    the characters that it touches and the words around it."""
    kind, start, end = span
    found = text[start:end]
    shape = found[:200]
    for pattern, letter in _SHAPES:
        shape = pattern.sub(letter, shape)
    short = re.sub(r"(.)\1{2,}", r"\1\1\1", shape)
    said = [w.lower() for w in _WORDS.findall(text[max(0, start - 64) : start])[-3:]]
    after = [w.lower() for w in _WORDS.findall(text[end : end + 48])[:1]]
    names = [f"s{short[:16]}", f"l{min(len(found), 64) // 4}", f"e{int(entropy(found) * 2)}", f"d{10 * sum(c.isdigit() for c in found) // max(1, len(found))}", f"p{text[max(0, start - 2) : start]}", f"n{text[end : end + 1]}", f"b{found[:4]}", f"v{luhn([c for c in found if '0' <= c <= '9']) if kind == 2 else ''}"]
    names += [f"g{short[i : i + 4]}" for i in range(min(24, max(0, len(short) - 3)))]
    names += [f"w{i}{w}" for i, w in enumerate(reversed(said))] + [f"x{w}" for w in said] + [f"a{w}" for w in after]
    return sorted({zlib.crc32(f"{kind}{n}".encode()) >> 32 - BITS for n in names} | {kind})


def aggregate(patterns: dict[tuple[int, int], int], rounds: int = 60) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """Posterior of each (kind, vote pattern) by expectation-maximisation over all counts; and the labelers' reliabilities.

    Labelers are independent given the truth; for each kind each has its own rates of no and yes in either case:
    reliabilities[kind, labeler, true or not, vote], vote 0 being its rate of abstaining over all. To abstain says nothing.
    Before any data all are better than chance and the check of the value is the firmest, so kinds with few candidates
    stay near that; no labeler's yes ever counts against a candidate.
    """
    rates = np.zeros((len(ALL_KINDS), len(LABELERS), 2, 3))
    out = {}
    firm = np.where(np.array(LABELERS) == "valid", 20.0, 2.0)
    for kind in range(len(ALL_KINDS)):
        keys = sorted(k for k in patterns if k[0] == kind)
        n = np.array([patterns[k] for k in keys], float)
        v = np.array([[p >> 2 * i & 3 for i in range(len(LABELERS))] for _, p in keys], int).reshape(len(keys), len(LABELERS))
        yes, no = ((v == x) @ firm for x in (2, 1))
        q = np.clip((yes + 0.5) / (yes + no + 1), 0.05, 0.95)
        for _ in range(rounds):
            prior = (n @ q + 2) / (n.sum() + 4)
            log = np.full(len(keys), np.log(prior) - np.log1p(-prior))
            for i in range(len(LABELERS)):
                silent = (n @ (v[:, i] == 0) + 1) / (n.sum() + 2)
                right = (firm[i] * 0.9 + (n * q) @ (v[:, i] == 2)) / (firm[i] + (n * q) @ (v[:, i] > 0))
                wrong = (firm[i] * 0.3 + (n * (1 - q)) @ (v[:, i] == 2)) / (firm[i] + (n * (1 - q)) @ (v[:, i] > 0))
                wrong = min(wrong, right)
                rates[kind, i] = [[silent, 1 - wrong, wrong], [silent, 1 - right, right]]
                said = v[:, i] > 0
                log[said] += np.log(rates[kind, i, 1, v[said, i]] + 1e-9) - np.log(rates[kind, i, 0, v[said, i]] + 1e-9)
            q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        out |= dict(zip(keys, q.tolist()))
    return out, rates


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier, and the reliabilities that its training labels came from."""

    weights: np.ndarray
    reliabilities: np.ndarray

    def score(self, at: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum(), -35, 35))))


def train_classifier(rows: list[np.ndarray], target: np.ndarray, steps: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adam; the same input gives the same weights."""
    w = np.zeros(1 << BITS)
    if not len(rows):
        return w
    at, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], minlength=len(rows)), -35, 35)))
        g = np.bincount(at, (p - target)[of], minlength=len(w)) / len(rows) + l2 / len(rows) ** 0.5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


FOUND = "n_base array<long>, base_sha256 string, spans array<struct<kind: int, start: long, end: long, votes: int, base: boolean, at: array<int>, pick: int>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("base", pa.bool_()), ("at", pa.list_(pa.int32())), ("pick", pa.int32())])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, all_spans = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            more = candidates(text, base)
            everything = [*base, *more]
            counts.append([sum(k == j for k, _, _ in base) for j in range(len(KINDS))])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            near = _nearby(everything)
            seed = zlib.crc32(text[:4096].encode("utf-8", "surrogatepass")) if everything else 0
            all_spans.append([{"kind": s[0], "start": s[1], "end": s[2], "votes": votes(text, s, near[i]), "base": i < len(base), "at": features(text, s), "pick": zlib.crc32(f"{seed}:{s}".encode()) >> 1} for i, s in enumerate(everything)])
        out = [batch.column("doc_id"), pa.array(counts, pa.list_(pa.int64())), pa.array(digests, pa.string()), pa.array(all_spans, pa.list_(_SPAN))]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_base", "base_sha256", "spans"])


def _nearby(spans: list[tuple[int, int, int]], around: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each span the few that come just before and after it in the text."""
    order = sorted(range(len(spans)), key=lambda i: spans[i][1:])
    out: list[list] = [[] for _ in spans]
    for place, i in enumerate(order):
        out[i] = [spans[j] for j in order[max(0, place - around) : place + around + 1] if j != i]
    return out


def _choose(shared, threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts, added, secrets = [], [], []
            for spans in batch.column("spans").to_pylist():
                kept = sorted((s["kind"], s["start"], s["end"], s["base"]) for s in spans if s["base"] or model.score(s["at"]) >= threshold)
                texts.append(joined([k[:3] for k in kept]))
                added.append(sum(not k[3] for k in kept))
                secrets.append(sum(k[0] == len(KINDS) for k in kept))
            out = {c: batch.column(c) for c in ("doc_id", "n_base", "base_sha256")} | {"spans": pa.array(texts, pa.string()), "n_added": pa.array(added, pa.int64()), "n_secret": pa.array(secrets, pa.int64())}
            yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    return each


def candidate_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_base, base_sha256 and spans (with votes and features) of every row, staged."""
    prepare(docs.sparkSession)
    # texts without a sign of any span are not handed to Python
    sign = F.col("text").rlike("[0-9@=:]")
    for x in ANY_SIGN:
        sign = sign | F.contains(F.col("text"), F.lit(x))
    text = F.when(sign, F.col("text")).alias("text")
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_find, "doc_id long, " + FOUND), "pii-spans")


def train(found: DataFrame, bound: int = TRAIN_SPANS) -> Model:
    """Aggregate the votes of all candidates of ``candidate_table`` and train the classifier on about ``bound`` of them at most."""
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    counted = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    # at most 5 kinds x 3**8 vote patterns
    patterns = {(r["kind"], r["votes"]): r["n"] for r in counted.collect()}
    posterior, rates = aggregate(patterns)
    total = sum(patterns.values())
    sample = spans if total <= bound else spans.where(F.col("pick") < F.lit(int(bound / total * (1 << 31))))
    rows = sorted((r["kind"], r["votes"], tuple(r["at"])) for r in sample.select("kind", "votes", "at").collect())
    weights = train_classifier([np.array(r[2], np.int64) for r in rows], np.array([posterior[r[:2]] for r in rows]))
    return Model(weights, rates)


def find(docs: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret.

    Counts and digest are of base spans; spans lists those and the added ones as kind:start:end, by kind (secrets last) and
    start, in code points of the whole text. n_added counts the added ones, n_secret those of them that are secrets.
    Without ``model`` one is trained on docs themselves. A null text counts as empty; more columns, whatever their names,
    are ignored. Rows are handled one by one, so ids may be null or repeat, and repeated rows get the same result. A text
    of any length is searched whole, in time that grows with its length. An empty table gives an empty table.
    """
    found = candidate_table(docs)
    model = model or train(found)
    chosen = found.mapInArrow(_choose(found.sparkSession.sparkContext.broadcast(model), threshold), "doc_id long, n_base array<long>, base_sha256 string, spans string, n_added long, n_secret long")
    return chosen.select("doc_id", *[F.get("n_base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)], "base_sha256", "spans", "n_added", "n_secret")
