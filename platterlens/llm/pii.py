"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated by
expectation-maximisation, and a span classifier trained on what follows from the votes decides.

Candidates of four kinds (email, ip, card, phone) are the base patterns' matches, those of their matches that break the
kind's rule (a part over 255, a wrong number of digits or checksum; of cards, those with 12 to 19 digits), and wider forms
that the base patterns do not know: addresses spelt with (at) and (dot), bracketed or colon-separated network addresses, card
numbers parted by dots, slashes or underscores, national phone numbers without a plus sign, and
the first groups of digits of what is too long for a phone number. Four labelers vote for, against
or not at all on each: the pattern and its rule; a gazetteer (endings of hosts, reserved address blocks, card issuers, calling
codes); cue words among the five words before; and what stands right beside the span.

Votes are counted for each kind over all documents; 81 patterns of votes for each of four kinds are all that expectation-
maximisation needs, so its estimate is that of all candidates, and the driver holds 324 counts. A span's probability under
it is the label of the final classifier, a logistic regression on hashed features (votes, shape of the span, its length, words
around it), learned from at most SAMPLE candidates, those with the smallest hashes. Base spans always stay; other
candidates are added where the classifier gives SURE or more and they overlap nothing found so far.

How it is spread out: texts are read once, where they lie, whole, into a table of candidates; the rest works on that table.
Nothing is shuffled but counts and the sample.

Defined cases: null text counts as empty and has no spans; offsets are code points, ends exclusive; rows are judged one by
one, whether or not ids or texts repeat; an empty table, or one without candidates, gives a model that adds nothing; other
columns pass through `scrub`, where input columns named spans and redacted are replaced, and are ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced, smallest, written

#: The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ABSTAIN, FOR, AGAINST = range(3)
LABELERS = ("pattern", "gazetteer", "cue", "surroundings")
#: Slots of hashed features, candidates that the classifier learns from at most, and the probability from which it adds a span.
SLOTS, SAMPLE, SURE = 1 << 14, 20_000, 0.8

#: The base patterns. An address before the at sign is looked for from the sign backwards, which finds the same
#: spans without trying every start; for the dotted one, a start within digits never does better than the run's first.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider forms.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}")
_BRACKETED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_PARTED = re.compile(r"(?<![0-9./_])[0-9]{4}(?:[./_ ][0-9]{4}){3}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.,/-])\(?0?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z/-])")
_GROUP = re.compile("[0-9]+")
_ANY = re.compile(r"[0-9@]|[\[({]\x20?(?:at|AT)\x20?[\])}]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|#")

#: Gazetteers and cues.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io dev app ai me co eu uk us ca au nz ie de at ch fr be nl lu es pt it pl cz se no dk fi ru jp cn in br mx ar cl za".split())
_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420 421 971 972".split())
_CUES = {
    EMAIL: frozenset("email e-mail mail mailto contact write reach address kontakt schreib adresse courriel correo escribe contacto".split()),
    IP: frozenset("ip ipv host hosts server client address addr from login connected ping adresse dirección".split()),
    CARD: frozenset("card visa mastercard amex credit debit pay paid payment kreditkarte karte carte tarjeta".split()),
    PHONE: frozenset("phone tel telephone call mobile cell fax whatsapp text sms telefon handy ruf téléphone teléfono móvil llama".split()),
}
_ANTICUES = frozenset("version release build revision order invoice isbn issn doi serial sku part article section chapter page ref reference ticket case # bestellung rechnung commande facture pedido factura".split())


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern, one for each at sign at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        free = max(free, at + 1)
        at = text.find("@", free)


def base(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether the kind's rule holds) of all matches of the base patterns, kind by kind."""
    for start, end in emails(text):
        yield EMAIL, start, end, True
    for m in _IP.finditer(text):
        yield IP, *m.span(), _octets(m[0].split("."))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        yield CARD, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield PHONE, *m.span(), 9 <= len(_digits(m[0])) <= 15


def wider(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(kind, start, end, vote) of forms that the base patterns do not know; the vote is whether the kind's rule holds, where
    it has one for the form."""
    for m in _SPELT.finditer(text):
        yield EMAIL, *m.span(), ABSTAIN
    for m in _BRACKETED.finditer(text):
        yield IP, *m.span(), ABSTAIN if ":" in m[0] else FOR if _octets(m[0].split("[.]")) else AGAINST
    for m in _PARTED.finditer(text):
        yield CARD, *m.span(), FOR if luhn(_digits(m[0])) else AGAINST
    for m in _NATIONAL.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield PHONE, *m.span(), ABSTAIN


def _phone_within(text: str, start: int, end: int) -> int:
    """Where the longest part of a match with too many digits ends that is whole groups of digits, 9 to 15 of them, or 0."""
    best = n = 0
    for m in _GROUP.finditer(text, start, end):
        n += len(m[0])
        if n > 15:
            break
        best = m.end() if n >= 9 else best
    return best


def _gazetteer(kind: int, span: str) -> int:
    if kind == EMAIL:
        ending = re.split(r"[^A-Za-z0-9-]+", span.rstrip())[-1].lower()
        return FOR if ending in _ENDINGS else AGAINST if len(ending) < 2 or ending[0].isdigit() else ABSTAIN
    digits = _digits(span)
    if kind == IP:
        parts = [p.lstrip("0") or "0" for p in re.split(r"[^0-9]+", span)]
        if ":" in span:
            return ABSTAIN
        if not _octets(parts):
            return AGAINST
        a, b = int(parts[0]), int(parts[1])
        return AGAINST if a in (0, 10, 127) or a >= 224 or (a, b) in ((169, 254), (192, 168)) or a == 172 and 16 <= b <= 31 else FOR
    if kind == CARD:
        n, two, four = len(digits), int(digits[:2]), int(digits[:4])
        known = digits[0] == "4" and n in (13, 16, 19) or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65 or 3528 <= four <= 3589) or n == 15 and two in (34, 37) or n == 14 and two in (36, 38)
        return FOR if known else AGAINST
    return (FOR if digits.startswith(_CODES) else AGAINST) if span[0] == "+" else ABSTAIN


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to five words before and three after, lower case, of 60 and 40 characters around."""
    return [w.lower() for w in _WORD.findall(text, max(0, start - 60), start)][-5:], [w.lower() for w in _WORD.findall(text, end, end + 40)][:3]


def _slot(*parts) -> int:
    return crc32("\x1f".join(map(str, parts)).encode()) % SLOTS


def _apart(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps none of `taken`, which are apart and in order."""
    at = bisect_left(taken, (end,))
    return not at or taken[at - 1][1] <= start


def described(text: str, kind: int, start: int, end: int, pattern: int) -> tuple[int, list[int]]:
    """The votes on a span, as one number to the base of three, and its hashed features."""
    span = text[start:end]
    before, after = _around(text, start, end)
    cue = FOR if _CUES[kind] & {*before} else AGAINST if _ANTICUES & {*before} else ABSTAIN
    near = text[max(0, start - 1) : start], text[end : end + 1]
    glued = any(c.isalnum() or c in "_=@" for c in near if c)
    votes = (pattern, _gazetteer(kind, span), cue, AGAINST if glued else ABSTAIN)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", span[:200]))))
    found = [_slot("kind", kind), _slot("shape", kind, shape), _slot("digits", kind, min(len(_digits(span)), 25)), _slot("beside", kind, *near)]
    found += [_slot("vote", kind, j, v) for j, v in enumerate(votes)]
    found += [_slot("before", kind, w) for w in before[-3:]] + [_slot("after", kind, w) for w in after]
    code = 0
    for v in votes:
        code = 3 * code + v
    return code, sorted(set(found))


def candidates_in(text: str) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(kind, start, end, base, votes, features) of every candidate of a text, base spans first."""
    if not _ANY.search(text):
        return []
    sound, broken, cuts = [], [], []
    for kind, start, end, holds in base(text):
        if holds:
            sound.append((kind, start, end))
        elif kind == PHONE and (cut := _phone_within(text, start, end)):
            cuts.append((PHONE, start, cut))
        elif kind != CARD or 12 <= len(_digits(text[start:end])) <= 19:
            broken.append((kind, start, end))
    told = _apart((s, e) for _, s, e in sound)
    every = _apart((s, e) for _, s, e in sound + broken + cuts)
    forms = [(s, FOR, True) for s in sound] + [(s, AGAINST, False) for s in broken]
    forms += [(s, ABSTAIN, False) for s in cuts]
    forms += [((k, s, e), vote, False) for k, s, e, vote in wider(text) if _free(every if k == PHONE else told, s, e)]
    return [(*s, kept, *described(text, *s, vote)) for s, vote, kept in forms]


_CANDIDATE = "array<struct<kind: int, start: int, end: int, base: boolean, votes: int, features: array<int>>>"
_CANDIDATE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))
_PARTS = ("kind", "start", "end", "base", "votes", "features")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, found) of docs: a row for each, with its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [[dict(zip(_PARTS, c)) for c in candidates_in(t or "")] for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _CANDIDATE_TYPE)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"doc_id long, found {_CANDIDATE}")


def votes_of(code: int) -> list[int]:
    return [code // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))]


#: Rows that stand for what is believed before any is seen: votes of each class as (for, against), for each labeler.
_BELIEF = np.array([[2.0, 8.0], [8.0, 2.0]])


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The share of real spans of each kind and, as [labeler, class, for or against], how often each labeler votes what when
    it votes, estimated by expectation-maximisation from how often each kind and pattern of votes was seen. Labelers are
    taken to err apart from each other and alike in all kinds, so that a kind without contrast learns from the others;
    abstaining tells nothing. Beliefs of ten rows a class, and of two a kind, keep what is hardly seen from any extreme."""
    seen = sorted(counts)
    kinds, n = np.array([k for k, _ in seen], int), np.array([counts[x] for x in seen], float)
    votes = np.array([votes_of(c) for _, c in seen], int).reshape(-1, len(LABELERS))
    likely = 1 / (1 + np.exp(-((votes == FOR).sum(1) - (votes == AGAINST).sum(1))))
    for _ in range(rounds):
        mass = np.stack([(1 - likely) * n, likely * n])
        shares = np.array([(mass[1, kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        table = np.stack([_BELIEF + np.stack([mass[:, votes[:, j] == v].sum(1) for v in (FOR, AGAINST)], 1) for j in range(len(LABELERS))])
        table /= table.sum(2, keepdims=True)
        likely = posterior(votes, shares[kinds], table)
    return shares, table


def posterior(votes: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability that spans with such votes, of kinds with such shares of real ones, are real."""
    score = np.log(shares) - np.log(1 - shares)
    for j in range(len(LABELERS)):
        told = np.log(table[j, 1] / table[j, 0])
        score = score + np.where(votes[:, j] == ABSTAIN, 0.0, told[votes[:, j] - FOR])
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def trained(rows: list[tuple[list[int], float]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on (features, probability), by steps of adaptive size in the rows' order."""
    w, g2 = np.zeros(SLOTS), np.full(SLOTS, 1e-6)
    for _ in range(epochs):
        for at, p in rows:
            g = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(w[at].sum()))))) - p + decay * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def fit(found: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of candidates(), a written table: reliabilities of all its spans, the probability of each pattern of votes, and
    the weights that a bounded sample of spans gives."""
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    shares, table = reliabilities(counts)
    every = np.array(list(product(range(3), repeat=len(LABELERS))))
    chance = [posterior(every, np.full(len(every), share), table) for share in shares]
    drawn = smallest(each.withColumn("__h", F.xxhash64("doc_id", "kind", "start", "end")), "__h", sample, "doc_id", "kind", "start", "end").select("kind", "votes", "features").collect() if counts else []
    weights = trained([(r["features"], float(chance[r["kind"]][r["votes"]])) for r in drawn])
    return {"shares": shares, "reliabilities": table, "weights": weights}


def decided(found: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a document's spans: base spans, then others that the classifier is sure of and that overlap no
    span before them, longer ones first; in order of kind and start."""
    out = [(c["kind"], c["start"], c["end"]) for c in found if c["base"]]
    other = [c for c in found if not c["base"] and 1 / (1 + math.exp(-max(-40.0, min(40.0, float(weights[c["features"]].sum()))))) >= SURE]
    taken = _apart((s, e) for _, s, e in out)
    for c in sorted(other, key=lambda c: (c["start"] - c["end"], c["start"], c["kind"])):
        if _free(taken, c["start"], c["end"]):
            out.append((c["kind"], c["start"], c["end"]))
            insort(taken, (c["start"], c["end"]))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def judged(found: DataFrame, model: dict) -> DataFrame:
    """candidates() with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them."""
    weights = model["weights"].astype(np.float32)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("found").to_pylist()
            own = [sorted((c["kind"], c["start"], c["end"]) for c in row if c["base"]) for row in rows]
            n = [pa.array([sum(s[0] == k for s in spans) for spans in own], pa.int64()) for k in range(len(KINDS))]
            marks = pa.array([sha256(listed(spans).encode()).hexdigest() for spans in own])
            spans = pa.array([listed(decided(row, weights)) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, marks, spans], ["doc_id", *counts, "base_sha256", "spans"])

    return found.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")


def scrub(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with spans (listed as text) and redacted, the text in which each span, or run of spans that overlap, is replaced by the
    name of its first kind in brackets; a null text stays null."""
    own = [c for c in docs.columns if c not in ("spans", "redacted")]
    weights = model["weights"].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            told, texts = [], []
            for t in batch.column("__text").to_pylist():
                spans = decided([dict(zip(_PARTS, c)) for c in candidates_in(t or "")], weights)
                out, at = [], 0
                for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
                    if start >= at:
                        out += [t[at:start], f"[{KINDS[kind].upper()}]"]
                    at = max(at, -end)
                told.append(listed(spans))
                texts.append(None if t is None else "".join(out) + t[at:])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(told, pa.string()), pa.array(texts, pa.string())], [*own, "spans", "redacted"])

    schema = docs.select(*own).schema.add("spans", "string").add("redacted", "string")
    return docs.select(*own, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(candidates(documents(spark, sf_dir).select("doc_id", "text")), "candidates")
    return judged(found, fit(found))
