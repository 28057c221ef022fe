"""Personal data: four fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels the words of a sequence (a sentence of a line, however long) as
the begin or inside of an e-mail, IP, card, phone or ID number, or as other. Its features are the shapes of a word and
its neighbours and a few cue words; it is trained from the small labelled table below (rules and a seed, no corpus) and
decoded by Viterbi over many sequences at once. Only sequences with a digit or an address sign can hold a label, which
is part of the model. A decoded span is added where no base span overlaps it and the path beats "all other" by MARGIN
over the runs of labelled words that begin less than NEAR words from it.

Null and empty texts have no spans. Rows are judged one by one. An empty table gives an empty result. A text is read
whole by one task; very long ones take time and memory in proportion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, word_spans

KINDS = ("email", "ip", "card", "phone", "id")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: How far evidence for a span may be (words); how much better a path with a span must be than "all other" (log odds).
NEAR, MARGIN = 128, 4.0

# The base patterns, in the order in which kinds are listed.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# The start of a run of digits decides for the whole run, hence the look-behind and the possessive repeat.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Digits and letters up to f, both of them and many: a key or a digest, whatever its shape.
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left and right; the first possible start is the left end of the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# The labelled table: sentences built by rule. Braces hold what a label covers, d stands for a digit.
_FORMS = {
    "email": ("{w [at] w [dot] w}", "{w (at) w.w}", "{w.wd@w.w}", "{w[at]w.w}", "{w(at)w.w}"),
    "ip": ("{b.b.b.b}", "{b.b.b.b:dddd}"),
    "card": ("{dddd dddd dddd dddd}", "{dddddddddddddddd}", "{dddd-dddd-dddd-dddd}", "{dddd dddddd ddddd}"),
    "phone": ("{+d (ddd) ddd-dddd}", "{(ddd) ddd-dddd}", "{ddd-ddd-dddd}", "{+dd ddd ddddddd}", "{+dd dd dddd dddd}", "{ddd.ddd.dddd}", "{ddd-ddd-dddd}", "{dd dd dd dd dd}", "{0dd ddddddd}", "{0ddd ddddddd}"),
    "id": ("{ddd-dd-dddd}",),
}
_PLAIN = ("dddd", "dd", "d", "dd.dd", "d,ddd", "dddd-dd-dd", "dd:dd", "w-d", "dd%", "$dd", "d.d", "wdd", "dd/dd/dddd", "version d.d", "w = dd", "xxxxxxxx", "w at w", "w dot w", "ddd ddd", "dd dd", "dd dd dd", "dddd dddd", "ddd ddd ddd", "dddddd", "d.d.d", '"xxxxxxxxxxxxxxxx"', "w###", "w%%%", "|", "dddddddddddddddd", "dddddddddddddddd", "dddddddddddddddddd", "xxxxxxxxxxxxxxxxxxxxxxxx", 'w = "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"', 'w: xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', "dddddddddddddddd", "dddddddddddddddd w###", "w### dddddddddddddddd w###")
_CUES = {
    "email": ("mail", "write to", "contact", "kontakt", "correo", "courriel"), "ip": ("from", "address", "host", "server"), "card": ("card", "number", "pay with", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "nummer ist", "appelez le", "llame al", "telefon", "numéro"), "id": ("ssn", "id"),
}
_CUE_WORDS = ("at", "dot", "[at]", "[dot]", "(at)", "mail", "kontakt", "correo", "courriel", "card", "karte", "carte", "tarjeta", "call", "phone", "tel", "nummer", "appelez", "llame", "telefon", "numéro", "ssn", "id")


def labelled_table(n: int = 1200, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label)."""
    rng = np.random.default_rng(seed)
    syllables = ("ta", "ner", "lo", "vi", "sch", "on", "que", "ment", "er", "ing", "ba", "rou")
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))

    def build(form: str) -> str:
        out = []
        for part in re.findall(r"[a-z]+|[A-Z]+|[^a-zA-Z]", form):
            if part in ("at", "dot", "version"):
                out.append(part)
                continue
            for c in part:
                out.append({"w": word, "d": lambda: str(rng.integers(0, 10)), "b": lambda: str(rng.integers(1, 255)), "x": lambda: rng.choice(list("0123456789abcdef"))}.get(c, lambda c=c: c)())
        return "".join(out)

    rows = []
    for _ in range(n):
        row: list[tuple[str, str]] = []

        def filler(most: int) -> None:
            for _ in range(rng.integers(0, most)):
                w = word()
                row.append((w.capitalize() if rng.random() < 0.1 else w + ("," if rng.random() < 0.1 else ""), "O"))

        filler(7)
        for _ in range(rng.integers(1, 4)):
            if rng.random() < 0.4:
                row.extend((w, "O") for w in build(rng.choice(_PLAIN)).split())
            else:
                kind = rng.choice(KINDS)
                form = rng.choice(_FORMS[kind]).strip("{}")
                # A bare run of digits is a card's only where something says so.
                if rng.random() < 0.4 or set(form) == {"d"}:
                    row.extend((w, "O") for w in rng.choice(_CUES[kind]).split())
                words = build(form).split()
                if rng.random() < 0.2:
                    words[-1] += rng.choice([".", ",", ";"])
                row.extend((w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words))
            if rng.random() < 0.6:
                filler(5)
        rows.append(row)
    return [r for r in rows if r]


def shape(word: str) -> str:
    """A word with a for small letters and A for capitals (runs cut to one), 9 for digits; of long ones both ends and a mark."""
    out = []
    for c in word:
        s = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if s in "aA" and out and out[-1] == s:
            continue
        out.append(s)
    return "".join(out) if len(out) <= 24 else "".join([*out[:12], "~", *out[-12:]])


@lru_cache(1 << 16)
def features(word: str) -> tuple[str, ...]:
    s = shape(word)
    core = s.strip(".,;:!?\"'")
    low = word.lower().strip(".,;:!?\"'")
    found = [f"shape={core}", f"short={re.sub(r'9+', '9', core)}", f"first={core[:1]}", f"last={core[-1:]}", f"digits={min(core.count('9'), 20)}"]
    if core.count("9") == len(core) >= 13:
        found.append(f"luhn={luhn(low)}")
    if _HEX.fullmatch(low):
        found.append("hex")
    if low in _CUE_WORDS or word.lower() in _CUE_WORDS:
        found.append(f"cue={low}")
    if s != core:
        found.append("edge")
    return tuple(found)


@dataclass
class Field:
    """Weights: of features by the word's own, previous or next place, and of steps from label to label."""

    weights: tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray]]
    steps: np.ndarray

    def emission(self, word: str, place: int) -> np.ndarray:
        out = np.zeros(len(LABELS))
        for f in features(word):
            w = self.weights[place].get(f)
            if w is not None:
                out += w
        return out


def _allowed() -> np.ndarray:
    """Inside labels follow the begin or inside of their kind only; index 0 of the rows is also the start."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and not (a[0] in "BI" and a[2:] == b[2:]):
                ok[i, j] = -1e4
    return ok


@lru_cache(1)
def trained(rounds: int = 60, rate: float = 0.15, shrink: float = 2e-3) -> Field:
    """Maximise the likelihood of the labelled table by Adam, all sentences at once."""
    table = labelled_table()
    names: tuple[dict[str, int], ...] = ({}, {}, {})
    length = max(map(len, table))
    n, size = len(table), len(LABELS)
    most = 8
    ids = np.full((3, n, length, most), -1)
    gold, real = np.zeros((n, length), int), np.zeros((n, length), bool)
    for r, row in enumerate(table):
        for t, (word, label) in enumerate(row):
            gold[r, t], real[r, t] = LABELS.index(label), True
            for place, at in enumerate((t, t - 1, t + 1)):
                if 0 <= at < len(row):
                    for k, f in enumerate(features(row[at][0])):
                        ids[place, r, t, k] = names[place].setdefault(f, len(names[place]))
    base = np.cumsum([0, *(len(x) for x in names)])
    total = base[-1]
    for place in range(3):
        ids[place][ids[place] >= 0] += base[place]
    ids = np.where(ids < 0, total, ids).transpose(1, 2, 0, 3).reshape(n, length, -1)
    w, steps, rule = np.zeros((total + 1, size)), np.zeros((size, size)), _allowed()
    flat = ids.reshape(-1)
    used = np.flatnonzero(flat < total)
    order = used[np.argsort(flat[used], kind="stable")]
    heads = np.flatnonzero(np.append(True, np.diff(flat[order]) > 0))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    hot = np.eye(size)[gold] * real[..., None]
    gold_steps = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]) + np.eye(size)[np.zeros(n, int)].T @ hot[:, 0]
    for step in range(1, rounds + 1):
        e = w[ids].sum(axis=2)
        trans = np.exp(np.clip(steps, -30, 30) + rule)
        alpha = np.zeros((n, length, size))
        scale = np.ones((n, length))
        for t in range(length):
            a = (trans[0] if t == 0 else alpha[:, t - 1] @ trans) * np.exp(e[:, t])
            a = np.where(real[:, t, None], a, alpha[:, t - 1] if t else a)
            scale[:, t] = np.where(real[:, t], a.sum(axis=1), 1)
            alpha[:, t] = a / scale[:, t, None]
        beta = np.ones((n, length, size))
        pair = np.zeros((size, size))
        for t in range(length - 1, 0, -1):
            b = np.exp(e[:, t]) * beta[:, t] / scale[:, t, None]
            pair += np.einsum("ni,nj->ij", alpha[:, t - 1] * real[:, t, None], b) * trans
            beta[:, t - 1] = np.where(real[:, t, None], b @ trans.T, 1)
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        marginal *= real[..., None]
        pair[0] += marginal[:, 0].sum(axis=0)
        gw = np.zeros_like(w)
        gw[:total] = np.add.reduceat((hot - marginal).reshape(-1, size)[order // ids.shape[2]], heads)
        for x, g, m, v in ((w, gw / n - shrink * w, moments[0], moments[1]), (steps, (gold_steps - pair) / n - shrink * steps, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(tuple({f: w[i + base[p]] for f, i in names[p].items()} for p in range(3)), steps + rule)


def viterbi(emissions: np.ndarray, bounds: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best labels of sequences set end to end (``bounds``: where each begins).

    Sequences advance together, longest first, so that step t handles those that are longer than t.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = bounds[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()
    back = np.zeros((len(emissions), steps.shape[0]), np.int8)
    labels = np.zeros(len(emissions), np.int64)
    into = np.ascontiguousarray(steps.T)
    score = emissions[first] + steps[0]
    for t in range(1, longest):
        live = going[t]
        options = score[:live, None, :] + into
        at = first[:live] + t
        back[at] = options.argmax(axis=2)
        score[:live] = options.max(axis=2) + emissions[at]
    best = score.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        live = going[t]
        at = first[:live] + t
        labels[at] = best[:live]
        best[:live] = back[at, best[:live]]
    return labels


def near_gains(emissions: np.ndarray, labels: np.ndarray, bounds: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """By word with a label: by how much the path beats "all other" over the runs of its sequence that begin less than NEAR words from its run."""
    before = np.append(0, labels[:-1])
    before[bounds[:-1]] = 0
    at = np.arange(len(labels))
    gain = np.append(0.0, np.cumsum(emissions[at, labels] - emissions[:, 0] + steps[before, labels] - steps[0, 0]))
    out = np.zeros(len(labels))
    inside = labels > 0
    opens = inside & (before == 0)
    starts = np.flatnonzero(opens)
    # A run's gain includes the step back to "other"; words between runs add nothing.
    total = np.append(gain[starts], gain[-1])
    # Sequences are set so far apart that none is near another.
    place = starts + np.searchsorted(bounds, starts, side="right") * 2 * NEAR
    low, high = np.searchsorted(place, place - NEAR, side="right"), np.searchsorted(place, place + NEAR, side="left")
    out[inside] = (total[high] - total[low])[np.cumsum(opens)[inside] - 1]
    return out


_DIGIT_OR_SIGN = np.zeros(256, bool)
_DIGIT_OR_SIGN[48:58] = True
_DIGIT_OR_SIGN[[ord(c) for c in "@[]()"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in "!?;"]] = True


class Decoder:
    """Adds the field's spans to a batch of texts."""

    def __init__(self, model: Field):
        self.model = model
        self._known: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _vectors(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self._known.get(word)
        if got is None:
            text = word.decode("utf-8", "replace")
            got = tuple(self.model.emission(text, p) for p in range(3))
            if len(self._known) < 1 << 15:
                self._known[word] = got
        return got

    def spans(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, kind, start, end) in bytes of the row."""
        starts, ends, row = word_spans(data, offs)
        if not len(starts):
            return
        active = np.concatenate([[0], np.cumsum(_DIGIT_OR_SIGN[data])])
        active = active[ends] > active[starts]
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        cut = np.ones(len(starts), bool)
        cut[1:] = (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[ends[:-1]]) | _STOP[data[ends[:-1] - 1]]
        sequence = np.cumsum(cut) - 1
        wanted = np.bincount(sequence, weights=active) > 0
        take = np.flatnonzero(wanted[sequence])
        if not len(take):
            return
        heads = np.flatnonzero(np.append(True, sequence[take][1:] != sequence[take][:-1]))
        bounds = np.append(heads, len(take))
        raw = data.tobytes()
        vectors = [self._vectors(raw[a:b]) for a, b in zip(starts[take].tolist(), ends[take].tolist(), strict=True)]
        own, before, after = (np.array([v[p] for v in vectors]) for p in range(3))
        # before: what a word says of its successor's label; after: of its predecessor's.
        inner = np.ones(len(take), bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        own[at] += before[at - 1]
        own[at - 1] += after[at]
        labels = viterbi(own, bounds, self.model.steps)
        good = (labels > 0) & (near_gains(own, labels, bounds, self.model.steps) >= MARGIN)
        for i in np.flatnonzero(good & (labels % 2 == 1)):
            j = i + 1
            while j < len(labels) and good[j] and labels[j] == labels[i] + 1 and inner[j]:
                j += 1
            a, b = int(starts[take[i]]), int(ends[take[j - 1]])
            while b > a and raw[b - 1 : b] in b".,;:!?\"'":
                b -= 1
            while a < b and raw[a : a + 1] in b"\"'":
                a += 1
            if active[take[i:j]].any() and b > a:
                r = int(row[take[i]])
                yield r, int(labels[i] - 1) // 2, a - int(offs[r]), b - int(offs[r])


def overlaps(spans: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether any of the sorted spans shares a code point; spans of different kinds may overlap each other a little."""
    at = bisect_left(spans, (end,))
    return any(b > begin for _, b in spans[max(0, at - len(KINDS)) : at])


def _finding(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch, data, offs in pieces(batches):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            base = [base_spans(t) for t in texts]
            taken = [sorted((a, b) for _, a, b in spans) for spans in base]
            # Code points before each byte.
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for r, kind, a, b in decoder.spans(data, offs):
                begin, end = (int(points[offs[r] + x] - points[offs[r]]) for x in (a, b))
                if not overlaps(taken[r], begin, end):
                    added[r].append((kind, begin, end))
            named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([named(x) for x in base], pa.list_(item)), pa.array([named(x) for x in added], pa.list_(item))], ["doc_id", "base", "added"])

    return run


def find_personal(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id and arrays of spans (kind, start, end in code points): the patterns' and those that the field adds."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(_finding(model or trained()), f"doc_id {kind}, base {spans}, added {spans}")
