"""Personal data in texts: patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans. The field's nodes are the tokens with a digit or an
``@`` (any other token has the label ``none`` for certain, so leaving it out changes no
marginal). A node's features are its shape, the base span it lies in and what stands
before it. Neighbouring tokens share a transition potential. Skip edges join distant
tokens that repeat each other or end in the same seven digits or share an e-mail
name, and share a potential of their own, so that a number written once in full
makes its shorter form elsewhere a phone number too. Loopy message passing (sum-product,
all messages of a round at once) gives the marginals of every document of a batch.
The weights are fitted on labelled texts built here.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ready

KINDS = ("email", "ip", "card", "phone")
#: Rounds of message passing; a message travels at most as many edges.
ROUNDS = 12
#: Words before a token that hint at its kind (fixed values).
CUES = {"email": "email mail e-mail contact", "ip": "ip host server address", "card": "card visa mastercard amex credit", "phone": "phone tel call mobile fax telephone"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a number begins at its first digit only, else a long run of digits would be read from each of its places
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_ANY = re.compile(r"[0-9@]")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]")

Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) < 4 and int(part) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        host = _DOMAIN.match(text, at)
        start = at
        while host and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = host.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Spans (start, kind, end) of the patterns, by start and then by kind; each pattern from left to right without overlaps.

    Time grows with the text's length, whatever it holds.
    """
    out: list[Span] = [(s, "email", e) for s, e in _emails(text)]
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


_SHAPES = ("few", "some", "seven", "nine", "card", "long", "luhn", "plain", "dashes", "dots", "brackets", "plus", "at", "mail", "quad", "version", "words", "handle", "run9", "run16", "quads", "left", "alone")
FEATURES = [*_SHAPES, *(f"in_{k}" for k in KINDS), *(f"cue_{k}" for k in KINDS), "bias"]
_AT = {name: i for i, name in enumerate(FEATURES)}
_CUE = {word: f"cue_{kind}" for kind, some in CUES.items() for word in some.split()}


@dataclass
class Nodes:
    """Tokens of one text: core bounds, digits, features that hold, whether each continues the one before, and skip edges (a, b, kind)."""

    spans: list[tuple[int, int]]
    digits: list[str]
    features: list[list[int]]
    follows: list[bool]
    skips: list[tuple[int, int, int]]


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the marks around it; a plus or an opening bracket before a digit stays, and the bracket's other half."""
    while start < end and not (text[start].isalnum() or text[start] == "+" or (text[start] == "(" and text[start + 1 : start + 2].isdigit())):
        start += 1
    while end > start and not (text[end - 1].isalnum() or (text[end - 1] == ")" and "(" in text[start:end])):
        end -= 1
    return start, end


def _shape(core: str, digits: str) -> list[str]:
    n = len(digits)
    out = ["few" if n < 4 else "some" if n < 7 else "seven" if n < 9 else "nine" if n < 12 else "card" if n < 20 else "long"]
    letters = bool(_WORD.search(core))
    if not letters and 12 <= n <= 19 and luhn(digits):
        out.append("luhn")
    if letters:
        out.append("words")
        if "@" not in core and len(core) >= 5 and n <= 4 and all(c in _LOCAL for c in core):
            out.append("handle")
    else:
        out += [name for name, has in (("plain", len(core) == n), ("dashes", "-" in core), ("brackets", "(" in core or ")" in core), ("plus", core[:1] == "+")) if has]
    if "." in core:
        parts = core.split(".")
        numeric = all(p.isascii() and p.isdigit() for p in parts)
        out.append("quad" if numeric and len(parts) == 4 and all(map(_octet, parts)) else "version" if numeric else "dots")
    if "@" in core:
        out.append("at")
        if _DOMAIN.search(core) and core[0] != "@":
            out.append("mail")
    return out


def text_nodes(text: str, base: list[Span]) -> Nodes:
    """The field's nodes of a text with its base spans."""
    spans: list[tuple[int, int]] = []
    digits: list[str] = []
    shapes: list[list[str]] = []
    follows: list[bool] = []
    before, j, active = -1, 0, []
    for m in _TOKEN.finditer(text):
        start, end = _core(text, *m.span())
        if start == end:
            continue
        core = text[start:end]
        own = "".join(_DIGITS.findall(core))
        shape = _shape(core, own)
        near = before >= 0 and m.start() - before < 3 and _GAP.fullmatch(text, before, m.start()) is not None
        if not near:
            word = text[max(0, m.start() - 24) : m.start()].split()[-1:]
            shape += [_CUE[w] for w in (word[0].lower().strip(".,:;()#") if word else "",) if w in _CUE]
        while j < len(base) and base[j][0] < end:
            active.append(base[j])
            j += 1
        active = [s for s in active if s[2] > start]
        shape += [f"in_{s[1]}" for s in active]
        spans.append((start, end))
        digits.append(own)
        shapes.append(shape)
        follows.append(near)
        before = m.end()
    _runs(text, spans, digits, shapes, follows)
    last: dict[tuple, int] = {}
    skips = []
    for i, ((start, end), own) in enumerate(zip(spans, digits, strict=True)):
        core = text[start:end].lower()
        keys: list[tuple[int, str]] = [(1, core)] if len(core) >= 5 else []
        if not _WORD.search(core):
            tail, k = own, i
            while len(tail) < 7 and follows[k] and digits[k - 1] and not _WORD.search(text, *spans[k - 1]):
                k -= 1
                tail = digits[k] + tail
            if len(tail) >= 7:
                keys.append((2, tail[-7:]))
        name = core.split("@")[0]
        if len(name) >= 5 and ("@" in core or "handle" in shapes[i]):
            keys.append((2, f"@{name}"))
        joined = set()
        for kind, key in keys:
            other = last.get((kind, key))
            if other is not None and other not in joined:
                skips.append((other, i, kind - 1))
                joined.add(other)
            last[kind, key] = i
    return Nodes(spans, digits, [sorted({_AT[s] for s in [*shape, "bias"]}) for shape in shapes], follows, skips)


def _runs(text: str, spans: list, digits: list[str], shapes: list[list[str]], follows: list[bool]) -> None:
    """Features of runs of neighbouring numbers: digits since a plus sign, groups of four that pass the Luhn check together."""
    total = -1
    for i, own in enumerate(digits):
        if not follows[i]:
            total = -1
            shapes[i].append("left")
            if i + 1 == len(digits) or not follows[i + 1]:
                shapes[i].append("alone")
        if text[spans[i][0]] == "+":
            total = 0
        if total >= 0:
            total = -1 if "quad" in shapes[i] or "words" in shapes[i] else total + len(own)
        if total >= 0:
            shapes[i].append("run9" if total <= 15 else "run16")
        if i >= 3 and all(follows[i - 2 : i + 1]) and all(len(d) == 4 and e - s == 4 for d, (s, e) in zip(digits[i - 3 : i + 1], spans[i - 3 : i + 1], strict=True)) and luhn("".join(digits[i - 3 : i + 1])):
            for k in range(i - 3, i + 1):
                shapes[k].append("quads")


@dataclass
class Field:
    """Weights of features by label, and pair potentials of neighbours, repeats and similar tokens. Label 0 is none."""

    weights: np.ndarray
    pairs: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def beliefs(unary: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes and of edges by loopy sum-product; edges (a, b) of a kind. Exact on a forest no deeper than ``rounds``."""
    n, k = unary.shape
    there, back = np.zeros((len(a), k)), np.zeros((len(a), k))  # messages to b, to a
    pot = pairs[kind]
    for step in range(rounds + 1):
        total = unary + np.stack([np.bincount(b, there[:, c], n) + np.bincount(a, back[:, c], n) for c in range(k)], 1) if len(a) else unary
        if step >= rounds or not len(a):
            break
        to_b = _lse((total[a] - back)[:, :, None] + pot, 1)
        to_a = _lse((total[b] - there)[:, None, :] + pot, 2)
        to_b, to_a = to_b - _lse(to_b, 1)[:, None], to_a - _lse(to_a, 1)[:, None]
        moved = max(np.abs(to_b - there).max(), np.abs(to_a - back).max())
        there, back = to_b, to_a
        if moved < 1e-5:  # the messages stand still
            rounds = step + 1
    node = np.exp(total - _lse(total, 1)[:, None])
    joint = (total[a] - back)[:, :, None] + (total[b] - there)[:, None, :] + pot
    edge = np.exp(joint - _lse(joint.reshape(len(a), -1), 1)[:, None, None]) if len(a) else np.zeros((0, k, k))
    return node, edge


def _graph(many: list[Nodes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix and edges of several texts side by side."""
    n = sum(len(x.spans) for x in many)
    z = np.zeros((n, len(FEATURES)))
    edges: list[tuple[int, int, int]] = []
    at = 0
    for x in many:
        for i, features in enumerate(x.features):
            z[at + i, features] = 1
        edges += [(at + i - 1, at + i, 0) for i, near in enumerate(x.follows) if near]
        edges += [(at + i, at + j, kind + 1) for i, j, kind in x.skips]
        at += len(x.spans)
    e = np.array(edges, np.int64).reshape(-1, 3)
    return z, e[:, 0], e[:, 1], e[:, 2]


def fit_field(texts: list[tuple[str, list[Span]]], rounds: int = 100, penalty: float = 0.5) -> Field:
    """Fit on texts with all their spans: gradient steps of the penalised likelihood, expectations by message passing (Rprop)."""
    k = len(KINDS) + 1
    many, gold = [], []
    for text, spans in texts:
        nodes = text_nodes(text, base_spans(text))
        many.append(nodes)
        gold += [next((KINDS.index(kind) + 1 for s, kind, e in spans if s < end and start < e), 0) for start, end in nodes.spans]
    z, a, b, kind = _graph(many)
    y = np.eye(k)[gold]
    n_w = len(FEATURES) * k
    theta = np.zeros(n_w + 3 * k * k)
    step, last = np.full_like(theta, 0.05), np.zeros_like(theta)
    given = np.zeros((3, k, k))
    np.add.at(given, kind, y[a][:, :, None] * y[b][:, None, :])

    def both_ways(x: np.ndarray) -> np.ndarray:  # skip edges have no direction
        return np.concatenate((x[:1], (x[1:] + x[1:].transpose(0, 2, 1)) / 2))

    for _ in range(rounds):
        pairs = theta[n_w:].reshape(3, k, k)
        node, edge = beliefs(z @ theta[:n_w].reshape(-1, k), a, b, kind, pairs)
        expected = np.stack([edge[kind == which].sum(0) for which in range(3)])
        gradient = np.concatenate(((z.T @ (y - node)).ravel(), both_ways(given - expected).ravel())) - penalty * theta
        turn = gradient * last
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-6, 1.0)
        gradient = np.where(turn < 0, 0, gradient)
        theta, last = theta + np.sign(gradient) * step, gradient
    return Field(theta[:n_w].reshape(-1, k), theta[n_w:].reshape(3, k, k))


def added_spans(text: str, nodes: Nodes, marginals: np.ndarray, base: list[Span]) -> list[Span]:
    """Entities of the most likely labels that overlap no base span: numbers must fit their kind (Luhn, parts up to 255, 7 to 15 digits)."""
    label = np.where(marginals.max(1) >= 0.5, marginals.argmax(1), 0).tolist()
    out: list[Span] = []
    i, j, reach = 0, 0, 0
    while i < len(label):
        first = i
        i += 1
        if not label[first]:
            continue
        kind = KINDS[label[first] - 1]
        parts = kind == "phone" or (kind == "card" and len(nodes.digits[first]) < 12)
        while parts and i < len(label) and label[i] == label[first] and nodes.follows[i] and text[nodes.spans[i][0]] != "+" and sum(map(len, nodes.digits[first : i + 1])) <= (15 if kind == "phone" else 19):
            i += 1
        start, end = nodes.spans[first][0], nodes.spans[i - 1][1]
        while j < len(base) and base[j][0] < end:
            reach = max(reach, base[j][2])
            j += 1
        own = "".join(nodes.digits[first:i])
        fits = {"email": True, "ip": "quad" in _shape(text[start:end], own), "card": 12 <= len(own) <= 19 and luhn(own), "phone": 7 <= len(own) <= 15}[kind]
        if fits and reach <= start:
            out.append((start, kind, end))
    return out


def find_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, by start and then by kind."""
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    held: list[tuple[int, list[Span], Nodes]] = []

    def settle() -> None:
        z, a, b, kind = _graph([x for _, _, x in held])
        node, _ = beliefs(z @ field.weights, a, b, kind, field.pairs)
        at = 0
        for i, base, nodes in held:
            more = added_spans(texts[i], nodes, node[at : at + len(nodes.spans)], base)
            out[i] = (base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]))))
            at += len(nodes.spans)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        if text and _ANY.search(text):
            base = base_spans(text)
            nodes = text_nodes(text, base)
            held.append((i, base, nodes))
            size += len(nodes.spans)
            if size > 20_000:  # documents are independent, so this bounds the memory of a round only
                settle()
                size = 0
    if held:
        settle()
    return out


# ---------------------------------------------------------------- labelled texts


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    body = _number(rng, rng.choice([14, 15, 15, 15, 17]))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _no_card(rng: random.Random, n: int) -> str:
    return next(x for x in iter(lambda: _number(rng, n), "") if not luhn(x))


def built_texts(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Texts of made-up words with personal data in full, glued together or shortened, and with numbers that are none; with their spans."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni or tu ver sta and the ing".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        pieces: list[list[tuple[str, str]]] = []  # groups of neighbouring tokens with their kind

        def phone(rng: random.Random = rng) -> tuple[str, str, str, str]:
            return str(rng.randint(1, 99)), _number(rng, 3), _number(rng, 3), _number(rng, 4)

        for _ in range(rng.randint(1, 6)):
            what = rng.randrange(16)
            c, p, q, r = phone()
            full = rng.choice([f"+{c} ({p}) {q}-{r}", f"+{c} {p} {q} {r}", f"+{c}-{p}-{q}-{r}", f"+{c}{p}{q}{r}"])
            mail = f"{word()}{rng.choice(['.', '_', ''])}{rng.randint(1, 99)}@{word()}{rng.choice(['', '2', '-x'])}.{rng.choice(['com', 'example.org', 'de'])}"
            ip, card = ".".join(str(rng.randint(0, 255)) for _ in range(4)), _card(rng)
            if what == 0:
                pieces.append([(full, "phone")])
            elif what == 1:  # in full once, shorter elsewhere
                pieces += [[(full, "phone")], [(rng.choice([f"({p}) {q}-{r}", f"{p}-{q}-{r}", f"{q}-{r}", f"{p}{q}{r}"]), "phone")]]
            elif what == 2:  # glued to what follows
                pieces.append([(f"+{c} ({p}) {q}-{r}", "phone"), rng.choice([(ip, "ip"), (card, "card"), (_no_card(rng, 8), "")])])
            elif what == 3:
                pieces.append([(card, "card")])
            elif what == 4:  # two in a row, so that the pattern reads one long number
                pieces.append([(card, "card"), (rng.choice([card, _card(rng)]), "card")])
            elif what == 5:
                pieces.append([(rng.choice([_number(rng, 2), _number(rng, 5)]), ""), (" ".join(card[i : i + 4] for i in range(0, 16, 4)) if len(card) == 16 else card, "card")])
            elif what == 6:
                pieces.append([(mail, "email")])
            elif what == 7:
                pieces += [[(mail, "email")], [(mail.split("@")[0], "email" if len(mail.split("@")[0]) >= 5 else "")]]
            elif what == 8:
                pieces.append([(ip, "ip")])
            elif what == 9:
                pieces.append([(ip, "ip"), rng.choice([(card, "card"), (mail, "email"), (full, "phone")])])
            elif what == 10:
                pieces += [[(x, "")] for x in [_no_card(rng, rng.choice([12, 13, 16, 16]))] * rng.randint(1, 3)]
            elif what == 11:
                pieces.append([(rng.choice([f"{_number(rng, 3)}-{_number(rng, 4)}", f"19{_number(rng, 2)}-0{rng.randint(1, 9)}-1{_number(rng, 1)}", _number(rng, rng.randint(1, 10)), f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 4)}"]), "")])
            elif what == 12:
                pieces.append([(rng.choice(["version 2.0", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}", "300.1.256.4"]), "")])
            elif what == 13:
                pieces.append([(f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(rng.choice([8, 32, 40])))}\"", "")])
            elif what == 14:
                pieces.append([(rng.choice([f"{word()}{rng.randint(1, 99)}", f"{word()}.{rng.randint(1, 99)}", f"@{word()}{rng.randint(1, 9)}", f"{word()}@{word()}"]), "")])
            else:
                pieces.append([(rng.choice([f"{rng.randint(1, 999)},{_number(rng, 3)}.00", f"{rng.randint(0, 23)}:{_number(rng, 2)}", f"#{_number(rng, 5)}", f"{rng.randint(1, 99)}%"]), "")])
        rng.shuffle(pieces)
        text, spans = word(), []
        for group in pieces:
            for _ in range(rng.randint(1, 6)):
                text += rng.choice([" ", " ", " ", "\n"]) + rng.choice([word(), word().capitalize() + "."])
            if group[0][1] and rng.random() < 0.15:
                text += " " + rng.choice(CUES[group[0][1]].split()) + rng.choice(["", ":"])
            mark = rng.choice(["", "", "", "***", "!!", ","])
            for value, kind in group:
                text += " "
                if kind:
                    spans.append((len(text), kind, len(text) + len(value)))
                text += value
            text += mark
            text += " " + word()
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def fitted(seed: int = 7, texts: int = 800) -> Field:
    """The field fitted on built texts; the same for the same arguments."""
    return fit_field(built_texts(seed, texts))


# ---------------------------------------------------------------- Spark


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
_SPAN_SQL = "array<struct<start: bigint, kind: string, end: bigint>>"


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts, what it leaves open stays covered."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, keep: list[str], text: str = "text", field: Field | None = None) -> DataFrame:
    """The columns ``keep`` with base and spans (arrays of start, kind, end in code points, by start and then by kind) and redacted.

    ``base`` are the patterns' spans; ``spans`` has them all and those that the field adds. A null text has none and stays null;
    an empty one has none. Whole texts are read; rows are independent, so repeated rows give equal rows. Other columns are ignored.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or fitted())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            results = find_spans(texts, shared.value)
            rows = lambda which: pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in r[which]] for r in results], pa.list_(_SPAN))
            cleared = pa.array([redacted(t, r[1]) for t, r in zip(texts, results, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows(0), rows(1), cleared], [*batch.schema.names[:-1], "base", "spans", "redacted"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(found, f"{fields}, base {_SPAN_SQL}, spans {_SPAN_SQL}, redacted string")


def written(spans: str | Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
