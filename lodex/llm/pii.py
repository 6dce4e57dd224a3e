"""Personal data: pattern spans, and a skip-chain conditional random field over a document's tokens.

The base spans are those of four patterns with their checks. The field then labels the document's
number-like and address-like tokens with O or one of the kinds; all other words are O for certain and
enter as observations (announcing words up to two words before, the next word). Its factor graph has
token potentials, chain potentials between neighbouring tokens, and skip potentials between distant
tokens that repeat or resemble each other (same last seven digits, same address, or same letters
around the ``@`` up to the host's first dot); loopy belief propagation passes messages over both, so that a
number whose form says little takes the label of its clear repetition elsewhere in the document.
Occurrences of a form are linked each to the next, so the number of skip edges grows with the tokens,
not with their pairs. Weights are learned on documents that ``labelled_documents`` makes, by the gradient
of the log-likelihood with the propagated marginals; no table is read for it. They are kept in
``pii_field.json`` beside this file; ``python -m lodex.llm.pii`` learns and writes them anew.

A labelled run of tokens becomes a span if it overlaps no base span, its marginals reach ``sure`` and
it is possible for its kind (a card's check digit, an address that parses, 7 to 15 digits of a number).
Base spans always stay.

Defined results: null text counts as empty and has no spans; repeated rows come out as often as
they come in; an empty table gives an empty result. Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import os
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 8
SURE = 0.9

# The four base patterns. The ones for numbers carry a look-behind or possessive
# repeats, which change no match and keep the time linear in the text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards."""
    out, end, low = [], 0, 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        low = max(at + 1, end)
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x) < 4 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Words that announce a kind, or a number of no kind, in four languages.
CUES = {
    "email": ("email", "e-mail", "emails", "mail", "mailto", "correo", "courriel", "mél", "mailadresse", "e-mail-adresse"),
    "ip": ("ip", "host", "server", "serveur", "servidor", "rechner", "ping", "dns", "gateway", "ip-adresse", "ipv6"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "kartennummer", "carte", "bancaire", "tarjeta", "crédito"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "telefon", "rufnummer", "mobil", "handy", "anrufen", "téléphone", "tél", "portable", "appelez", "teléfono", "móvil", "llame", "llamar"),
    "other": ("token", "order", "invoice", "isbn", "version", "page", "pages", "room", "id", "no", "number", "year", "in", "bestellung", "rechnung", "seite", "raum", "jahr", "nummer", "commande", "facture", "salle", "année", "numéro", "pedido", "factura", "página", "sala", "año", "número", "license"),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
TRIM = ".,;:!?\"'<>[]{}|*#$%&="
QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


@dataclass(slots=True)
class Token:
    start: int
    end: int
    text: str
    near: bool  # only a blank or two stand between the token before it and this one
    before: list[str]  # up to two words between them, the nearest last
    after: str = ""


def tokens(text: str) -> list[Token]:
    """The document's number-like and address-like tokens, without the punctuation around them. The
    words around a token are of no kind for certain, so they enter as observations."""
    out, last = [], 0
    for m in TOKEN.finditer(text):
        raw, gap = m[0], text[last : m.start()]
        last = m.end()
        if out and not out[-1].after:
            out[-1].after = "".join(gap.split(None, 1)[:1]) or raw
        word = raw.strip(TRIM)
        a = m.start() + len(raw) - len(raw.lstrip(TRIM))
        if word.endswith(")") and "(" not in word:
            word = word.rstrip(")" + TRIM)
        if word.startswith("(") and ")" not in word:
            a, word = a + 1, word[1:]
        if word:
            near = bool(out) and 0 < a - out[-1].end < 3 and text[out[-1].end : a].isspace()
            out.append(Token(a, a + len(word), word, near, gap.rsplit(None, 2)[-2:]))
    return out


def form(word: str) -> str:
    """What repeated and similar tokens have in common: the same letters on both sides of the ``@``
    up to the host's first dot, the same four numbers of an address, the same last seven digits."""
    if "@" in word:
        local, host = word.lower().split("@", 1)
        return re.sub(r"[^a-z0-9]+", "", local) + "@" + re.sub(r"[^a-z0-9]+", "", host.split(".", 1)[0])
    quad = QUAD.match(word)
    if quad:
        return quad[0]
    digits = NOT_DIGIT.sub("", word)
    return "#" + digits[-7:] if len(digits) >= 7 else "=" + word.lower()


def is_address(word: str) -> bool:
    try:
        ipaddress.ip_address(word)
    except ValueError:
        return False
    return True


def token_features(given: list[Token], spans: list[tuple[int, int, int]]) -> list[list[str]]:
    """spans: the base spans as (start, end, kind) by start."""
    out, i = [], 0
    for t in given:
        while i < len(spans) and spans[i][1] <= t.start:
            i += 1
        f = ["bias"]
        if i < len(spans) and spans[i][0] < t.end:
            f += [f"base:{KINDS[k]}" for a, b, k in spans[i : i + 3] if a < t.end]
        else:
            f.append("base:none")
        digits = NOT_DIGIT.sub("", t.text)
        n = len(digits)
        letters = any(c.isalpha() for c in t.text)
        f.append(f"digits:{n if n < 5 else '5-8' if n < 9 else '9-12' if n < 13 else '13-19' if n < 20 else '20+'}")
        f.append("letters" if letters else "no-letters")
        if 13 <= n <= 19 and not letters:
            f.append(f"luhn:{luhn(digits)}")
        shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", t.text))
        f.append(f"shape:{shape}" if len(shape) <= 9 else "shape:long")
        groups = [len(g) for g in NOT_DIGIT.split(t.text) if g]
        f.append("groups:" + ("-".join(map(str, groups)) if len(groups) < 6 and max(groups, default=0) < 6 else "other"))
        f.append("lead:" + ("+" if t.text[0] == "+" else "00" if digits[:2] == "00" else "0" if digits[:1] == "0" else "other"))
        if "@" in t.text:
            local, host = t.text.split("@", 1)
            f.append("at:" + ("no-local" if not local else "no-host" if not host else "dot" if "." in host else "plain"))
        if ":" in t.text and is_address(t.text):
            f.append("address")
        words = [CUE_OF.get(w.strip("()" + TRIM).lower(), "none") for w in t.before]
        f += [f"cue{len(words) - j}:{c}" for j, c in enumerate(words) if c != "none"]
        f.append("next-number" if DIGIT.search(t.after) else "next-word")
        out.append(f)
    return out


def skips(given: list[Token]) -> list[tuple[int, int]]:
    """Each token with the next one of the same form."""
    last: dict[str, int] = {}
    out = []
    for i, t in enumerate(given):
        key = form(t.text)
        if key in last:
            out.append((last[key], i))
        last[key] = i
    return out


def propagate(own: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product messages in log space over a pairwise graph. own: [n, K]; edges: [m, 2];
    potentials: [m, K, K] from the first to the second end. Marginals of nodes and of edges."""
    n, k = own.shape
    m = len(edges)
    if not m:
        p = np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))
        return p, np.empty((0, k, k))
    a, b = edges[:, 0], edges[:, 1]
    right, left = np.zeros((m, k)), np.zeros((m, k))  # to b, to a
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, b, right)
        np.add.at(belief, a, left)
        to_b = np.logaddexp.reduce((belief[a] - left)[:, :, None] + potentials, axis=1)
        to_a = np.logaddexp.reduce((belief[b] - right)[:, None, :] + potentials, axis=2)
        to_b -= np.logaddexp.reduce(to_b, axis=1, keepdims=True)
        to_a -= np.logaddexp.reduce(to_a, axis=1, keepdims=True)
        done = max(np.abs(to_b - right).max(), np.abs(to_a - left).max()) < 1e-4
        right, left = 0.5 * right + 0.5 * to_b, 0.5 * left + 0.5 * to_a
        if done:
            break
    belief = own.copy()
    np.add.at(belief, b, right)
    np.add.at(belief, a, left)
    node = np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))
    joint = (belief[a] - left)[:, :, None] + potentials + (belief[b] - right)[:, None, :]
    joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(m, -1), axis=1)[:, None, None])
    return node, joint


@dataclass
class Field:
    number: dict[str, int]
    w: np.ndarray  # [features + 1, K]; the last row, of unknown features, is zero
    chain: np.ndarray
    skip: np.ndarray

    def graph(self, given: list[Token], base) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        unknown = len(self.w) - 1
        rows = [np.array([self.number.get(x, unknown) for x in f]) for f in token_features(given, sorted((a, b, k) for k, a, b in base))]
        near = [(i - 1, i) for i, t in enumerate(given) if t.near and i]
        far = skips(given)
        return rows, np.array(near + far, dtype=np.int64).reshape(-1, 2), np.array([0] * len(near) + [1] * len(far), dtype=np.int64)

    def marginals(self, given: list[Token], base) -> np.ndarray:
        rows, edges, kind = self.graph(given, base)
        own = np.array([self.w[r].sum(axis=0) for r in rows])
        return propagate(own, edges, np.stack([self.chain, self.skip])[kind])[0]


def possible(kind: int, span: str) -> bool:
    """What every span of the kind fulfils, whatever its form."""
    digits = NOT_DIGIT.sub("", span)
    if kind == 0:
        local, _, host = span.partition("@")
        return bool(local) and any(c.isalpha() for c in host)
    if kind == 1:
        return is_address(span)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in span)


def found_spans(text: str | None, field: Field, sure: float = SURE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those that the field adds."""
    text = text or ""
    base = base_spans(text)
    if not DIGIT.search(text) and "@" not in text:
        return base, base
    given = tokens(text)
    taken = sorted((a, b) for _, a, b in base)
    edges_a, edges_b = np.array([a for a, _ in taken], dtype=np.int64), np.array([b for _, b in taken], dtype=np.int64)
    if len(given) == 0:
        return base, base
    p = field.marginals(given, base)
    label, added = p.argmax(axis=1), []
    i = 0
    while i < len(given):
        j = i + 1
        if label[i]:
            while j < len(given) and given[j].near and label[j] == label[i]:
                j += 1
            a, b = given[i].start, given[j - 1].end
            clear = p[i:j, label[i]].min() >= sure
            if clear and possible(int(label[i]) - 1, text[a:b]) and (not len(edges_a) or not np.any((edges_a < b) & (edges_b > a))):
                added.append((int(label[i]) - 1, a, b))
        i = j
    return base, sorted(base + added)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# Sentences of the training texts: by language those that announce a kind, and those with numbers of none.
ANNOUNCING = {
    "en": {"email": "email: {}|write to my e-mail {}|mail {} for details", "ip": "the server {} is down|ping {}|host {}", "card": "card {}|paid by visa {}|my credit card {}", "phone": "call {}|phone: {}|tel. {}|fax {}|mobile {}|dial {} now"},
    "de": {"email": "Mail an {}|E-Mail: {}|unsere Mailadresse {}", "ip": "der Server {} antwortet|Rechner {}", "card": "Kreditkarte {}|Karte {}|Kartennummer: {}", "phone": "Telefon {}|Tel. {}|Handy: {}|Rufnummer {}|Fax {}"},
    "fr": {"email": "courriel : {}|mail {}|par e-mail {}", "ip": "le serveur {}|host {}", "card": "carte bancaire {}|carte {}", "phone": "téléphone {}|tél. {}|portable : {}|appelez {}"},
    "es": {"email": "correo {}|correo: {}|mail {}", "ip": "el servidor {}|ip {}", "card": "tarjeta {}|tarjeta de crédito {}", "phone": "teléfono {}|tel. {}|móvil {}|llame {}"},
}
OTHERS = {
    "en": "order {}|invoice no. {}|in {}|version {}|page {}|token {}|ISBN {}|about {} people|room {}|it costs {}|on {}|build {} passed",
    "de": "Bestellung {}|Rechnung {}|im Jahr {}|Version {}|Seite {}|Nummer {}|etwa {} Leute|Raum {}|am {}",
    "fr": "commande {}|facture {}|en {}|version {}|page {}|numéro {}|environ {} personnes|salle {}|le {}",
    "es": "pedido {}|factura {}|en {}|versión {}|página {}|número {}|unas {} personas|sala {}|el {}",
}


def labelled_documents(n: int = 800, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training texts in four languages: prose with personal data in clear and unclear forms,
    announced or not, repeated or not, run into other numbers, and with numbers that are none: years,
    prices, versions, sizes, serial numbers, hashes, card numbers that fail the check, handles."""
    rng = np.random.default_rng(seed)
    syllables = ["ta", "ren", "mo", "lis", "ka", "dor", "ve", "pin", "gra", "el", "oth", "an", "er"]
    languages = sorted(ANNOUNCING)

    def word():
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def digits(k):
        return "".join(map(str, rng.integers(0, 10, k)))

    def card(valid=True):
        body = digits(15)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)) == valid)

    def fours(c, sign):
        return sign.join(c[i : i + 4] for i in range(0, 16, 4))

    def forms(kind):
        """A clear form; a form that shows its kind only beside it or where it is announced, or,
        with true, by itself."""
        if kind == 0:
            user, host = f"{word()}.{word() if rng.random() < 0.5 else digits(2)}", word()
            return f"{user}@{host}.example.com", f"{user}@{host}", False
        if kind == 1:
            six = ":".join(f"{x:x}" for x in rng.integers(1, 65536, 8)) if rng.random() < 0.5 else f"fe80::{rng.integers(1, 65536):x}:{rng.integers(16, 9999)}"
            return ".".join(str(x) for x in rng.integers(1, 255, 4)), six, True
        if kind == 2:
            c = card()
            return (c if rng.random() < 0.5 else fours(c, " ")), fours(c, rng.choice([".", "/", "  ", "_"])), True
        area, a, b = digits(3), digits(3), digits(4)
        shapes = [(f"({area}) {a}-{b}", True), (f"{area}-{a}-{b}", True), (f"{area}.{a}.{b}", False), (f"0{area}/{a}{b}", False), (f"0{area} {a}{b}", False), (f"{area}{a}{b}", False), (f"{area} {a} {b[:3]}", False)]
        shown, alone = shapes[rng.integers(len(shapes))]
        if rng.random() < 0.15:
            pairs = digits(8)
            shown, alone = f"0{rng.integers(1, 8)} " + " ".join(pairs[i : i + 2] for i in range(0, 8, 2)), False
        return (f"+1 ({area}) {a}-{b}" if rng.random() < 0.5 else f"+{digits(2)} {area} {a}{b}"), shown, alone

    def none():
        return rng.choice([f"{rng.integers(1900, 2030)}", f"{digits(2)}.{digits(2)}", f"{rng.integers(1, 9)}.0", f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}", digits(3), digits(7), digits(9), digits(10), digits(11), card(False), fours(card(False), rng.choice([".", "/", " "])), f"{rng.integers(1, 30)}-{rng.integers(1, 12)}-{rng.integers(1990, 2030)}", f"{digits(3)}-{digits(4)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{word()}{digits(2)}", f"@{word()}", f"{word()}@{word()}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.", f"#{digits(4)}", f"{digits(3)},{digits(3)}", f"{digits(2)}%", f"{digits(3)}/{digits(3)}", f"{digits(3)} {digits(3)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(2)} {digits(2)} {digits(2)}"])

    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        language = languages[rng.integers(len(languages))]

        def put(s, kind=None):
            nonlocal at
            if kind is not None:
                spans.append((kind, at, at + len(s)))
            parts.append(s + " ")
            at += len(s) + 1

        def prose(least, most):
            for _ in range(rng.integers(least, most)):
                put(word())

        def sentence(choices, shown, kind=None):
            lead, _, rest = rng.choice(choices.split("|")).partition("{}")
            put(lead.strip())
            put(shown, kind)
            if rest:
                put(rest.strip())

        for _ in range(rng.integers(1, 5)):
            prose(2, 9)
            kind = int(rng.integers(0, 4))
            clear, unclear, alone = forms(kind)
            case = rng.random()
            announced = ANNOUNCING[language][KINDS[kind]]
            if case < 0.3:
                sentence(announced, unclear, kind)
            elif case < 0.4:
                put(unclear, kind if alone else None)
            elif case < 0.5:
                sentence(announced, clear, kind)
            else:
                put(clear, kind)
                if rng.random() < 0.25 and kind in (1, 3):
                    put(".".join(str(x) for x in rng.integers(1, 255, 4)), 1)
                if rng.random() < 0.6:
                    prose(2, 9)
                    put(unclear if rng.random() < 0.8 else clear, kind)
            for _ in range(rng.integers(0, 5)):
                prose(1, 4)
                x = none()
                sentence(OTHERS[language], x) if rng.random() < 0.6 else put(x)
                if rng.random() < 0.2:
                    prose(1, 3)
                    put(x)
            if rng.random() < 0.3:  # an announcing word without a number
                put(rng.choice(CUES[KINDS[rng.integers(0, 4)]]))
                prose(3, 6)
        out.append(("".join(parts), spans))
    return out


def fit(docs: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 12, rate: float = 0.25, l2: float = 2e-3) -> Field:
    """Every third text is shown without its base spans, so that the field learns clear forms too,
    which the patterns miss where a form runs into other numbers."""
    k = len(KINDS) + 1
    prepared = []
    for number, (text, spans) in enumerate(docs):
        given, base = tokens(text), [] if number % 3 == 0 else base_spans(text)
        if given:
            y = np.zeros(len(given), np.int64)
            for kind, a, b in spans:
                for i, t in enumerate(given):
                    if t.start < b and t.end > a:
                        y[i] = kind + 1
            prepared.append((given, base, y))
    number = {w: i for i, w in enumerate(sorted({x for g, b, _ in prepared for f in token_features(g, sorted((i, j, k) for k, i, j in b)) for x in f}))}
    field = Field(number, np.zeros((len(number) + 1, k)), np.zeros((k, k)), np.zeros((k, k)))
    data = [(*field.graph(g, b), y) for g, b, y in prepared]
    gw, gm = np.full(field.w.shape, 1e-6), np.full((2, k, k), 1e-6)
    for _ in range(epochs):
        for rows, edges, kind, y in data:
            moves = np.stack([field.chain, field.skip])
            p, joint = propagate(np.array([field.w[r].sum(axis=0) for r in rows]), edges, moves[kind])
            p[np.arange(len(y)), y] -= 1
            used, back = np.unique(np.concatenate(rows), return_inverse=True)
            dw = np.zeros((len(used), k))
            np.add.at(dw, back, np.repeat(p, [len(r) for r in rows], axis=0))
            dw += l2 * field.w[used]
            gw[used] += dw**2
            field.w[used] -= rate * dw / np.sqrt(gw[used])
            if len(edges):
                joint[np.arange(len(edges)), y[edges[:, 0]], y[edges[:, 1]]] -= 1
                dm = l2 * moves
                np.add.at(dm, kind, joint)
                gm += dm**2
                moves = moves - rate * dm / np.sqrt(gm)
                field.chain, field.skip = moves[0], moves[1]
    field.w[-1] = 0
    return field


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_field.json")


@cache
def default_field() -> Field:
    with open(WEIGHTS, encoding="utf-8") as f:
        kept = json.load(f)
    names = list(kept["weights"])
    w = np.array([*kept["weights"].values(), [0.0] * (len(KINDS) + 1)])
    return Field({x: i for i, x in enumerate(names)}, w, np.array(kept["chain"]), np.array(kept["skip"]))


def write_default_field(path: str = WEIGHTS) -> None:
    field = fit(labelled_documents())
    rounded = lambda rows: [[round(float(x), 6) for x in row] for row in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"weights": dict(zip(field.number, rounded(field.w))), "chain": rounded(field.chain), "skip": rounded(field.skip)}, f, ensure_ascii=False, indent=0)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, counts of base spans by kind,
    base_sha256, spans."""
    known = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches):
        for batch in pieces_of(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, every = found_spans(text, known.value)
                counts = [0] * len(KINDS)
                for s in base:
                    counts[s[0]] += 1
                rows.append((doc, *counts, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every)))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(cols)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, field: Field) -> str | None:
    """The text with every found span replaced by its kind in square brackets."""
    if text is None:
        return None
    spans, out, at = sorted((a, b, k) for k, a, b in found_spans(text, field)[1]), [], 0
    for a, b, k in spans:
        if b > at:
            out += [text[at : max(a, at)], f"[{KINDS[k].upper()}]" if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with its text redacted and, if there, n_chars recounted; other columns untouched."""
    known, schema = docs.sparkSession.sparkContext.broadcast(field or default_field()), docs.schema
    at = [f.name for f in schema].index("text")
    chars = next((i for i, f in enumerate(schema) if f.name == "n_chars" and f.dataType.typeName() == "long"), None)

    def run(batches):
        for batch in pieces_of(batches):
            texts = [redact(t, known.value) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


if __name__ == "__main__":
    write_default_field()
