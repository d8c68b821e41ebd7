"""Personal data in texts: four patterns, and a linear-chain conditional random field over word shapes for other forms.

The patterns find plain e-mail addresses, IP addresses, card and phone numbers. The chain labels every word of every line and
adds what is written otherwise: `jane at mail dot org`, `(030) 123-4567`, `4111.1111.1111.1111`. It is fitted to a small
table of labelled sentences (TABLE, filled in by rule); a found span must pass an exact check of its kind.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from crowdpeak.llm.text import Memo, slices, utf8

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 for no personal data, 1 + 2k for the first and 2 + 2k for each further word of kind k.
LABELS = 1 + 2 * len(KINDS)
#: Rows of the weight table (features are hashed), and how many words left and right of a word count.
DIMS, AROUND = 1 << 14, 2
SENTENCES, EPOCHS, RATE, DECAY = 2400, 10, 0.3, 2e-4
#: Words decoded at a time, padding included, and bytes of text labelled together.
CELLS, AT_ONCE = 300_000, 6 << 20
#: Words whose scores are remembered at a time.
REMEMBERED = 200_000

HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: An address in words: something, at, something, dot, letters.
SPELLED = re.compile(r"[\w%+-][\w.%+-]*\s*(?:@|[\[({]?\b(?:at|arobase|arroba)\b[\])}]?)\s*\w[\w.-]*?\s*(?:\.|[\[({]?\b(?:dot|point|punkt|punto)\b[\])}]?)\s*[A-Za-z]{2,}", re.I)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, kind by kind, leftmost first, without overlap inside a kind.

    An address is sought from its @: the longest run of local characters before it that the last match has not used is the
    leftmost start, so that long runs of letters are read once."""
    out, last = [], 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    out += [(1, m.start(), m.end()) for m in ADDRESS.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# ---- word shapes -----------------------------------------------------------------------------------------------------

#: Words that tell something about their neighbours.
CUES = frozenset("""at dot point punkt punto arobase arroba (at) [at] {at} (dot) [dot] {dot} tel tel. phone call fax mobile cell telefon telefono
téléphone teléfono number nummer card visa mastercard karte carte tarjeta ip address host server adresse email e-mail mail mailto contact reach write
invoice order version isbn page year section id ref no. price total room""".split())
ENDINGS = frozenset("com org net edu de fr es io info".split())
EDGES = "\"'“”‘’«»<>[]{},;!?"


def core(word: str) -> tuple[int, int]:
    """The part of a word that a span takes: without quotes, brackets and closing marks; round ones stay in pairs."""
    start, end = 0, len(word)
    while start < end and (word[start] in EDGES or (word[start] == "(" and ")" not in word)):
        start += 1
    while end > start and (word[end - 1] in EDGES or word[end - 1] in ".:" or (word[end - 1] == ")" and "(" not in word)):
        end -= 1
    return start, end


def shape(word: str) -> str:
    """Letters as x and X, runs cut to one; digits as d, runs of up to four as long as they are, then `D`; other characters stay."""
    out, run, last = [], 0, ""
    for c in word[:64]:
        k = "d" if "0" <= c <= "9" else ("X" if c.isupper() else "x") if c.isalpha() else c
        run = run + 1 if k == last else 1
        last = k
        if run == 1 or (k == "d" and run <= 4):
            out.append(k)
        elif k == "d" and run == 5:
            out.append("D")
    return "".join(out)


def features(word: str) -> list[str]:
    a, b = core(word)
    inner, low = word[a:b], word.lower().strip(",;:!?")
    s = shape(inner)
    digits = "".join(c for c in inner if "0" <= c <= "9")
    out = ["1", "s" + s, "a" + s[:2], "z" + s[-2:], f"e{a > 0}{b < len(word)}"]
    if low in CUES:
        out.append("c" + low)
    if low.strip(".") in ENDINGS:
        out.append("ending")
    if inner.isalpha():
        out.append("letters" if len(inner) > 1 else "letter")
    if digits:
        n = len(digits)
        out += [f"n{n if n <= 4 else 6 if n <= 6 else 8 if n <= 8 else 11 if n <= 11 else 15 if n <= 15 else 19 if n <= 19 else 20}",
                "only" if n == len(inner) else "mixed"]
        if n >= 12:
            out.append(f"luhn{n <= 19 and luhn(digits)}")
    out += [f"h{c}" for c in "@.:-/+()" if c in inner]
    if inner.count(":") >= 2 and all(c in "0123456789abcdefABCDEF:" for c in inner):
        out.append("hex:")
    return out


def alike(word: str) -> str:
    """A word with the same features; one and the same for nearly all words of plain letters, with or without a mark behind."""
    body, tail = (word[:-1], word[-1]) if word[-1:] and word[-1] in ".,;:!?" else (word, "")
    low = body.lower()
    if not body.isalpha() or low in CUES or low in ENDINGS or low + tail in CUES:
        return word
    if body.islower():
        return ("ab" if len(body) > 1 else "a") + tail
    if body[0].isupper() and (len(body) == 1 or body[1:].islower()):
        return ("Ab" if len(body) > 1 else "A") + tail
    return ("AB" + tail) if body.isascii() and body.isupper() else word


def _rows(word: str) -> np.ndarray:
    """Rows of the weight table, one line for each offset at which the word may stand from the word that is labelled."""
    names = features(word)
    return np.array([[xxhash.xxh3_64_intdigest(f"{o}{n}") % DIMS for n in names] for o in range(-AROUND, AROUND + 1)])


# ---- the labelled table ----------------------------------------------------------------------------------------------

#: Sentences; `<kind form>` is a span of a kind, `{form}` something alike that is none. `~` stands for one to six plain words.
TABLE = (
    "~ <email spelled> ~", "email <email spelled> ~", "~ contact <email spelled>", "write to <email spelled> or call <phone local> ~", "~ <email marked> ~",
    "mail <email marked>", "~ ( <email marked> ) ~", "~ <email plain> ~", "~ <email plain>, ~", "~ <email spelled> and <email marked> ~",
    "~ <phone local> ~", "call <phone local> ~", "tel <phone local>", "phone: <phone local> ~", "~ fax <phone zero> ~", "~ <phone zero>, ~", "~ mobile <phone plus> ~",
    "~ <phone plus> ~", "~ <phone plus> <card plain> ~", "~ <card plain> <phone plus> ~", "~ <ip plain> <card plain> ~", "~ <email plain> <phone plus> ~",
    "~ <phone local> <email plain> ~", "téléphone <phone zero> ~", "Telefon <phone zero> ~", "teléfono <phone local> ~", "~ call <phone local> or <phone local> ~",
    "~ <card dots> ~", "card <card dots> ~", "visa <card short> ~", "~ <card plain> ~", "~ card <card groups>, ~", "~ <card slashes> ~", "carte <card dots>",
    "~ <ip six> ~", "server <ip six> ~", "~ host <ip six>, ~", "~ <ip plain> ~", "ip <ip plain>", "~ from <ip plain>. ~", "~ address <ip six> ~",
    "~", "~ at ~", "~ at ~ dot ~", "~ dot com ~", "~ at the ~", "~ {year} ~", "~ {number} ~", "order {number} ~", "~ {long} ~", "~ {badcard} ~", "invoice {badcard} ~",
    "~ {date} ~", "~ {money}, ~", "version {version} ~", "~ {version} ~", "~ {time} ~", "isbn {isbn} ~", "~ {hash} ~", "token = \"{hash}\" ~", "~ {range} ~",
    "page {number} ~", "~ {number} {number} {number} ~", "~ {year} - {year} ~", "~ {badip} ~", "~ {badgroups} ~", "id {long} ~", "~ @ ~", "~ call ~ card ~", "~ phone ~ mail ~",
    "~ {money} at {money} ~", "~ ( {number} ) {year} ~", "section {version} page {number} ~", "~! ~? ~: ~", "~ {handle} ~", "~ {ratio} ~", "room {number} at {time} ~")


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int, good: bool) -> str:
    while True:
        d = rng.choice("3456") + _digits(rng, n - 1)
        if luhn(d) == good:
            return d


def _grouped(d: str, mark: str) -> str:
    return mark.join(d[i : i + 4] for i in range(0, len(d), 4))


def _word(rng: random.Random) -> str:
    if rng.random() < 0.08:
        return rng.choice(sorted(CUES))
    w = "".join(rng.choice("abcdefghilmnoprstuvéèñü") for _ in range(rng.randint(1, 10)))
    w = w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.06 else w
    return w + rng.choice([".", ",", "!!", ";", "###", ".\""]) if rng.random() < 0.15 else w


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) + (_digits(rng, rng.randint(1, 3)) if rng.random() < 0.3 else "")


def _form(rng: random.Random, form: str) -> str:
    host, end = _name(rng), rng.choice(sorted(ENDINGS))
    pick = {
        "spelled": lambda: f"{_name(rng)} {rng.choice(['at', 'AT', 'arobase', 'arroba'])} {host} {rng.choice(['dot', 'DOT', 'point', 'punkt', 'punto'])} {end}",
        "marked": lambda: rng.choice([f"{_name(rng)} (at) {host} (dot) {end}", f"{_name(rng)}(at){host}.{end}", f"{_name(rng)}[at]{host}[dot]{end}",
                                      f"{_name(rng)} [at] {host} [dot] {end}", f"{_name(rng)} @ {host}.{end}", f"{_name(rng)} @ {host} . {end}", f"{_name(rng)} (at) {host}.{end}"]),
        "plain": lambda: rng.choice([f"{_name(rng)}@{host}.{end}", f"{_digits(rng, 2)}@{host}5.example.{end}", f"{_name(rng)}.{_name(rng)}@{host}.{end}"]),
        "local": lambda: rng.choice([f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}",
                                     f"({_digits(rng, 3)}) {_digits(rng, 7)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 4)}", f"({_digits(rng, 3)}){_digits(rng, 3)}-{_digits(rng, 4)}"]),
        "zero": lambda: rng.choice([f"00{_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 7)}", f"0{_digits(rng, 2)}/{_digits(rng, 7)}", f"0{_digits(rng, 1)} {' '.join(_digits(rng, 2) for _ in range(4))}",
                                    f"0{_digits(rng, 3)}-{_digits(rng, 6)}"]),
        "plus": lambda: rng.choice([f"+{_digits(rng, 1)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", f"+{_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 7)}",
                                    f"+{_digits(rng, 2)}/{_digits(rng, 2)}/{_digits(rng, 7)}", f"+{_digits(rng, 11)}"]),
        "dots": lambda: _grouped(_card(rng, 16, True), "."), "slashes": lambda: _grouped(_card(rng, 16, True), "/"), "groups": lambda: _grouped(_card(rng, 16, True), rng.choice(" -")),
        "plain16": lambda: _card(rng, 16, True),
        "short": lambda: (lambda d: rng.choice([d, f"{d[:4]} {d[4:10]} {d[10:]}"]))(_card(rng, 15, True)),
        "six": lambda: rng.choice([":".join(f"{rng.randrange(65536):x}" for _ in range(8)), f"fe80::{rng.randrange(65536):x}:{rng.randrange(65536):x}", f"2001:db8::{rng.randrange(4096):x}"]),
        "four": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "year": lambda: str(rng.randint(1500, 2100)), "number": lambda: _digits(rng, rng.randint(1, 6)), "long": lambda: "1" + _digits(rng, rng.choice([7, 8, 9, 10, 11, 12, 20, 24])),
        "badcard": lambda: _card(rng, 16, False), "badgroups": lambda: _grouped(_card(rng, 16, False), " "),
        "date": lambda: rng.choice([f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}/{_digits(rng, 2)}/{_digits(rng, 4)}", f"{_digits(rng, 2)}.{_digits(rng, 2)}.{_digits(rng, 4)}"]),
        "money": lambda: rng.choice([f"${_digits(rng, 3)}.{_digits(rng, 2)}", f"{_digits(rng, 2)},{_digits(rng, 3)}", f"{_digits(rng, 2)}.{_digits(rng, 3)}.{_digits(rng, 3)} €"]),
        "version": lambda: ".".join(str(rng.randrange(20)) for _ in range(rng.choice([2, 3]))), "time": lambda: rng.choice([f"{_digits(rng, 2)}:{_digits(rng, 2)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}:{_digits(rng, 2)}"]),
        "isbn": lambda: f"978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}", "hash": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))),
        "range": lambda: f"{_digits(rng, 3)}-{_digits(rng, 3)}", "badip": lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.1.{_digits(rng, 3)}",
        "handle": lambda: f"@{_name(rng)}", "ratio": lambda: f"{_digits(rng, 2)}/{_digits(rng, 2)}"}
    return pick[form]()


def labelled_rows(n: int = SENTENCES, seed: int = 12) -> list[tuple[list[str], list[int]]]:
    """Words and labels of `n` sentences: the lines of TABLE in turn, filled in by rule."""
    rng, out = random.Random(seed), []
    for k in range(n):
        words, labels = [], []
        for kind, form, other, rest in re.findall(r"<(\w+) (\w+)>[,.]?|\{(\w+)\}|(~|[^\s<{]+)", TABLE[k % len(TABLE)]):
            if form:
                made = _form(rng, {"ip plain": "four", "card plain": "plain16"}.get(f"{kind} {form}", form)).split()
                first = 1 + 2 * KINDS.index(kind)
                labels += [first] + [first + 1] * (len(made) - 1)
            elif other:
                made = _form(rng, other).split()
                labels += [0] * len(made)
            else:
                made = [_word(rng) for _ in range(rng.randint(1, 6))] if rest == "~" else [rest]
                labels += [0] * len(made)
            if rng.random() < 0.15 and (form or other):
                made[-1] += rng.choice([",", ".", "###", "!!"])
            words += made
        out.append((words, labels))
    return out


# ---- the chain -------------------------------------------------------------------------------------------------------

class Model(NamedTuple):
    weights: np.ndarray  # (DIMS, LABELS)
    moves: np.ndarray  # (LABELS, LABELS), from the label before to this one; texts begin after and end before label 0


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(e: np.ndarray, lengths: np.ndarray, gold: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded chains (chains, words, labels) and its gradients by emission and by move."""
    n, t, k = e.shape
    rows = np.arange(n)
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[:, 0] = moves[0] + e[:, 0]
    for i in range(1, t):
        ahead[:, i] = _sum_exp(ahead[:, i - 1, :, None] + moves, 1) + e[:, i]
    last = lengths - 1
    behind[rows, last] = moves[:, 0]
    for i in range(t - 2, -1, -1):
        inner = i < last
        behind[inner, i] = _sum_exp(moves[None] + (e[inner, i + 1] + behind[inner, i + 1])[:, None, :], 2)
    whole = _sum_exp(ahead[rows, last] + moves[:, 0], 1)
    inside = np.arange(t)[None, :] < lengths[:, None]
    p = np.where(inside[:, :, None], np.exp(ahead + behind - whole[:, None, None]), 0.0)
    hot = np.eye(k)[gold] * inside[:, :, None]
    d_moves = -p[:, 0].sum(axis=0)[None, :] * (np.arange(k) == 0)[:, None]
    d_moves[0] += hot[:, 0].sum(axis=0)
    d_moves[:, 0] += hot[rows, last].sum(axis=0) - p[rows, last].sum(axis=0)
    for i in range(1, t):
        at = inside[:, i]
        both = np.exp(ahead[at, i - 1, :, None] + moves[None] + (e[at, i] + behind[at, i])[:, None, :] - whole[at, None, None])
        d_moves += np.einsum("nj,nk->jk", hot[at, i - 1], hot[at, i]) - both.sum(axis=0)
    score = (hot * e).sum() + sum(moves[a, b] for g, m in zip(gold, lengths) for a, b in zip([0, *g[:m]], [*g[:m], 0])) - whole.sum()
    return float(score), hot - p, d_moves


def train(rows: list[tuple[list[str], list[int]]] | None = None, epochs: int = EPOCHS, seed: int = 12) -> Model:
    """Adagrad on the conditional likelihood of the labelled rows, by default the table above; numpy on the driver, the same each time."""
    rows = labelled_rows() if rows is None else rows
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((DIMS, LABELS)), np.zeros((LABELS, LABELS))
    squares, move_squares = np.full((DIMS, LABELS), 1e-2), np.full((LABELS, LABELS), 1e-2)
    known: dict[str, np.ndarray] = {}
    used = []
    for words, labels in rows:
        ids, at = [], []
        for i in range(len(words)):
            for o in range(-AROUND, AROUND + 1):
                w = words[i + o] if 0 <= i + o < len(words) else ""
                if w not in known:
                    known[w] = _rows(w)
                ids.append(known[w][o + AROUND])
                at.append(np.full(len(ids[-1]), i))
        used.append((np.concatenate(ids), np.concatenate(at), np.array(labels)))
    for epoch in range(epochs):
        order = rng.permutation(len(used))
        for begin in range(0, len(order), 100):
            part = [used[i] for i in order[begin : begin + 100]]
            lengths = np.array([len(g) for _, _, g in part])
            t = int(lengths.max())
            ids = np.concatenate([i for i, _, _ in part])
            place = np.concatenate([a + n * t for n, (_, a, _) in enumerate(part)])
            e = np.stack([np.bincount(place, weights[ids, y], len(part) * t) for y in range(LABELS)], axis=1).reshape(len(part), t, LABELS)
            gold = np.zeros((len(part), t), dtype=int)
            for n, (_, _, g) in enumerate(part):
                gold[n, : len(g)] = g
            _, d, d_moves = gradients(e, lengths, gold, moves)
            d = d.reshape(-1, LABELS)
            step = np.stack([np.bincount(ids, d[place, y], DIMS) for y in range(LABELS)], axis=1) - DECAY * len(part) * weights
            squares += step**2
            weights += RATE * step / np.sqrt(squares)
            d_moves -= DECAY * len(part) * moves
            move_squares += d_moves**2
            moves += RATE * d_moves / np.sqrt(move_squares)
    return Model(weights, moves)


def viterbi(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Likeliest labels of padded chains that lie between words of label 0 (the smallest label on ties); 0 beyond their ends."""
    n, t, k = e.shape
    rows, into, least = np.arange(n), np.ascontiguousarray(moves.T), int(lengths.min())
    best, now = moves[0] + e[:, 0], np.zeros(n, dtype=np.int64)
    back = np.zeros((t, n, k), dtype=np.int8)
    for i in range(t):
        if i:
            x = best[:, None, :] + into  # (chains, to, from)
            back[i] = x.argmax(axis=2)
            best = x.max(axis=2) + e[:, i]
        if i + 1 >= least:
            ending = lengths == i + 1
            now[ending] = (best[ending] + moves[:, 0]).argmax(axis=1)
    out = np.zeros((n, t), dtype=np.int8)
    for i in range(t - 1, -1, -1):
        if i < least - 1:
            now = back[i + 1, rows, now]
            out[:, i] = now
        else:
            now = np.where(i < lengths - 1, back[min(i + 1, t - 1), rows, now], now)
            out[:, i] = np.where(i < lengths, now, 0)
    return out


class Tagger:
    """Labels of all words of some texts. Scores are remembered by features, words by the place of their scores."""

    def __init__(self, model: Model):
        self.model, self.moves = model, model.moves.astype(np.float32)
        self.words = Memo(self._place, REMEMBERED)
        self.places: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, 2 * AROUND + 1, LABELS), dtype=np.float32)

    def _place(self, word: str) -> int:
        word = alike(word)
        place = self.places.get(word)
        if place is None:
            place = self.places[word] = len(self.places)
            if place == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[place] = [self.model.weights[r].sum(axis=0) for r in _rows(word)]
        return place

    def label(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the labels of its words (split at white space). Every line is a chain of its own."""
        gap = [""] * AROUND
        words, at, own = list(gap), [], [0]
        for text in texts:
            for line in text.split("\n"):
                mine = line.split()
                if mine:
                    at.append((len(words), len(words) + len(mine)))
                    words += mine
                    words += gap
            own.append(len(at))
        ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        e = np.zeros((len(words), LABELS), dtype=np.float32)
        for o in range(-AROUND, AROUND + 1):
            a, b = max(0, o), len(words) + min(0, o)
            e[a - o : b - o] += self.scores[ids[a:b], o + AROUND]
        labels = np.zeros(len(words), dtype=np.int8)
        starts, ends = np.array(at, dtype=np.int64).reshape(-1, 2).T
        lengths = ends - starts
        # Lines of like length are decoded together: at most half of a block is padding.
        size = np.ceil(np.log2(lengths)).astype(int)
        for c in np.unique(size):
            those = np.flatnonzero(size == c)
            for chunk in np.array_split(those, -(-(len(those) << int(c)) // CELLS)):
                t = int(lengths[chunk].max())
                index = np.minimum(starts[chunk][:, None] + np.arange(t)[None, :], len(words) - 1)
                within = np.arange(t)[None, :] < lengths[chunk][:, None]
                labels[index[within]] = viterbi(e[index], lengths[chunk], self.moves)[within]
        return [np.concatenate([labels[a:b] for a, b in at[i:j]]) if j > i else labels[:0] for i, j in zip(own, own[1:])]


def _passes(kind: int, text: str) -> bool:
    """The exact check of a span of the chain."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        return SPELLED.fullmatch(text) is not None
    if kind == 1:
        parts = text.split(":")
        return text.count("::") <= 1 and 3 <= len(parts) <= 8 and (len(parts) == 8 or "::" in text) and all(len(p) <= 4 and all(c in "0123456789abcdefABCDEF" for c in p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in text)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the chain that pass their check and touch none of the patterns'."""
    if not labels.any():
        return []
    words = [m.span() for m in re.finditer(r"\S+", text)]
    out, i, n = [], 0, len(labels)
    while i < n:
        if not labels[i]:
            i += 1
            continue
        kind, j = (int(labels[i]) - 1) // 2, i + 1
        while j < n and labels[j] == 2 + 2 * kind:
            j += 1
        first, last = words[i], words[j - 1]
        start = first[0] + core(text[first[0] : first[1]])[0]
        end = last[0] + core(text[last[0] : last[1]])[1]
        if start < end and _passes(kind, text[start:end]) and not any(a < end and start < b for _, a, b in base):
            out.append((kind, start, end))
        i = j
    return out


SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"


def find_personal_data(docs: DataFrame, model: Model | None = None, column: str = "text") -> DataFrame:
    """`docs` with `base_spans` (the patterns') and `spans` (these and the chain's) of the whole text.

    A span has kind, start and end (code points, end exclusive) and its text; spans are ordered by kind (email, ip, card,
    phone), then start. Null and empty texts have none. Spans of one kind do not overlap; the chain adds none that touches
    one of the patterns. Columns of these names are replaced; repeated rows and null ids are rows like others; an empty
    table gives an empty table. Every row stays in its task: nothing is shuffled."""
    model = train() if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the input
    base = docs.drop("base_spans", "spans")
    kind = _parse_datatype_string(SPANS)
    schema = StructType([*base.schema.fields, StructField("base_spans", kind), StructField("spans", kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def listed(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b]} for k, a, b in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in slices(batch, column, AT_ONCE):
                texts = [t.decode("utf-8", "replace") for t in utf8(part.column(part.schema.get_field_index(column)))]
                plain = [base_spans(t) for t in texts]
                more = [added_spans(t, y, b) for t, y, b in zip(texts, tagger.label(texts), plain)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([listed(t, b) for t, b in zip(texts, plain)], arrow), pa.array([listed(t, b + m) for t, b, m in zip(texts, plain, more)], arrow)],
                    names=[*part.schema.names, "base_spans", "spans"])

    return base.mapInArrow(run, schema)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in brackets, e.g. [EMAIL]; of spans that overlap, the first one counts."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < done["at"], done).otherwise(F.struct(s["end"].alias("at"), more.alias("out")))

    return F.aggregate(by_start, begin, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
